"""Secret scans: base patterns, and multipart credentials linked by an interval join.

Base spans (assignments, access identifiers, long hex runs) are always reported. Weak
parts (account identifiers, unlabelled key-like strings, endpoints) mean nothing alone:
one is added only if a complementary part starts within ``scope`` code points of it in the
same text. Offsets are code points, ends exclusive. A pattern's matches and the pieces
between them give the offsets: a running sum over one text's matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import keep, whole

SCOPE = 200
# Kind, pattern, group whose length counts, least length. In order of report.
BASE = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
WEAK = (
    (
        "id",
        r"""(?i:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]+""",
        0,
        8,
    ),
    ("blob", r"[A-Za-z0-9+/]+", 0, 32),
    ("endpoint", r"[a-z][a-z0-9+]*://[A-Za-z0-9._~:@%-]+", 0, 9),
)
KINDS = tuple(k for k, *_ in BASE + WEAK)
# Part each kind plays in a credential.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "blob": "secret", "endpoint": "endpoint"}
# Runs of one character class are long enough or not: a cheap test finds texts with any.
QUICK = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "id": r"(?i:access_?key_?id|client_?id|user|login|account)",
    "blob": r"[A-Za-z0-9+/]{32}",
    "endpoint": r"://",
}


def _matches(kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of one kind with the gap before each, in order, failing ones included."""
    text = F.col("_text")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern)
    rows = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), judged.alias("j")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.length(x["g"]).alias("gap"),
            F.length(x["m"]).alias("len"),
            (F.length(x["j"]) >= least).alias("ok"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,len:int,ok:boolean>>")
    return F.when(text.rlike(QUICK[kind]), rows).otherwise(none)


def _placed(found: DataFrame) -> DataFrame:
    """(key, kind, start, end) of every match that counts, once per distinct key."""
    rows = (
        found.where(F.col("key").isNotNull())
        .dropDuplicates(["key"])
        .select("key", F.explode("found").alias("x"))
        .select("key", "x.*")
    )
    upto = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    end = F.sum((F.col("gap") + F.col("len")).cast("long")).over(upto)
    return (
        rows.withColumn("end", end)
        .where("ok")
        .select("key", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    )


def _role(kind: Column) -> Column:
    pairs = [F.lit(x) for k in ROLE for x in (k, ROLE[k])]
    return F.create_map(*pairs)[kind]


def linked(spans: DataFrame, scope: int) -> DataFrame:
    """Weak spans with a complementary part at most ``scope`` away, between their nearer ends.

    An identifier wants a secret, a secret an identifier or an endpoint, an endpoint a
    secret. A part lies in all cells of ``scope`` code points that it touches and meets what
    lies there and in both neighbouring cells, so a long text spreads over many join keys.
    """
    cell = lambda at: F.floor(at / scope)
    first, last = cell(F.col("start")), cell(F.col("end") - 1)
    parts = spans.withColumn("role", _role(F.col("kind")))
    weak = parts.where(F.col("kind").isin([k for k, *_ in WEAK]))
    weak = weak.withColumn("near", F.explode(F.sequence(first - 1, last + 1)))
    other = parts.select(
        F.col("key").alias("k2"),
        F.explode(F.sequence(first, last)).alias("c2"),
        F.col("start").alias("s2"),
        F.col("end").alias("e2"),
        F.col("role").alias("r2"),
    )
    complementary = (F.col("role") != F.col("r2")) & (
        (F.col("role") == "secret") | (F.col("r2") == "secret")
    )
    apart = (F.col("end") <= F.col("s2")) | (F.col("e2") <= F.col("start"))
    gap = F.greatest(F.col("s2") - F.col("end"), F.col("start") - F.col("e2"))
    hit = weak.join(
        other,
        (F.col("key") == F.col("k2"))
        & (F.col("near") == F.col("c2"))
        & (gap <= scope)
        & complementary
        & apart,
        "left_semi",
    )
    return hit.select("key", "kind", "start", "end").distinct()


def scan_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Secrets of every text; one output row per input row.

    Returns ``row`` (the input columns but the text), the counts ``n_assign``,
    ``n_access``, ``n_hex``, ``n_linked``, ``base`` and ``spans``: arrays of
    (start, rank, kind, end) in order of start, then kind as listed. A null or empty text
    has none. Equal texts have equal spans, so spans are placed once per distinct text.
    """
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    slim = docs.drop(text)
    rest = F.struct(*[F.col(f"`{c}`") for c in slim.columns]) if slim.columns else F.struct(F.lit(0))
    base = docs.select(rest.alias("row"), value.alias("_text"))
    found = F.concat(*[_matches(*x) for x in BASE + WEAK])
    base = base.withColumn("found", found).withColumn(
        "key", F.when(F.exists("found", lambda x: x["ok"]), F.sha2(F.col("_text"), 256))
    )
    found = keep(base.select("row", "key", "found"), "secrets-found")

    spans = keep(_placed(found), "secrets-spans")
    sure = spans.where(F.col("kind").isin([k for k, *_ in BASE]))
    shown = sure.unionByName(linked(spans, scope))
    rank = reduce(
        lambda a, k: a.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0)
    )
    item = F.struct("start", rank.alias("rank"), "kind", "end")
    per_key = shown.groupBy(F.col("key").alias("_key")).agg(F.sort_array(F.collect_list(item)).alias("spans"))
    # Texts in which nothing was found have no key, and are not joined.
    some = found.where(F.col("key").isNotNull()).select("row", "key")
    out = some.join(per_key, F.col("key") == F.col("_key"), "left").select("row", "spans")
    out = out.unionByName(found.where(F.col("key").isNull()).select("row", F.lit(None).alias("spans")))
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    out = out.select("row", F.coalesce("spans", empty).alias("spans"))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    return out.select(
        "row",
        "spans",
        F.filter("spans", lambda x: x["rank"] < len(BASE)).alias("base"),
        *[count(_is_kind(k)).alias(f"n_{k}") for k, *_ in BASE],
        count(lambda x: x["rank"] >= len(BASE)).alias("n_linked"),
    )


def _is_kind(kind: str):
    return lambda x: x["kind"] == kind


def written(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )


def redact(docs: DataFrame, text: str = "text", scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with each found span of the text replaced by ``mark``.

    Overlapping spans are joined first. Null texts stay null. The input must give equal
    rows on each read (a table does); it is read once for the scan and once to rewrite.
    """
    columns = docs.columns
    keyed = docs.select(whole(docs), F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256).alias("key"))
    distinct = docs.select(F.col(f"`{text}`").alias("text"))
    scanned = scan_secrets(
        distinct.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256)), "text", scope
    )
    hits = (
        scanned.where(F.size("spans") > 0)
        .select(F.col("row.key").alias("_key"), "spans")
        .dropDuplicates(["_key"])
    )
    done = keyed.join(hits, F.col("key") == F.col("_key"), "left")
    value = F.col(f"row.`{text}`")
    # Spans are in order of start; each gives the piece before it that no earlier one covers.
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rewritten = F.aggregate(
        "spans",
        zero,
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(
                x["start"] >= a["at"],
                F.concat(
                    a["out"],
                    F.substring(value, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")),
                    F.lit(mark),
                ),
            )
            .otherwise(a["out"])
            .alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(value, (a["at"] + 1).cast("int"), F.length(value))),
    )
    changed = F.when(F.col("spans").isNull(), value).otherwise(rewritten)
    return done.select(
        *[changed.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in columns]
    )
