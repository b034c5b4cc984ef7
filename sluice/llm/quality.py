"""Quality rules: repetition measures and a hashed n-gram likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are compared: one of trusted
target texts, one of the raw corpus. A text's score is the mean log ratio of its n-grams,
so that long and short texts are held against the same threshold. The raw counts come
from every text, the target counts from every trusted one. The threshold is cross-fitted: each
half of the trusted texts is scored with the counts of the other half, which has not seen it, and
its medians are exact ones of all their scores. The model has a fixed number of buckets and
reaches the rows as a scalar subquery. All of it is built-in expressions inside one row; bucket
counts and scores are shuffled, and texts only where the trusted keys are too many to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.ranking import percentiles
from sluice.llm.common import keep, whole, words

BUCKETS = 65536
# Occurrences added to what a bucket has in the target, and to what it would have there if the
# target were like the corpus. So a bucket seen a few times says little either way, and one that
# is common in the corpus and absent from the target says much.
EVIDENCE = 1.0
# Robust standard deviations below the median score of unseen trusted texts, at which a text
# counts as unlike the target.
DEVIATIONS = 5.0
WHOLE = {"byte", "short", "integer", "long"}
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
BLANKS = " \t\n\x0b\x0c\r"


def _buckets(hashes: Column, buckets: int) -> Column:
    """Buckets of all word unigrams and bigrams of an array of word hashes."""
    size = F.lit(buckets)
    ones = F.transform(hashes, lambda h: F.pmod(h, size).cast("int"))
    pairs = F.transform(
        F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))),
        lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i), h), size).cast("int"),
    )
    return F.concat(ones, pairs)


def hashed(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``row`` plus ``words``, ``hashes`` and ``grams`` of every text."""
    step = df.select(whole(df), words(F.col(text)).alias("words"))
    step = step.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    return step.withColumn("grams", _buckets(F.col("hashes"), buckets))


def trusted_texts(
    docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS
) -> DataFrame:
    """``id``, ``half`` (0 or 1, by a hash of the key), ``n`` words and ``grams`` of every trusted row.

    Whole-number keys meet as bitmaps, a bit per key where keys are dense, so that texts need not
    be shuffled to find the trusted ones. Other keys, and bitmaps too large to broadcast, are joined
    as they are.
    """
    ids = trusted.select(F.col(f"`{key}`").alias("id")).where(F.col("id").isNotNull()).distinct()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("body"))
    if {rows.schema["key"].dataType.typeName(), ids.schema["id"].dataType.typeName()} <= WHOLE:
        places = ids.select(F.bitmap_bucket_number("id").alias("b"), F.bitmap_bit_position("id").alias("bit"))
        maps = places.groupBy("b").agg(F.bitmap_construct_agg("bit").alias("bits"))
        # Written, so that its true size decides how it is joined.
        maps = keep(maps, "quality-trusted")
        met = rows.join(maps, F.bitmap_bucket_number("key") == F.col("b"))
        bit = F.bitmap_bit_position("key")
        octet = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        picked = met.where(octet.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(key) % 8 AS INT))")) != 0)
    else:
        picked = rows.join(ids, F.col("key") == F.col("id"))
    found = hashed(picked.select(F.col("key").alias("id"), "body"), "body", buckets)
    half = F.pmod(F.xxhash64("row.id", F.lit(1)), F.lit(2))
    return found.select("row.id", half.alias("half"), F.size("words").alias("n"), "grams")


def ratios(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row: the log ratios of every bucket, target to raw, 0 where unseen.

    ``target`` comes from ``trusted_texts`` over the same rows. ``ratios`` is made of all trusted
    texts, ``without_0`` and ``without_1`` each of one half only. Without any trusted text all are 0.
    """
    # The outer form: the optimizer would else test each array's size by making it twice.
    raw = hashed(docs, text, buckets).select(F.explode_outer("grams").alias("b"))
    raw = raw.where(F.col("b").isNotNull()).groupBy("b").agg(F.count("*").alias("raw"))
    halves = target.select(F.explode("grams").alias("b"), "half").groupBy("b").agg(
        F.count_if(F.col("half") == 0).alias("t0"), F.count_if(F.col("half") == 1).alias("t1")
    )
    none = F.lit(0).cast("bigint")
    counts = raw.join(halves, "b", "left").select(
        "b", "raw", F.coalesce("t0", none).alias("t0"), F.coalesce("t1", none).alias("t1")
    )
    everything = Window.partitionBy()
    n_raw = F.sum("raw").over(everything)

    def ratio(target: Column) -> Column:
        n = F.sum(target).over(everything)
        like = F.ln((target + EVIDENCE) / (F.col("raw") * (n / n_raw) + EVIDENCE))
        return F.when(n > 0, like).otherwise(0.0)

    t0, t1 = F.col("t0"), F.col("t1")
    seen = counts.select(
        "b", ratio(t0 + t1).alias("ratios"), ratio(t1).alias("without_0"), ratio(t0).alias("without_1")
    )
    names = seen.columns[1:]
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    dense = every.join(seen, "b", "left").select("b", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("b", c))), lambda x: x[c])
    return dense.agg(*[in_order(c).alias(c) for c in names])


def _score(grams: str, ratios: str) -> Column:
    total = F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(F.col(ratios), b))
    return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(0.0)


def threshold(target: DataFrame, model: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """One row with ``t``: the median minus ``deviations`` robust deviations of trusted scores.

    Each trusted text of 50 words or more is scored without its own half; rows that share a key
    count once, with the least score. A robust deviation is 1.4826 times the median distance from
    the median. Both medians are exact. Null or no row where there are fewer than two.
    """
    scored = target.where(F.col("n") >= MIN_WORDS)
    for name in ("without_0", "without_1"):
        scored = scored.withColumn(name, model.select(name).scalar())
    own = F.when(F.col("half") == 0, _score("grams", "without_0")).otherwise(_score("grams", "without_1"))
    least = scored.select("id", own.alias("s")).groupBy("id").agg(F.min("s").alias("s"))
    least = keep(least.select(F.lit(0).alias("all"), "s"), "quality-scores")
    middle = keep(percentiles(least, ["all"], "s", {"m": 0.5}), "quality-median")
    away = least.select("all", F.abs(F.col("s") - middle.select("m").scalar()).alias("away"))
    spread = percentiles(away, ["all"], "away", {"d": 0.5}).select("all", "d")
    t = F.col("m") - deviations * 1.4826 * F.col("d")
    return middle.join(spread, "all").select(F.when(F.col("n") > 1, t).alias("t"))


def repeated_words(hashes: Column) -> tuple[Column, Column]:
    """Sorted (hash, place) pairs of all three-word windows, and how to count from them.

    Returns the sort to store as a column ``sorted``, and an expression over ``sorted``:
    the number of words that lie in a window found twice or more.
    """
    windows = F.transform(
        F.slice(hashes, 3, F.greatest(F.size(hashes) - 2, F.lit(0))),
        lambda h, i: F.struct(
            F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), h).alias("h"), i.alias("i")
        ),
    )
    both = F.col("sorted")
    twice = F.filter(
        both,
        lambda x, i: F.coalesce(F.get(both, i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(both, i + 1)["h"] == x["h"], F.lit(False)),
    )
    return F.sort_array(windows), F.sort_array(F.transform(twice, lambda x: x["i"]))


def measures(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``row``, the base measures and ``grams`` of every text.

    A null or empty text has no words, and all its counts are 0. Texts may be of any
    length; a row's work is its word count times a logarithm.
    """
    step = hashed(df, text, buckets)
    value = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    ordered, places = repeated_words(F.col("hashes"))
    step = step.withColumn("sorted", ordered).withColumn("places", places)
    lines = F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumn("lines", lines)
    gap = F.transform(
        "places",
        lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("places"), i + 1) - p, F.lit(3))),
    )
    without = lambda drop: F.length(F.translate(value, drop, ""))
    return step.select(
        "row",
        "grams",
        F.size("words").cast("long").alias("n_words"),
        without(BLANKS).cast("long").alias("word_chars"),
        (F.length(value) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(gap, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
    )


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    deviations: float = DEVIATIONS,
) -> DataFrame:
    """Judge every text; one output row per input row.

    ``trusted`` holds the keys of trusted texts. Returns ``row`` (all input columns), the
    base measures, ``base_failed``, ``score`` (mean log ratio; 0 without n-grams) and
    ``kept``: false where a base rule fails or the score is below ``threshold``; without
    enough trusted texts for a threshold the base rules alone decide. Null and
    empty texts fail the word-count rule. Rows with a repeated or null key are judged each
    on their own text.
    """
    target = keep(trusted_texts(docs, trusted, key, text, buckets), "quality-target")
    model = keep(ratios(docs, target, text, buckets), "quality-model")
    least = keep(threshold(target, model, deviations), "quality-threshold")
    out = measures(docs, text, buckets).withColumn("ratios", model.select("ratios").scalar())
    mean = _score("grams", "ratios")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("score", mean).withColumn("base_failed", failed)
    return out.drop("grams", "ratios").withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= least.scalar(), F.lit(True))
    )


def trusted_rows(labels: DataFrame) -> DataFrame:
    """Keys labelled as good and never as bad or toxic."""
    judged = labels.groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    return judged.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
