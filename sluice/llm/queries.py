"""The registered queries of the text operators: their production parameters, whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import (
    classifier,
    decontaminate,
    importance,
    language,
    licenses,
    middle,
    mixing,
    quality,
    secrets,
    simhash,
    suffixes,
    tokens,
    urls,
)
from sluice.llm.common import table

# Folder of public vocabulary files, and the file whose pieces are used.
TOKENIZERS = os.environ.get("SLUICE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "piece_bpe_32k.model"


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    fingerprint = F.lower(F.lpad(F.hex(F.get("fp", F.lit(0))), 16, "0"))
    return classes.select(F.col("id").alias("doc_id"), fingerprint.alias("fingerprint"), "component_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "row.doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
        "n_linked",
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_rows(table(spark, sf_dir, "labels"))
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), trusted)
    return judged.select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "score",
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = tokens.zipf_scores(tokens.load_pieces(os.path.join(TOKENIZERS, VOCABULARY)))
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), scores)
    return counted.select("row.doc_id", "n_tokens", "n_pre_tokens")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    judged = decontaminate.judged(found)
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["length"])), F.lit(0))
    return judged.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        longest.cast("long").alias("longest_match"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "row.doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: x["name"]), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("licenses", lambda x: x["containment"])), F.lit(0.0)).alias(
            "containment"
        ),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select(
        "row.doc_id",
        language.held_out(F.col("row.doc_id")).alias("held_out"),
        F.col("lang").alias("lang_pred"),
        "score",
        F.size("spans").cast("long").alias("n_spans"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages"))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.classify(docs, model).select(
        "row.doc_id",
        classifier.held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted"),
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("row.doc_id", "n_features", "weight", "score", "rank")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "row.doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_secret_scan,
        op3_quality_rules,
        op4_mix_sources,
        op5_token_counts,
        op6_decontaminate,
        op7_license_scan,
        op8_language_id,
        op9_url_filter,
        op10_suffix_dedup,
        op11_quality_classifier,
        op12_importance_resampling,
        op13_fill_in_middle,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op6_decontaminate": r"""
WITH texts AS (
  SELECT row_number() OVER () AS n, 'd' AS side, doc_id, NULL AS item, text FROM documents
  UNION ALL SELECT NULL, 'b', NULL, coalesce(item_id::VARCHAR, ''), text FROM benchmark
), worded AS (
  SELECT n, side, doc_id, item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), item_windows AS (
  SELECT item, size, s, array_to_string(w[s:s + size - 1], ' ') AS words
  FROM (SELECT item, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s
    FROM worded WHERE side = 'b' AND len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT n, size, p, array_to_string(w[p:p + size - 1], ' ') AS words
  FROM (SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS p
    FROM worded, sizes WHERE side = 'd' AND len(w) >= size)
), hits AS (
  SELECT DISTINCT n, item, size, s, p FROM doc_windows JOIN item_windows USING (size, words)
), covered AS (
  SELECT n, count(*) AS n_hit
  FROM (SELECT DISTINCT n, p + unnest(range(size)) AS place FROM (SELECT DISTINCT n, p, size FROM hits))
  GROUP BY n
), runs AS (
  -- Consecutive hits on one diagonal are one longer match.
  SELECT n, max(size) + count(*) - 1 AS words
  FROM (SELECT *, p - row_number() OVER (PARTITION BY n, item, size, p - s ORDER BY p) AS run FROM hits)
  GROUP BY n, item, size, p - s, run
), longest AS (
  SELECT n, max(words) AS longest FROM runs GROUP BY n
), found AS (
  SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT n, item FROM hits) GROUP BY n
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated,
  coalesce(longest, 0)::BIGINT AS longest_match
FROM worded LEFT JOIN covered USING (n) LEFT JOIN longest USING (n) LEFT JOIN found USING (n)
WHERE side = 'd'
""",
    "op12_importance_resampling": r"""
WITH polynomial AS (
  -- The table of the byte-wise checksum, from its polynomial.
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, j:
    CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS steps
), texts AS (
  SELECT row_number() OVER () AS n, doc_id, 'd' AS side, text FROM documents
  UNION ALL SELECT NULL, NULL, 'b', text FROM benchmark
), words AS (
  SELECT n, doc_id, side, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM texts
), distinct_words AS (
  SELECT DISTINCT word FROM words
), placed AS (
  SELECT word, xor(list_reduce(
    [4294967295] || list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: ('0x' || x)::BIGINT),
    lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM distinct_words, polynomial
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
  FROM words JOIN placed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counts
), sums AS (
  SELECT n, count(*) AS n_features, sum(gain)::BIGINT AS total
  FROM words JOIN placed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY n
), weighed AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features,
    coalesce(floor(total::DOUBLE / n_features), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM texts d LEFT JOIN sums USING (n) WHERE side = 'd'
), scored AS (
  SELECT doc_id, n_features, weight,
    weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score
  FROM weighed
), drawn AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS wanted
  FROM scored
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= wanted THEN place END::BIGINT AS rank
FROM drawn
""",
    "op13_fill_in_middle": """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n,
    ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a,
    ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3,
    ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4
  FROM cut
), parts AS (
  SELECT doc_id, t, n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90
      THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(array_to_string(u[1:least(a, b)], ''), '') AS prefix,
    coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
    coalesce(array_to_string(u[greatest(a, b) + 1:n], ''), '') AS suffix
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
""",
}
