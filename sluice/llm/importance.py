"""Importance resampling towards a target distribution of hashed word n-grams.

A text's weight is the mean log ratio of its n-grams between a target corpus and the raw one,
both as counts in a fixed number of buckets. Gumbel noise from a digest of the key turns "the
highest scores" into a draw in proportion to the weights, without replacement.

Texts are handled a batch at a time: the batch is joined with separators, one regular
expression finds the words of all its texts, a search among the texts' offsets tells whose
each word is, n-grams across two texts are masked, and the rest are counted. Bucket counts are
summed in the task before they are shuffled. Scores are whole numbers from a bounded range,
so the cut and every rank come from one count per score, and no global sort is needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import keep, whole

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
# Per cent of the long enough texts that are drawn.
SHARE = 10
SEED = 2024
# Bytes of text joined at a time: bounds memory, a longer text makes a piece of its own.
PIECE_BYTES = 4_000_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# No word holds it, so joined texts never share one.
SEPARATOR = b"\x00"


def features(texts: list[bytes], longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text number and bucket of every n-gram of a batch, one pair of arrays per length."""
    joined = SEPARATOR.join(texts).translate(_LOWER)
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.cumsum(sizes + 1) - (sizes + 1)
    spans = [m.span() for m in _WORD.finditer(joined)]
    words = [joined[a:b] for a, b in spans]
    starts = np.fromiter((a for a, _ in spans), np.int64, len(spans))
    owner = np.searchsorted(offsets, starts, "right") - 1
    codes = list(map(crc32, words))
    for n in range(1, longest + 1):
        if n > 1:
            # The checksum of an n-gram continues that of the one a word shorter.
            codes = [crc32(w, crc32(b" ", c)) for c, w in zip(codes, words[n - 1 :])]
        last = len(words) - n + 1
        if last <= 0:
            return
        inside = owner[:last] == owner[n - 1 :]
        found = np.array(codes[:last], np.int64) % buckets
        yield owner[:last][inside], found[inside]


def _pieces(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a batch as bytes, in order, in lists of bounded size."""
    held, size = [], 0
    for text in texts.to_pylist():
        value = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(value) > PIECE_BYTES:
            yield held
            held, size = [], 0
        held.append(value)
        size += len(value)
    if held:
        yield held


def bucket_counts(docs: DataFrame, text: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n`` of every bucket that some n-gram of the texts falls into."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in _pieces(batch.column(0)):
                for _, found in features(piece, longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int32()), pa.array(total[seen])], names=["bucket", "n"]
        )

    counted = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "bucket int, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of every bucket, add-one smoothed, rounded down.

    The two tables are bucket counts, so at most ``buckets`` rows reach the driver.
    """
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t"))
    )
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    counts = np.zeros((2, buckets))
    for r in rows:
        counts[:, r.bucket] = r.s, r.t
    s, t = counts
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(
    docs: DataFrame, gain: np.ndarray, text: str = "text", longest: int = LONGEST
) -> DataFrame:
    """``row`` (the input columns but the text), ``n_words``, ``n_features`` and ``weight``."""
    buckets = len(gain)
    slim = docs.drop(text)
    rest = whole(slim) if slim.columns else F.struct(F.lit(0)).alias("row")
    pairs = docs.select(rest, F.col(f"`{text}`").cast("string").alias("body"))

    def run(batches):
        for batch in batches:
            out = []
            for piece in _pieces(batch.column(1)):
                counts = np.zeros((3, len(piece)), np.int64)
                for n, (owner, found) in enumerate(features(piece, longest, buckets)):
                    each = np.bincount(owner, minlength=len(piece))
                    counts[0] += each if n == 0 else 0
                    counts[1] += each
                    np.add.at(counts[2], owner, gain[found])
                out.append(counts)
            words, size, total = np.concatenate(out, axis=1)
            mean = np.where(size > 0, total // np.maximum(size, 1), 0)
            columns = [pa.array(x, pa.int64()) for x in (words, size, mean)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], names=["row", "n_words", "n_features", "weight"]
            )

    schema = pairs.select("row").schema
    for name in ("n_words", "n_features", "weight"):
        schema = schema.add(name, "long")
    return pairs.mapInArrow(run, schema)


def ranked(scored: DataFrame, share: int = SHARE) -> DataFrame:
    """Add ``rank``: 1, 2, 3 ... for the highest scores of the rows that ``may`` be drawn.

    Scores are bounded whole numbers, so there are few of them, whatever the number of rows.
    The rows of one score take their places by ``place``; rows alike in that too are alike.
    """
    may = scored.where("may")
    per_score = keep(may.groupBy("score").agg(F.count("*").alias("c")), "importance-scores")
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    cut = per_score.select(
        F.col("score").alias("at"),
        F.coalesce(F.sum("c").over(above), F.lit(0)).alias("before"),
        F.floor(F.sum("c").over(total) * share / 100).cast("bigint").alias("wanted"),
    ).where("before < wanted")
    met = (F.col("score") == F.col("at")) & F.col("may")
    joined = scored.join(F.broadcast(cut), met, "left")
    inside = Window.partitionBy("score").orderBy("place")
    drawn = joined.where(F.col("at").isNotNull()).withColumn(
        "rank", (F.col("before") + F.row_number().over(inside)).cast("bigint")
    )
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= F.col("wanted"), F.col("rank")))
    others = joined.where(F.col("at").isNull()).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(others).drop("at", "before", "wanted")


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    share: int = SHARE,
    seed: int = SEED,
) -> DataFrame:
    """``row`` (the input columns but the text), ``n_features``, ``weight``, ``score``, ``rank``.

    One output row per input row. Of the texts with ``least_words`` words or more, ``share`` per
    cent with the highest scores are drawn and ranked, ties to the smaller key (null first);
    others have a null rank. A null or empty text has no features and weight 0. A null key draws
    its noise like an empty one. Repeated rows count and are drawn each on their own. An empty
    target or an empty corpus is smoothed like any other. Extra columns may have any name.
    ``target`` has the column ``text`` too.
    """
    raw = bucket_counts(docs, text, longest, buckets)
    gain = gains(raw, bucket_counts(target, text, longest, buckets), buckets)
    found = weighed(docs, gain, text, longest)
    name = F.coalesce(F.col(f"row.`{key}`").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = found.withColumn("score", F.col("weight") + noise.cast("bigint"))
    scored = keep(scored.withColumn("may", F.col("n_words") >= least_words), "importance-scored")
    placed = scored.withColumn("place", F.struct(F.col(f"row.`{key}`"), "n_features"))
    return ranked(placed, share).select("row", "n_words", "n_features", "weight", "score", "rank")
