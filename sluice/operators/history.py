"""Recall of similar past incidents by token overlap, and recurrence counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from sluice.session import ensure_checkpointing

WORD = "[a-z0-9_]+"
# Counts held at a time while texts are compared with the recent incidents.
CELLS = 8_000_000
# Rarest words of a text that give the first candidates of the search without look-back.
SEEDS = 3


def recent_history(history: DataFrame, recent: int) -> DataFrame:
    """The ``recent`` newest incidents: how far the recall looks back."""
    if recent < 1:
        raise ValueError("recent must be at least 1")
    return history.orderBy(F.desc("injected_at"), F.desc("incident_id")).limit(recent)


def tokens(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def similar_topk(queries: DataFrame, history: DataFrame, k: int = 3, recent: int = 200) -> DataFrame:
    """The ``k`` most similar recent incidents of each (query_id, text).

    Similarity is the Jaccard index of the token sets of the whole texts; incidents
    without a common token are left out, and ties go to the newer one. A null text has
    no matches.

    The look-back is bounded (``recent`` incidents), so its words become one table of words by
    incidents that every task has: no text, token or pair is shuffled, and a text's overlaps
    with all incidents are the sum of its words' rows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    newest = recent_history(history, recent).select(
        "injected_at",
        "incident_id",
        "failure_key",
        tokens(F.concat_ws(" ", "failure_key", F.coalesce("detail", F.lit("")))).alias("words"),
    )
    one = newest.agg(F.sort_array(F.collect_list(F.struct(*newest.columns)), asc=False).alias("past"))
    shared = queries.sparkSession.sparkContext.broadcast(_words_by_incident(one.first().past))
    asked = queries.where(F.col("text").isNotNull()).select("query_id", tokens(F.col("text")).alias("words"))
    kinds = dict(queries.dtypes) | dict(history.dtypes)
    return asked.mapInArrow(
        _closest(shared, k),
        f"query_id {kinds['query_id']}, rank int, incident_id {kinds['incident_id']}, "
        "failure_key string, overlap bigint, score double",
    )


def _words_by_incident(past: list[Row]) -> tuple[list, list, list[str], np.ndarray, np.ndarray]:
    """Ids, keys, known words, words by incidents (0 or 1), and words of each incident."""
    words = sorted({w for incident in past for w in incident.words})
    at = {w: i for i, w in enumerate(words)}
    held = np.zeros((len(words), len(past)), np.int32)
    for place, incident in enumerate(past):
        held[[at[w] for w in incident.words], place] = 1
    sizes = np.array([len(incident.words) for incident in past], np.int64)
    return [i.incident_id for i in past], [i.failure_key for i in past], words, held, sizes


def _closest(shared, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``k`` closest incidents of every row (query_id, words); the first one wins a tie."""

    def overlaps(lists: pa.Array, words: list[str], held: np.ndarray) -> np.ndarray:
        """Common words of each list and each incident."""
        flat = lists.flatten()
        found = pc.index_in(flat, value_set=pa.array(words, flat.type))
        known = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        places = found.take(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        ends = np.searchsorted(known, ends)
        out = np.zeros((len(lists), held.shape[1]), np.int64)
        step = max(1, CELLS // held.shape[1])
        begin = 0
        for row, end in enumerate(ends):
            for a in range(begin, end, step):
                out[row] += held[places[a : min(a + step, end)]].sum(axis=0)
            begin = end
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, words, held, sizes = shared.value
        for batch in batches:
            if not words:
                continue
            lists = batch.column(1)
            common = overlaps(lists, words, held)
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(invalid="ignore"):
                score = common / (n[:, None] + sizes[None, :] - common)
            best = np.argsort(np.where(common > 0, -score, np.inf), axis=1, kind="stable")[:, :k]
            row, rank = np.nonzero(np.take_along_axis(common, best, axis=1) > 0)
            place = best[row, rank]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    pa.array(rank + 1, pa.int32()),
                    pa.array([ids[i] for i in place]),
                    pa.array([keys[i] for i in place], pa.string()),
                    pa.array(common[row, place]),
                    pa.array(score[row, place]),
                ],
                names=["query_id", "rank", "incident_id", "failure_key", "overlap", "score"],
            )

    return run


def similar_topk_whole(
    queries: DataFrame, history: DataFrame, k: int = 3, min_score: float = 0.0
) -> DataFrame:
    """The ``k`` most similar incidents of each (query_id, text) in the whole history.

    Same similarity, ties and result as ``similar_topk``, without a look-back; only
    incidents with at least ``min_score`` count. ``query_id`` and ``incident_id`` are
    unique.

    A prefix-filtered join, exact for any texts. Words are ordered from rare to
    frequent. Incidents that share one of a text's ``SEEDS`` rarest words are scored
    first; the k-th best of them bounds what a better one must reach. Sets of n and m
    words with that similarity overlap in at least ``need`` words, so they share one
    among their first n - need + 1 and m - need + 1: frequent words meet only where
    the bound is weak. Every pair left is checked on the whole sets.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    ensure_checkpointing(queries.sparkSession)
    label = F.concat_ws(" ", "failure_key", F.coalesce("detail", F.lit("")))
    past = history.select("incident_id", "failure_key", "injected_at", tokens(label).alias("words"))
    frequency = past.select(F.explode("words").alias("text")).groupBy("text").agg(F.count("*").alias("df"))
    # From here on a word is a number: sets of numbers meet several times faster than sets of texts.
    frequency = frequency.withColumn("word", F.monotonically_increasing_id()).checkpoint()

    def rare_first(texts: DataFrame, key: str) -> DataFrame:
        """Words the history knows with their place; unknown ones are rarer than all."""
        known = (
            texts.select(key, F.size("words").alias("size"), F.explode("words").alias("text"))
            .join(frequency, "text")
            .groupBy(key, "size")
            .agg(F.sort_array(F.collect_list(F.struct("df", "text", "word"))).alias("ranked"))
        )
        return known.select(key, "size", F.col("ranked.word").alias("known")).checkpoint()

    asked = queries.where(F.col("text").isNotNull()).select("query_id", tokens(F.col("text")).alias("words"))
    asked = rare_first(asked, "query_id")
    found = rare_first(past, "incident_id").join(past.drop("words"), "incident_id").checkpoint()

    def placed(rows: DataFrame, *keys: str) -> DataFrame:
        places = rows.select(*keys, "size", "known", F.posexplode("known").alias("at", "word"))
        return places.withColumn("at", F.col("at") + F.col("size") - F.size("known")).drop("known")

    postings = placed(found, "incident_id").withColumnsRenamed({"size": "m", "at": "past_at"})

    def checked(pairs: DataFrame) -> DataFrame:
        """Exact scores, the ``k`` best of each text."""
        sides = pairs.join(asked.withColumnsRenamed({"size": "n", "known": "mine"}), "query_id").join(
            found.withColumnsRenamed({"size": "m", "known": "theirs"}), "incident_id"
        )
        overlap = F.size(F.array_intersect("mine", "theirs")).cast("bigint")
        scored = sides.withColumn("overlap", overlap).select(
            "query_id",
            "incident_id",
            "failure_key",
            "injected_at",
            "overlap",
            (F.col("overlap") / (F.col("n") + F.col("m") - F.col("overlap"))).alias("score"),
        )
        order = Window.partitionBy("query_id").orderBy(
            F.desc("score"), F.desc("injected_at"), F.desc("incident_id")
        )
        enough = scored.where(F.col("score") >= min_score).withColumn("rank", F.row_number().over(order))
        return enough.where(F.col("rank") <= k)

    # The rarest words that the history knows.
    seeds = asked.select("query_id", F.explode(F.slice("known", 1, SEEDS)).alias("word"))
    first = checked(seeds.join(postings, "word").select("query_id", "incident_id").distinct())
    reached = first.groupBy("query_id").agg(
        F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(min_score)).alias("bound")
    )
    bounded = asked.join(reached, "query_id", "left").withColumn(
        "bound", F.coalesce("bound", F.lit(float(min_score)))
    )
    bounded = bounded.checkpoint()

    def need(size: Column) -> Column:
        # A little slack for rounding: a smaller need only lengthens the prefix.
        return F.ceil(size - F.lit(1e-9))

    # The shortest need, that of an incident with as few words as the bound allows,
    # cuts the text's words before the join; the pair's own need inside it.
    least = F.greatest(F.lit(1), need(F.col("bound") * F.col("size")))
    mine = placed(bounded.withColumn("least", least), "query_id", "bound", "least")
    mine = mine.where(F.col("at") <= F.col("size") - F.col("least"))
    both = F.greatest(
        F.lit(1), need(F.col("bound") / (1 + F.col("bound")) * (F.col("size") + F.col("m")))
    )
    pairs = (
        mine.join(postings, "word")
        .where(F.col("m") >= F.col("bound") * F.col("size") - 1e-9)
        .where(F.col("m") * F.col("bound") <= F.col("size") + 1e-9)
        .where((F.col("at") <= F.col("size") - both) & (F.col("past_at") <= F.col("m") - both))
        .select("query_id", "incident_id")
        .distinct()
    )
    return checked(pairs).select("query_id", "rank", "incident_id", "failure_key", "overlap", "score")


def recurrence(queries: DataFrame, history: DataFrame, recent: int = 200) -> DataFrame:
    """How often the best match's failure key occurs in the recent history."""
    best = similar_topk(queries, history, 1, recent).select("query_id", "failure_key", "score")
    seen = recent_history(history, recent).groupBy("failure_key").agg(
        F.count("*").alias("times_seen")
    )
    return best.join(seen, "failure_key").select("query_id", "failure_key", "times_seen", "score")
