"""Benchmark decontamination with training suffix arrays.

Every Arrow batch of documents is a shard. Its words become numbers of the benchmark's
vocabulary (0 for any other word), and the suffixes that start like some test suffix are
sorted into a suffix array. Each test suffix is binary-searched in every shard. Where its
range is not empty, the longest verbatim matches of its item are followed along the shard,
with their places in both texts. A document is judged within its own task, so nothing is
shuffled.

Equal windows are searched once, and an item's matches are followed from left to right, each
from the first window that no earlier match of the item holds. So a shard needs memory for
its words and the benchmark's only, also where both repeat one word.

The benchmark is the stated query set. It is taken in blocks of bounded text, each
broadcast and matched against all documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import keep, whole

WINDOW = 13
# Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 4_000_000
# Document bytes in one shard: bounds the suffix array, never splits a document.
SHARD_BYTES = 8_000_000
# First words a document suffix must share with a test suffix to enter the array.
LEAD = 3
# Windows looked ahead at a time, and compared at a time, in following a match.
AHEAD = 1024
COMPARED = 1 << 16

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
MATCH = "array<struct<item:string,item_start:int,doc_start:int,length:int>>"


def split_words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of all non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class TestSuffixes:
    """Numbered words and windows of one block of the benchmark."""

    def __init__(self, items: Iterable[tuple[str, str]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        rows, item, start, length = [], [], [], []
        for name, text in items:
            words = split_words(text)
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1):
                rows.append(ids[at : at + size] + [0] * (window - size))
                item.append(len(self.names))
                start.append(at)
                length.append(size)
            self.names.append(name)
        rows = np.array(rows, dtype=np.int64).reshape(-1, window)
        length = np.array(length, dtype=np.int64)
        self.item = np.array(item, dtype=np.int64)
        self.start = np.array(start, dtype=np.int64)
        self.lead = int(min(LEAD, length.min())) if len(rows) else LEAD
        self.leads = np.unique(_packed(rows[:, : self.lead]))
        # Equal windows are one: ``number`` says which, for each window of the items in order.
        self.low, first, self.number = np.unique(_bytes_of(rows), return_index=True, return_inverse=True)
        self.length = length[first]
        # The end of a short window's range: everything that starts with it.
        past = rows[first]
        past[np.arange(window)[None, :] >= self.length[:, None]] = 2**32 - 1
        self.past = _bytes_of(past)
        # Where the windows of each item begin.
        self.begins = np.searchsorted(self.item, np.arange(len(self.names) + 1))

    def __len__(self) -> int:
        return len(self.item)


def _packed(columns: np.ndarray) -> np.ndarray:
    """Up to three word numbers below 2**21 in one integer."""
    out = np.zeros(len(columns), np.int64)
    for i in range(columns.shape[1]):
        out = (out << 21) | columns[:, i]
    return out


def _bytes_of(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort like the rows."""
    wide = np.ascontiguousarray(rows.astype(">u4"))
    return wide.view(f"S{4 * rows.shape[1]}").ravel()


def suffix_array(ids: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shard's suffixes that may match, in suffix order, and their prefixes."""
    lead = tests.lead
    padded = np.concatenate((ids, np.zeros(tests.window, np.int64)))
    code = np.zeros(len(ids), np.int64)
    for i in range(lead):
        code = (code << 21) | padded[i : i + len(ids)]
    near = np.minimum(np.searchsorted(tests.leads, code), len(tests.leads) - 1)
    places = np.flatnonzero((tests.leads[near] == code) & (ids > 0))
    prefixes = _bytes_of(padded[places[:, None] + np.arange(tests.window)])
    order = np.argsort(prefixes, kind="stable")
    return places[order], prefixes[order]


def matches(ids: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, ...]:
    """Longest verbatim matches in a shard: item, its first word, place, number of words.

    Sorted by item and place. Every window of an item that occurs in the shard is inside one of
    the item's matches.
    """
    none = (np.zeros(0, np.int64),) * 4
    if not len(tests) or not len(ids):
        return none
    places, prefixes = suffix_array(ids, tests)
    low = np.searchsorted(prefixes, tests.low, "left")
    high = np.searchsorted(prefixes, tests.past, "right")
    seen = high > low
    if not seen.any():
        return none
    # The full window that begins at each place, if any; one place more ends the last match.
    at = np.full(len(ids) + 1, -1, np.int64)
    for number in np.flatnonzero(seen & (tests.length == tests.window)).tolist():
        at[places[low[number] : high[number]]] = number
    parts = []
    for item in np.unique(tests.item[seen[tests.number]]).tolist():
        windows = tests.number[tests.begins[item] : tests.begins[item + 1]]
        hit = np.unique(windows[seen[windows]])
        where = np.sort(np.concatenate([places[low[n] : high[n]] for n in hit.tolist()]))
        size = tests.length[windows[0]]
        if size < tests.window:
            start, place, length = np.zeros_like(where), where, np.full_like(where, size)
        else:
            start, place, length = _follow(windows, at, where)
            length += tests.window - 1
        parts.append((np.full_like(place, item), start, place, length))
    return tuple(np.concatenate(column) for column in zip(*parts))


def _follow(windows: np.ndarray, at: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, ...]:
    """(window of the item, place, number of windows) of an item's longest matches.

    ``windows`` are the item's in order, ``at`` those of the shard and ``where`` the sorted
    places of the item's windows there. Of all windows of the item equal to that at a place,
    those are kept that agree longest with the shard; of several the first.
    """
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    if (ranked[1:] != ranked[:-1]).all():
        # Each place has one window of the item: matches are what runs on in both texts.
        start = order[np.searchsorted(ranked, at[where])]
        goes_on = (np.diff(where) == 1) & (np.diff(start) == 1)
        first = np.flatnonzero(np.concatenate(([True], ~goes_on)))
        return start[first], where[first], np.diff(np.concatenate((first, [len(where)])))
    ended = np.concatenate((windows, np.full(AHEAD, -2)))
    found, i = [], 0
    while i < len(where):
        place, n, width, best = int(where[i]), 0, 0, 0
        a = np.searchsorted(ranked, at[place], "left")
        b = np.searchsorted(ranked, at[place], "right")
        starts = order[a:b]
        while best == width:
            ahead = at[place + n : place + n + max(1, min(AHEAD, COMPARED // len(starts)))]
            width = len(ahead)
            same = ended[starts[:, None] + (n + np.arange(width))] == ahead
            alike = np.where(same.all(axis=1), width, same.argmin(axis=1))
            best = int(alike.max())
            starts = starts[alike == best]
            n += best
        found.append((int(starts[0]), place, n))
        i = int(np.searchsorted(where, place + n, "left"))
    start, place, length = np.array(found, dtype=np.int64).T
    return start, place, length


def _shards(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into shards of bounded text; a longer document is a shard of its own."""
    for batch in batches:
        column = batch.column(text)
        sizes = np.array([len(x) if x else 0 for x in column.to_pylist()], dtype=np.int64)
        at, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > SHARD_BYTES:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        yield batch.slice(at)


def _judge(tests: TestSuffixes, texts: list, before: pa.StructArray) -> pa.StructArray:
    """``before`` with the word counts of a shard's texts, and their matches added."""
    number = tests.vocabulary.get
    parts = []
    for text in texts:
        # One stop between documents, so that no match crosses them.
        parts.append(np.array([number(w, 0) for w in split_words(text)] + [0], dtype=np.int64))
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    del parts
    item, item_start, place, length = matches(ids, tests)
    owner = np.searchsorted(begins, place, "right") - 1
    old = before.field("found")
    kind = old.type.value_type
    made = pa.StructArray.from_arrays(
        [
            pa.array(tests.names, pa.string()).take(pa.array(item)),
            pa.array(item_start, pa.int32()),
            pa.array(place - begins[owner], pa.int32()),
            pa.array(length, pa.int32()),
        ],
        fields=list(kind),
    )
    had = np.diff(old.offsets.to_numpy())
    owners = np.concatenate((np.repeat(np.arange(len(texts)), had), owner))
    order = np.argsort(owners, kind="stable")
    values = pa.concat_arrays([old.flatten(), made]).take(pa.array(order))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=len(texts)))))
    found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=old.type)
    return pa.StructArray.from_arrays([pa.array(sizes - 1, pa.int32()), found], fields=list(before.type))


def benchmark_blocks(items: DataFrame, key: str, text: str, size: int) -> Iterator[list]:
    """The benchmark in blocks of at most ``size`` characters (one item at least)."""
    block, held = [], 0
    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t"))
    for row in rows.where(F.col("t").isNotNull()).toLocalIterator():
        if block and held + len(row.t) > size:
            yield block
            block, held = [], 0
        block.append((row.k, row.t))
        held += len(row.t)
    yield block


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``row``, ``n_words`` and ``matches`` of every document; one output row per input row.

    A match is the longest run of words that a document and an item share from a place on, if
    it holds a window: ``window`` consecutive item words, or the whole item if it is shorter.
    An item's matches are taken from left to right, each from the first window that no earlier
    one holds, so every window of the item in the document is inside one of them. Null and
    empty texts and items have no words and match nothing. An item with a null key counts
    under the empty key; items that share a key are one item.
    """
    start = F.struct(F.lit(0).alias("n"), F.array().cast(MATCH).alias("found"))
    state = docs.select(whole(docs), F.col(f"`{text}`").alias("body"), start.alias("so_far"))
    schema = state.schema
    blocks = benchmark_blocks(benchmark, item_key, item_text, block_bytes)
    block = next(blocks)
    while block is not None:
        # Sent with the task's code; Spark broadcasts that once it is large.
        suffixes = TestSuffixes(block, window)

        def run(batches, tests=suffixes):
            for shard in _shards(batches, 1):
                judged = _judge(tests, shard.column(1).to_pylist(), shard.column(2))
                yield pa.RecordBatch.from_arrays(
                    [shard.column(0), shard.column(1), judged], names=["row", "body", "so_far"]
                )

        state = state.mapInArrow(run, schema)
        block = next(blocks, None)
        if block is not None:
            state = keep(state, "decontaminate-block")
    return state.select(
        "row", F.col("so_far.n").cast("long").alias("n_words"), F.col("so_far.found").alias("matches")
    )


def judged(found: DataFrame) -> DataFrame:
    """Add ``n_hit``, ``items`` (sorted) and ``contaminated`` to matches.

    A word is hit if any match covers it; a document is contaminated if a twentieth of its
    words is.
    """
    spans = F.sort_array(
        F.transform(
            "matches",
            lambda m: F.struct(m["doc_start"].alias("s"), (m["doc_start"] + m["length"]).alias("e")),
        )
    )
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        spans,
        zero,
        lambda a, x: F.struct(
            F.greatest(a["upto"], x["e"]).alias("upto"),
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["upto"], x["s"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    out = found.withColumn("n_hit", covered).withColumn(
        "items", F.sort_array(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    )
    return out.withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept."""
    clean = judged(find_matches(docs, benchmark, text)).where(~F.col("contaminated"))
    return clean.select("row.*")
