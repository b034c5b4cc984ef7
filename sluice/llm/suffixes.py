"""Suffix-array dedup of repeated passages, exact to the byte.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. All
suffixes of a corpus cannot be moved, so a sparse suffix array is sorted:

1. Every window of ``length`` bytes is owned by the anchor inside it: the place, among its
   first ``SPREAD``, whose 8-gram has the least hash. Equal windows own equal anchors at
   equal offsets, so only suffixes at anchors need sorting, about one in 75.
2. Anchors are counted by the bytes that all their windows share. Where these are unique, no
   window repeats. Where all occurrences have the same full context, all windows repeat.
3. The suffixes of the remaining anchors, with their left contexts, are sorted within each
   task, front-coded, exchanged, and merged by a loser tree that starts each comparison after
   the prefix already known to be common. The longest common prefixes that it puts out bound
   the groups of windows that can be equal.
4. The runs of repeated windows are merged per text and cut out.

Texts are handled once per distinct text; a text that occurs twice repeats throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import keep

LENGTH = 200
SPREAD = 150
GRAM = 8
# Bytes of spans below which they are broadcast to the texts; beyond, both are shuffled.
BROADCAST_BYTES = 32_000_000
# Windows placed at a time, which bounds memory for very long texts.
PIECE = 1 << 21


def anchors(data: bytes, length: int = LENGTH, spread: int = SPREAD) -> Iterator[tuple]:
    """(place, least offset, greatest offset) of every anchor, as arrays, piece by piece.

    The windows that an anchor at ``p`` owns start at ``p - offset`` for all offsets between
    the two. A long text is cut into pieces of windows; an anchor can occur in two of them,
    with the offsets of each.
    """
    last = len(data) - length
    if last < 0:
        return
    for first in range(0, last + 1, PIECE):
        upto = min(first + PIECE, last + 1)
        part = np.frombuffer(data, np.uint8, upto - first + spread + GRAM - 2, first)
        n = len(part) - GRAM + 1
        grams = np.empty(n, np.uint64)
        for shift in range(GRAM):
            whole = (len(part) - shift) // GRAM
            grams[shift::GRAM] = part[shift : shift + whole * GRAM].view("<u8")
        with np.errstate(over="ignore"):
            grams *= np.uint64(0x9E3779B97F4A7C15)
            grams ^= grams >> np.uint64(32)
            grams *= np.uint64(0xBF58476D1CE4E5B9)
        # Hash above, place below: the least of these is the leftmost of the least hashes.
        low = (grams & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= spread:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = spread - width
        if rest:
            low = np.minimum(low[:-rest], low[rest:])
        owner = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        end = np.concatenate((begin[1:], [len(owner)])) - 1
        place = owner[begin]
        yield place + first, place - end, place - begin


def text_key(data: bytes) -> int:
    """Name of a text: its 64-bit hash, as a signed number."""
    value = xxhash.xxh3_64_intdigest(data)
    return value - (1 << 64) if value >= 1 << 63 else value


def _place_anchors(length: int, spread: int):
    """Task: a row per anchor with the hashes of its shared bytes and of its full context."""
    shared = length - spread + 1

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            cores, fulls, keys, spots = [], [], [], []
            for value in batch.column(0):
                data = (value.as_py() or "").encode("utf-8", "surrogatepass")
                key = text_key(data)
                for place, least, most in anchors(data, length, spread):
                    rows = list(zip(place.tolist(), least.tolist(), most.tolist()))
                    cores += [digest(data[p : p + shared]) for p, _, _ in rows]
                    fulls += [digest(data[p - b : p - a + length], a) for p, a, b in rows]
                    spots += [p << 16 | a << 8 | b for p, a, b in rows]
                    keys += [key] * len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(cores, np.uint64).view(np.int64)),
                    pa.array(np.array(fulls, np.uint64).view(np.int64)),
                    pa.array(np.array(keys, np.int64)),
                    pa.array(np.array(spots, np.int64)),
                ],
                names=["core", "full", "key", "spot"],
            )

    return run


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of two strings that share ``start`` bytes already."""
    end = min(len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    step = 16
    while a[start : start + step] == b[start : start + step]:
        start += step
        step *= 2
    while step > 1:
        step //= 2
        if a[start : start + step] == b[start : start + step]:
            start += step
    return min(start, end)


def front_code(run: list[tuple[bytes, int, bytes]]) -> bytes:
    """A sorted run: per record, the prefix shared with the one before and what differs."""
    out, before = [], b""
    for text, split, payload in run:
        lcp = common_prefix(before, text, 0)
        tail = text[lcp:]
        head = (lcp, len(tail), split, len(payload))
        out.append(b"".join(n.to_bytes(4, "little") for n in head) + tail + payload)
        before = text
    return b"".join(out)


def decode(blob: bytes) -> Iterator[tuple[bytes, int, int, bytes]]:
    """(text, prefix shared with the one before, split, payload) of a front-coded run."""
    at, text = 0, b""
    while at < len(blob):
        lcp, n, split, m = np.frombuffer(blob, "<u4", 4, at).tolist()
        at += 16
        text = text[:lcp] + blob[at : at + n]
        at += n
        yield text, lcp, split, blob[at : at + m]
        at += m


class LoserTree:
    """Merges sorted runs; every head knows the prefix it shares with the last output.

    Of two heads the one that shares more with the last output is smaller, and the other
    keeps its prefix. Only at equal prefixes are bytes compared, and only behind them.
    """

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.lcp = [0] * len(runs)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.losers = [-1] * self.size
        self.compared = 0
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            leaf = node - self.size
            return leaf if leaf < len(self.runs) else -1
        won, lost = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.losers[node] = lost
        return won

    def _play(self, a: int, b: int) -> tuple[int, int]:
        if b < 0 or self.heads[b] is None:
            return a, b
        if a < 0 or self.heads[a] is None:
            return b, a
        la, lb = self.lcp[a], self.lcp[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        x, y = self.heads[a][0], self.heads[b][0]
        same = common_prefix(x, y, la)
        self.compared += same - la + 1
        if x[same : same + 1] <= y[same : same + 1]:
            self.lcp[b] = same
            return a, b
        self.lcp[a] = same
        return b, a

    def __iter__(self) -> Iterator[tuple[bytes, int, int, bytes]]:
        """(text, prefix shared with the one before, split, payload) in order."""
        while self.winner >= 0 and self.heads[self.winner] is not None:
            won = self.winner
            text, _, split, payload = self.heads[won]
            yield text, self.lcp[won], split, payload
            self.heads[won] = head = next(self.runs[won], None)
            self.lcp[won] = head[1] if head else 0
            node = (won + self.size) // 2
            while node:
                won, self.losers[node] = self._play(won, self.losers[node])
                node //= 2
            self.winner = won


# A record's payload: key of the text, place of the anchor, least and greatest offset.
_SPOT = np.dtype([("key", "<i8"), ("place", "<i8"), ("least", "<u2"), ("most", "<u2")])


def _sorted_runs(length: int, shared: int, parts: int):
    """Task: the task's suffixes at mixed anchors as sorted front-coded runs, one per part.

    A run holds at most ``RUN_BYTES``; a task with more writes several.
    """

    def flush(held):
        for part, rows in held.items():
            merged: dict[tuple[bytes, int], list[bytes]] = {}
            for text, split, payload in rows:
                merged.setdefault((text, split), []).append(payload)
            run = [(t, s, b"".join(p)) for (t, s), p in sorted(merged.items())]
            yield part, front_code(run)
        held.clear()

    def batch_of(rows):
        rows = list(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
            names=["part", "run"],
        )

    def run(batches):
        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            for key, body, spots in zip(*(c.to_pylist() for c in batch.columns)):
                data = body.encode("utf-8", "surrogatepass")
                for spot in spots:
                    place, least, most = spot >> 16, spot >> 8 & 255, spot & 255
                    right = data[place : place - least + length]
                    left = data[place - most : place][::-1]
                    part = xxhash.xxh3_64_intdigest(right[:shared]) % parts
                    payload = np.array([(key, place, least, most)], _SPOT).tobytes()
                    held.setdefault(part, []).append((right + left, len(right), payload))
                    size += len(right) + len(left) + 100
                    if size > RUN_BYTES:
                        yield batch_of(flush(held))
                        size = 0
        yield batch_of(flush(held))

    return run


RUN_BYTES = 60_000_000


def repeated_offsets(group: list[tuple[bytes, int, int, int, bool]], lcps: list[int], length: int):
    """For each record of a group, the offsets whose window occurs in another record.

    A record is (right context then reversed left context, size of the right one, least and
    greatest offset, whether it occurs twice itself); records are distinct and sorted, and
    ``lcps[i]`` is the prefix that record i shares with the one before. At an offset ``o``
    two windows are equal if the right contexts share ``length - o`` bytes and the left
    ones ``o``; the former cuts the sorted group into segments, the latter is compared
    inside a segment.
    """
    out: list[list[int]] = [[] for _ in group]
    lowest = min(r[2] for r in group)
    highest = max(r[3] for r in group)
    for o in range(lowest, highest + 1):
        need = length - o
        at = 0
        while at < len(group):
            end = at + 1
            while end < len(group) and lcps[end] >= need:
                end += 1
            seen: dict[bytes, list[int]] = {}
            for i in range(at, end):
                text, right, least, most, twice = group[i]
                if not least <= o <= most or right < need:
                    continue
                if end - at == 1:
                    if twice:
                        out[i].append(o)
                    continue
                seen.setdefault(text[right : right + o], []).append(i)
            for same in seen.values():
                if len(same) > 1 or group[same[0]][4]:
                    for i in same:
                        out[i].append(o)
            at = end
    return out


def _merge_runs(length: int, shared: int):
    """Group function: merges the runs of one part and gives the repeated spans."""

    def spans(group, lcps):
        records, payloads = [], []
        for text, split, payload in group:
            spots = np.frombuffer(payload, _SPOT)
            records.append((text, split, int(spots["least"].min()), int(spots["most"].max()), len(spots) > 1))
            payloads.append(spots)
        if len(records) == 1 and not records[0][4]:
            return
        for offsets, spots in zip(repeated_offsets(records, lcps, length), payloads):
            if not offsets:
                continue
            o = np.array(offsets)
            cut = np.flatnonzero(np.diff(o) > 1)
            lows, highs = o[np.concatenate(([0], cut + 1))], o[np.concatenate((cut, [len(o) - 1]))]
            for key, place, least, most in spots.tolist():
                for a, b in zip(lows.tolist(), highs.tolist()):
                    a, b = max(a, least), min(b, most)
                    if a <= b:
                        yield key, place - b, place - a + length

    def run(batches):
        blobs = [b.as_py() for batch in batches for b in batch.column(1)]
        group: list = []
        lcps: list[int] = []
        keys, starts, ends = [], [], []

        def close():
            for key, a, b in spans(group, lcps):
                keys.append(key)
                starts.append(a)
                ends.append(b)
            group.clear()
            lcps.clear()

        for text, lcp, split, payload in LoserTree([decode(b) for b in blobs]):
            if group and group[-1][0] == text and group[-1][1] == split:
                group[-1] = (text, split, group[-1][2] + payload)
                continue
            if group and lcp < shared:
                close()
            group.append((text, split, payload))
            lcps.append(lcp)
            if len(keys) > 50_000:
                yield _span_batch(keys, starts, ends)
                keys, starts, ends = [], [], []
        close()
        yield _span_batch(keys, starts, ends)

    return run


def _span_batch(keys, starts, ends):
    columns = [pa.array(x, pa.int64()) for x in (keys, starts, ends)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "first", "past"])


def _keyed_texts(batches):
    for batch in batches:
        keys = [text_key((v.as_py() or "").encode("utf-8", "surrogatepass")) for v in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0)], names=["key", "body"])


def repeated_spans(
    docs: DataFrame, text: str = "text", length: int = LENGTH, spread: int = SPREAD
) -> DataFrame:
    """``key`` (name of a distinct text) and ``spans``, its repeated byte ranges, merged."""
    body = docs.select(F.col(f"`{text}`").alias("body"))
    rows = body.mapInArrow(_place_anchors(length, spread), "core bigint, full bigint, key bigint, spot bigint")
    counted = rows.groupBy("core").agg(
        F.count("*").alias("n"), F.min("full").alias("a"), F.max("full").alias("b")
    )
    repeated = counted.where("n > 1").select(F.col("core").alias("_core"), (F.col("a") != F.col("b")).alias("mixed"))
    repeated = keep(repeated, "suffix-repeated")
    hit = rows.join(repeated, F.col("core") == F.col("_core"))
    hit = keep(hit.groupBy("key", "spot", "mixed").agg(F.count("*").alias("copies")), "suffix-hits")

    place = F.shiftright("spot", 16)
    least, most = F.shiftright("spot", 8).bitwiseAND(255), F.col("spot").bitwiseAND(255)
    # An anchor of a text that occurs in several rows repeats whatever stands around it.
    sure = hit.where(~F.col("mixed") | (F.col("copies") > 1)).select(
        "key", (place - most).alias("first"), (place - least + length).alias("past")
    )
    spots = hit.where("mixed").groupBy("key").agg(F.collect_list("spot").alias("spots"))
    texts = body.mapInArrow(_keyed_texts, "key bigint, body string").groupBy("key").agg(F.first("body").alias("body"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = texts.join(spots, "key").mapInArrow(_sorted_runs(length, length - spread + 1, parts), "part int, run binary")
    merged = runs.repartition(parts, "part").mapInArrow(
        _by_part(_merge_runs(length, length - spread + 1)), "key bigint, first bigint, past bigint"
    )
    ranges = keep(sure.union(merged), "suffix-ranges")
    item = F.struct("first", "past")
    sorted_ranges = ranges.groupBy("key").agg(F.sort_array(F.collect_set(item)).alias("r"))
    none = F.array().cast("array<struct<first:bigint,past:bigint>>")
    last = lambda a: F.element_at(a, -1)
    joined = F.aggregate(
        "r",
        none,
        lambda a, x: F.when(
            (F.size(a) > 0) & (last(a)["past"] >= x["first"]),
            F.concat(
                F.slice(a, 1, F.size(a) - 1),
                F.array(
                    F.struct(
                        last(a)["first"].alias("first"), F.greatest(last(a)["past"], x["past"]).alias("past")
                    )
                ),
            ),
        ).otherwise(F.concat(a, F.array(x))),
    )
    return keep(sorted_ranges.select("key", joined.alias("spans")), "suffix-spans")


def _by_part(merge):
    """Applies ``merge`` to the rows of each part; a task may hold several."""

    def run(batches):
        by_part: dict[int, list] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_part.setdefault(part, []).append(blob)
        for part in sorted(by_part):
            blobs = by_part.pop(part)
            one = pa.RecordBatch.from_arrays(
                [pa.array([part] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "run"]
            )
            yield from merge([one])

    return run


def _cut(batches):
    """Task: (row, n_bytes, n_removed, spans, kept bytes' hash and text) of every row."""
    import hashlib

    for batch in batches:
        sizes, removed, counts, digests = [], [], [], []
        for body, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = (body or "").encode("utf-8", "surrogatepass")
            spans = spans or []
            digest, at = hashlib.sha256(), 0
            for span in spans:
                digest.update(data[at : span["first"]])
                at = span["past"]
            digest.update(data[at:])
            sizes.append(len(data))
            removed.append(sum(s["past"] - s["first"] for s in spans))
            counts.append(len(spans))
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array(digests, pa.string()),
                batch.column(2),
            ],
            names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, spread: int = SPREAD) -> DataFrame:
    """What is left of every text without its repeated passages; one output row per input row.

    Returns ``row`` (the input columns but the text), ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256`` (of the remaining bytes) and ``spans`` (byte ranges
    removed). A null text counts as empty; a text shorter than ``length`` loses nothing. A
    text that occurs in two rows is removed whole from both. ``spread`` must be below
    ``length - 8`` and 256.
    """
    slim = docs.drop(text)
    rest = F.struct(*[F.col(f"`{c}`") for c in slim.columns]) if slim.columns else F.struct(F.lit(0))
    spans = repeated_spans(docs, text, length, spread)
    kind = spans.schema["spans"].dataType
    sized = spans.agg(F.sum(16 + 16 * F.size("spans")).alias("b")).first().b or 0
    if sized <= BROADCAST_BYTES:
        spans = F.broadcast(spans)
    base = docs.select(rest.alias("row"), F.col(f"`{text}`").alias("body"))
    keyed = base.mapInArrow(_with_key, base.select("row", "body", F.lit(0).cast("bigint").alias("_key")).schema)
    joined = keyed.join(spans, F.col("_key") == F.col("key"), "left").select("row", "body", "spans")
    zero = F.lit(0).cast("bigint")
    schema = joined.select(
        "row",
        zero.alias("n_bytes"),
        zero.alias("n_removed"),
        zero.alias("n_spans"),
        F.lit("").alias("kept_sha256"),
        F.lit(None).cast(kind).alias("spans"),
    ).schema
    return joined.mapInArrow(_cut, schema)


def _with_key(batches):
    for batch in batches:
        keys = [text_key((v.as_py() or "").encode("utf-8", "surrogatepass")) for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys, pa.int64())], names=["row", "body", "_key"]
        )
