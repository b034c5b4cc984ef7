"""Fill-in-middle transformation: texts cut at unit boundaries and put in a new order.

A unit is a run of ASCII letters or one other code point. The texts of a batch lie side by
side in one UTF-8 buffer, which is read as 64-bit words. Additions and shifts on whole words
mark the last byte of every unit, eight bytes at a time; the marks of each word are counted
and summed up along the buffer. Unit k is then found by a search among these sums and, inside
the one word it lies in, by clearing marks from the low end. Nothing is shuffled; a text's
cuts depend on its key only, so reruns and lost executors give the same output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import whole

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Per cent of the texts that are rearranged, and of these the share in suffix-first form.
RATE = 90
SUFFIX_FIRST = 20
SEED = 1
# Bytes of text cut at a time; bounds memory, a longer text is a piece of its own.
PIECE_BYTES = 8_000_000

_HIGH = np.uint64(0x8080808080808080)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
_CASE = np.uint64(0x2020202020202020)
# Added to a byte below 0x80 these set its high bit from 'a' on, and from '{' on.
_FROM_A = np.uint64(0x1F1F1F1F1F1F1F1F)
_PAST_Z = np.uint64(0x0505050505050505)
_ONE = np.uint64(1)
_EIGHT = np.uint64(8)

OUT = pa.struct(
    [
        ("n", pa.int64()),
        ("form", pa.string()),
        ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()),
        ("output", pa.large_string()),
    ]
)


def _next(marks: np.ndarray) -> np.ndarray:
    """Marks moved so that each byte holds what stood at the byte after it."""
    moved = marks >> _EIGHT
    moved[:-1] |= marks[1:] << np.uint64(56)
    return moved


class Marks:
    """Marked bytes of a buffer: how many lie before a byte, and where the k-th one lies.

    ``marks`` has the high bit of every marked byte set, in little-endian words.
    """

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        counts = np.bitwise_count(marks).astype(np.int64)
        self.upto = np.cumsum(counts)
        self.before = self.upto - counts

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of marked bytes before byte ``at``; the buffer ends with a spare word."""
        word, bits = at >> 3, ((at & 7) << 3).astype(np.uint64)
        below = self.marks[word] & ((_ONE << bits) - _ONE)
        return self.before[word] + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte of the k-th mark, counted from 0. Every k must exist."""
        word = np.searchsorted(self.upto, k, "right")
        left = k - self.before[word]
        marks = self.marks[word]
        for _ in range(7):
            go = left > 0
            if not go.any():
                break
            marks = np.where(go, marks & (marks - _ONE), marks)
            left = left - go
        lowest = marks & (~marks + _ONE)
        return (word << 3) + (np.bitwise_count(lowest - _ONE) >> 3)


def unit_marks(data: np.ndarray, ends: np.ndarray) -> tuple[Marks, Marks]:
    """Marks of the last byte of every unit, and of the first byte of every code point.

    ``data`` holds UTF-8 bytes; ``ends`` are the ends of the non-empty texts in it.
    """
    buffer = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    buffer[: len(data)] = data
    words = buffer.view("<u8")
    folded = (words & _LOW7) | _CASE
    letter = (folded + _FROM_A) & ~(folded + _PAST_Z) & ~words & _HIGH
    inner = words & ~(words << _ONE) & _HIGH
    last = _HIGH & ~_next(inner) & ~(letter & _next(letter))
    final = np.zeros(len(buffer), np.uint8)
    final[ends - 1] = 0x80
    last |= final.view("<u8")
    # Bytes past the end belong to no text.
    real = np.zeros(len(buffer), np.uint8)
    real[: len(data)] = 0x80
    real = real.view("<u8")
    return Marks(last & real), Marks(~inner & real)


def cut_units(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, second: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: units, bytes up to the two cuts, and code points of prefix and middle.

    The cuts come after the smaller and the larger of ``first % (n + 1)`` and
    ``second % (n + 1)`` units.
    """
    units, points = unit_marks(data, ends[ends > starts])
    base = units.rank(starts)
    n = units.rank(ends) - base
    a, b = first % (n + 1), second % (n + 1)
    cuts = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        at = starts.copy()
        some = np.flatnonzero(k > 0)
        at[some] = units.select(base[some] + k[some] - 1) + 1
        cuts.append(at)
    low, high = cuts
    at_low = points.rank(low)
    return n, low, high, at_low - points.rank(starts), points.rank(high) - at_low


def draws(key: object, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of a row, from a digest of the seed and its key."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12)]


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with bounded text; at least one row each."""
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > PIECE_BYTES:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def transform_texts(
    texts: pa.Array, keys: list, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> Iterator[pa.StructArray]:
    """``OUT`` of every text (UTF-8, no nulls), in pieces of bounded size."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = memoryview(texts.buffers()[2] or b"")
    marks = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
    for i, j in _pieces(np.diff(offsets)):
        base, stop = int(offsets[i]), int(offsets[j])
        data = bytes(body[base:stop])
        h = np.array([draws(k, seed) for k in keys[i:j]], np.int64).reshape(-1, 4)
        starts, ends = offsets[i:j] - base, offsets[i + 1 : j + 1] - base
        found = cut_units(np.frombuffer(data, np.uint8), starts, ends, h[:, 0], h[:, 1])
        rows = zip(starts.tolist(), ends.tolist(), *(x.tolist() for x in found), h[:, 2:].tolist())
        forms, outputs, prefixes, middles = [], [], [], []
        for start, end, _, low, high, prefix_chars, middle_chars, (h3, h4) in rows:
            text = data[start:end]
            if not text or h3 % 100 >= rate or any(m in text for m in marks):
                forms.append("plain")
                outputs.append(text)
                prefixes.append(None)
                middles.append(None)
                continue
            prefix = marks[0] + data[start:low]
            suffix = marks[1] + data[high:end]
            swapped = h4 % 100 < suffix_first
            forms.append("spm" if swapped else "psm")
            parts = (suffix, prefix) if swapped else (prefix, suffix)
            outputs.append(b"".join((*parts, marks[2], data[low:high])))
            prefixes.append(prefix_chars)
            middles.append(middle_chars)
        columns = [
            pa.array(found[0], pa.int64()),
            pa.array(forms, pa.string()),
            pa.array(prefixes, pa.int64()),
            pa.array(middles, pa.int64()),
            pa.array(outputs, pa.large_binary()).cast(pa.large_string()),
        ]
        yield pa.StructArray.from_arrays(columns, fields=list(OUT))


def fill_in_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """``row`` (the input columns but the text), ``n``, ``form``, lengths and ``output``.

    One output row per input row, whatever else is in it. ``form`` is ``plain`` where the text
    stays as it is: an empty or null text (its output is empty), one that holds a sentinel, and
    ``100 - rate`` per cent of the others; ``prefix_chars`` and ``middle_chars`` are null
    there. Rows with the same key and text have the same output; a null key counts as empty. A
    text may be of any length and takes a small multiple of its size in memory. Other columns
    may have any name.
    """
    slim = docs.drop(text)
    rest = whole(slim) if slim.columns else F.struct(F.lit(0)).alias("row")
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    pairs = docs.select(rest, name.alias("key"), value.alias("body"))

    def run(batches):
        for batch in batches:
            at = 0
            keys = batch.column(1).to_pylist()
            for out in transform_texts(batch.column(2), keys, seed, rate, suffix_first):
                part = batch.column(0).slice(at, len(out))
                at += len(out)
                fields = [pc.struct_field(out, i) for i in range(out.type.num_fields)]
                fields[-1] = fields[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([part, *fields], names=["row", *out.type.names])

    schema = pairs.select("row").schema
    for field in OUT:
        schema = schema.add(field.name, "long" if pa.types.is_int64(field.type) else "string")
    return pairs.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A sentinel occurs once in each rearranged output."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    piece = [F.get(parts, F.lit(i)) for i in range(4)]
    return (
        F.when(form == "psm", F.concat(piece[1], piece[3], piece[2]))
        .when(form == "spm", F.concat(piece[2], piece[3], piece[1]))
        .otherwise(output)
    )
