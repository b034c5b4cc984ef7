"""Quality classifier: random-indexing word vectors and a two-layer network.

Every hash bucket of words has a sparse random index vector; a bucket's word vector is the sum
of the index vectors of the words found beside its own, over all texts. The sums are made
in the tasks, added up by Spark, and have a fixed size however large the corpus is. A text is
the frequency-damped mean of its words' vectors and their spread. A two-layer network over
that, fitted in NumPy on a bounded sample of labelled rows, gives a probability, which one
temperature, fitted on rows the network has not seen, calibrates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import whole

# Labelled documents the network is fitted on, lowest hash of the key first.
TRAIN_ROWS = 8_000
BUCKETS = 1 << 14
SIZE = 64
# Entries of an index vector that are not 0, and words to either side that count as context.
ENTRIES = 4
REACH = 2
# A word of this share of the corpus weighs half as much as a rare one in a text's mean.
DAMPING = 1e-3
HIDDEN = 32
STEPS = 400
RATE = 0.01
DECAY = 1e-3
SEED = 11
THRESHOLD = 0.3
FOLDS = 5
# Bytes of text hashed, and words added up, at a time: they bound memory, not the result.
PIECE_BYTES = 1_000_000
PIECE_WORDS = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _classes() -> np.ndarray:
    """Kind of every byte: 0 blank, 1 letter or part of one, 2 digit, 3 other."""
    kinds = np.full(256, 3, np.int8)
    kinds[[9, 10, 11, 12, 13, 32]] = 0
    kinds[48:58] = 2
    kinds[65:91] = kinds[97:123] = kinds[128:] = 1
    return kinds


_KIND = _classes()


class Hasher:
    """Word buckets of texts, by array operations on their bytes.

    Words are runs of letters, of digits, or of other signs. Letters are lower-cased; a word
    of two or more capitals only is told apart from its lower-case form. The last bucket is
    that of a word which says the one before it again.
    """

    def __init__(self, buckets: int = BUCKETS):
        self.again = buckets - 1
        self.buckets = np.uint64(self.again)
        self._grow(PIECE_BYTES)

    def _grow(self, size: int) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        self.powers = np.cumprod(np.full(size, _BASE, np.uint64))
        self.inverse = np.cumprod(np.full(size, inverse, np.uint64))

    def words(self, data: bytes) -> np.ndarray:
        """Buckets of the words of some bytes, in order."""
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return np.zeros(0, np.int32)
        if len(raw) > len(self.powers):
            self._grow(len(raw))
        kind = _KIND[raw]
        starts = np.flatnonzero(np.diff(kind, prepend=np.int8(-1)))
        ends = np.append(starts[1:], len(raw))
        real = kind[starts] > 0
        starts, ends = starts[real], ends[real]
        total = np.concatenate(([np.uint64(0)], np.cumsum((_LOWER[raw] + np.uint64(1)) * self.powers[: len(raw)])))
        capitals = np.concatenate(([0], np.cumsum(_UPPER[raw])))
        loud = (ends - starts > 1) & (capitals[ends] - capitals[starts] == ends - starts)
        z = (total[ends] - total[starts]) * self.inverse[starts] + loud.astype(np.uint64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) % self.buckets).astype(np.int32)

    def text(self, data: bytes) -> np.ndarray:
        """The same for a text of any length, in pieces that end where a word ends."""
        found, at = [], 0
        while at < len(data):
            stop = self._cut(data, at)
            found.append(self.words(data[at:stop]))
            at = stop
        return np.concatenate(found) if found else np.zeros(0, np.int32)

    def _cut(self, data: bytes, at: int) -> int:
        stop = at + PIECE_BYTES
        while stop < len(data):
            kind = _KIND[np.frombuffer(data, np.uint8, PIECE_BYTES, stop - PIECE_BYTES)]
            changes = np.flatnonzero(np.diff(kind))
            if len(changes):
                return stop - PIECE_BYTES + int(changes[-1]) + 1
            stop += PIECE_BYTES
        return len(data)


def batches_of_words(texts: pa.Array, hasher: Hasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all words of a piece of a batch, and how many each of its texts has."""
    held, size = [], 0
    for text in texts.to_pylist():
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > PIECE_BYTES:
            yield _words_of(held, hasher)
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield _words_of(held, hasher)


def _words_of(held: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    if len(held) == 1:
        words = hasher.text(held[0])
        counts = np.array([len(words)])
    else:
        # A blank between texts ends the last word of each, so they are hashed as one.
        joined = b" ".join(held)
        words = hasher.words(joined)
        kind = _KIND[np.frombuffer(joined, np.uint8)]
        first = np.flatnonzero((np.diff(kind, prepend=np.int8(-1)) != 0) & (kind > 0))
        counts = np.diff(np.searchsorted(first, np.cumsum([0] + [len(h) + 1 for h in held])))
    owner = np.repeat(np.arange(len(counts)), counts)
    again = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    words[1:][again] = hasher.again
    return words, counts


def index_vectors(buckets: int, size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of every bucket's index vector."""
    rng = np.random.default_rng(seed)
    places = rng.random((buckets, size)).argpartition(ENTRIES, axis=1)[:, :ENTRIES]
    return places.astype(np.int64), rng.choice(np.array([-1.0, 1.0]), (buckets, ENTRIES))


def add_contexts(total: np.ndarray, words: np.ndarray, counts: np.ndarray, index: tuple) -> None:
    """Add the index vectors of each word's neighbours within its text to its bucket's row."""
    places, signs = index
    size = total.shape[1]
    owner = np.repeat(np.arange(len(counts)), counts)
    flat = total.reshape(-1)
    for step in range(1, REACH + 1):
        same = owner[:-step] == owner[step:]
        left, right = words[:-step][same], words[step:][same]
        for one, other in ((left, right), (right, left)):
            row = one.astype(np.int64) * size
            for j in range(places.shape[1]):
                flat += np.bincount(row + places[other, j], signs[other, j], len(flat))


def context_sums(docs: DataFrame, text: str, buckets: int = BUCKETS, size: int = SIZE) -> DataFrame:
    """``bucket``, ``n`` (its words) and ``v`` (sum of its contexts) over all texts."""

    def run(batches):
        hasher, index = Hasher(buckets), index_vectors(buckets, size)
        total, seen = np.zeros((buckets, size)), np.zeros(buckets, np.int64)
        held, n = [], 0

        def add():
            words, counts = (np.concatenate(x) for x in zip(*held))
            seen[:] += np.bincount(words, minlength=buckets)
            add_contexts(total, words, counts, index)
            held.clear()

        for batch in batches:
            for piece in batches_of_words(batch.column(0), hasher):
                held.append(piece)
                n += len(piece[0])
                if n >= PIECE_WORDS:
                    add()
                    n = 0
        if held:
            add()
        rows = np.flatnonzero(seen)
        flat = pa.array(total[rows].astype(np.int64).ravel())
        lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * size, flat)
        columns = [pa.array(rows, pa.int32()), pa.array(seen[rows]), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "n", "v"])

    kind = "bucket int, n bigint, v array<bigint>"
    found = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, kind)
    each = [F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(size)]
    summed = found.groupBy("bucket").agg(F.sum("n").alias("n"), *each)
    return summed.select("bucket", "n", F.array(*[f"v{i}" for i in range(size)]).alias("v"))


@dataclass
class Words:
    """Word vectors by bucket and the weight of each bucket in a text's mean."""

    vectors: np.ndarray
    weights: np.ndarray

    def pooled(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Per text the weighted mean of its words' vectors, then their spread; 0 without words."""
        size = self.vectors.shape[1]
        both = self._both()
        out = np.zeros((len(counts), 2 * size), np.float32)
        ends = np.cumsum(counts)
        for i in np.flatnonzero(counts).tolist():
            own = words[ends[i] - counts[i] : ends[i]]
            total, weight = np.zeros(2 * size), 0.0
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                w = self.weights[part]
                total += w @ both.take(part, axis=0)
                weight += float(w.sum())
            mean, square = total[:size] / weight, total[size:] / weight
            out[i, :size] = mean
            out[i, size:] = np.sqrt(np.maximum(square - mean * mean, 0))
        return out

    def _both(self) -> np.ndarray:
        """Vectors and their squares side by side."""
        if not hasattr(self, "_squared"):
            self._squared = np.concatenate((self.vectors, self.vectors**2), axis=1)
        return self._squared


def word_vectors(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, size: int = SIZE) -> Words:
    """Word vectors from all texts. ``buckets`` rows of fixed size reach the driver."""
    total, seen = np.zeros((buckets, size)), np.zeros(buckets)
    for r in context_sums(docs, text, buckets, size).toLocalIterator():
        total[r.bucket], seen[r.bucket] = r.v, r.n
    places, signs = index_vectors(buckets, size)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    share = seen / max(seen.sum(), 1)
    context = unit(total)
    # What all words share tells nothing: their common direction goes.
    context = unit(context - share @ context)
    own = np.zeros((buckets, size))
    np.put_along_axis(own, places, signs, axis=1)
    vectors = context + unit(own)
    return Words(vectors.astype(np.float32), (DAMPING / (DAMPING + share)).astype(np.float32))


def pooled_rows(docs: DataFrame, words: Words, text: str = "text") -> DataFrame:
    """``row`` (the input columns but the text) and ``v``, the pooled vector of the text."""
    slim = docs.drop(text)
    rest = whole(slim) if slim.columns else F.struct(F.lit(0)).alias("row")
    pairs = docs.select(rest, F.col(f"`{text}`").cast("string").alias("body"))

    def run(batches):
        hasher = Hasher(len(words.weights))
        for batch in batches:
            parts = [words.pooled(*x) for x in batches_of_words(batch.column(1), hasher)]
            v = np.concatenate(parts)
            ends = np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]
            lists = pa.ListArray.from_arrays(ends, pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row", "v"])

    return pairs.mapInArrow(run, pairs.select("row").schema.add("v", T.ArrayType(T.FloatType())))


@dataclass
class Network:
    """Standardised input, one hidden layer, one output, and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        hidden = np.tanh(((x - self.mean) / self.scale) @ w1 + b1)
        return (hidden @ w2 + b2)[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, seed: int = SEED) -> Network:
    """Two layers by Adam on the log loss over all rows at once."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, n = (x - mean) / scale, len(x)
    layers = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)),
        np.zeros(hidden),
        rng.normal(0, 1 / np.sqrt(hidden), (hidden, 1)),
        np.zeros(1),
    ]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in layers]
    for step in range(1, STEPS + 1):
        w1, b1, w2, b2 = layers
        h = np.tanh(z @ w1 + b1)
        p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30)))
        out = (p - y[:, None]) / n
        back = (out @ w2.T) * (1 - h * h)
        slopes = [z.T @ back + DECAY * w1, back.sum(axis=0), h.T @ out + DECAY * w2, out.sum(axis=0)]
        for param, slope, (m, v) in zip(layers, slopes, moments):
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            param -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, layers)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of a fixed grid with the least log loss; 1 without rows."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    scaled = logits / grid[:, None]
    loss = (np.logaddexp(0, scaled) - y * scaled).mean(axis=1)
    return float(grid[loss.argmin()])


def held_out(key: str | Column) -> Column:
    """Rows whose labels are never learned from; a null key counts as an empty one."""
    name = F.col(f"`{key}`") if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(name.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


@dataclass
class Model:
    words: Words
    network: Network | None
    base: float

    def scores(self, v: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(v), self.base)
        return self.network.scores(v.astype(np.float64))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    limit: int = TRAIN_ROWS,
    buckets: int = BUCKETS,
    size: int = SIZE,
) -> Model:
    """Word vectors from all texts and a network from at most ``limit`` labelled keys.

    Labels of held-out keys are not read. A key with several labels takes their mean, and one
    with several texts the least of their vectors. Without both labels the score is their
    mean, 0.5 if there are none.
    """
    words = word_vectors(docs, text, buckets, size)
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("double").alias("y"))
    known = known.where(F.col("k").isNotNull() & F.col("y").isNotNull() & ~held_out("k"))
    known = known.groupBy("k").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(limit)
    texts = docs.select(F.col(f"`{key}`").alias("k2"), F.col(f"`{text}`").alias("body"))
    picked = texts.join(F.broadcast(known), F.col("k2") == F.col("k")).select("k", "y", "body")
    rows = pooled_rows(picked, words, "body").groupBy("row.k", "row.y").agg(F.min("v").alias("v"))
    # At most ``limit`` vectors.
    sample = rows.orderBy(F.xxhash64("k"), "k").collect()
    y = np.array([r.y for r in sample])
    base = float(y.mean()) if len(y) else 0.5
    if len(np.unique(y)) < 2:
        return Model(words, None, base)
    x = np.array([r.v for r in sample], np.float64)
    # Every fifth row of the hash order is kept from the network and sets the temperature.
    kept = np.arange(len(y)) % FOLDS == 0
    network = fit_network(x[~kept], y[~kept])
    network.temperature = fit_temperature(network.logits(x[kept]), y[kept])
    return Model(words, network, base)


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row`` (the input columns but the text) and ``score`` of every row, 0 to 1.

    One output row per input row. A null or empty text has the zero vector and the score that
    the network gives it. Equal texts have equal scores. Texts may be of any length; other
    columns may have any name and are not used.
    """
    scored = pooled_rows(docs, model.words, text)
    network = Model(Words(model.words.vectors[:0], model.words.weights[:0]), model.network, model.base)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            v = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            score = pa.array(network.scores(v), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), score], names=["row", "score"])

    return scored.mapInArrow(run, scored.select("row").schema.add("score", "double"))
