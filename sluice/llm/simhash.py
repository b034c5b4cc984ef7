"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

A fingerprint is cut into ``blocks`` blocks. Two fingerprints with at most ``distance``
differing bits agree on at least ``blocks - distance`` whole blocks, so with
``together = blocks - distance`` they share a key made of some ``together`` blocks; the
keys of all combinations are joined and the distance is checked inside the join. Equal
fingerprints are merged before, so copies never pair up.

With a ``similarity`` the links wanted are those of a Jaccard similarity of shingle sets. At
0.8 every bit of a SimHash over all shingles differs with probability 0.15, so that only keys of a few
bits are shared, and those are shared by chance as well. There each block is a SimHash of its
own sample of three shingles instead: close sets often have a whole sample, and so a whole
64-bit block, in common, and others hardly ever do. See ``similar_documents``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Staging, keep, whole
from sluice.llm.components import connected_components, tree_roots

SEED = 42
SHINGLE = 4
DISTANCE = 4
BLOCKS = 7
# All pairs of a bucket of no more nodes than this are at most eight rows a node.
SMALL = 16
# Shingles hashed at a time, which bounds memory for very long texts.
CHUNK = 200_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LANE_MASK = np.uint64(0x0001000100010001)


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 of every word shingle of a text, in bounded pieces."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        pieces = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())
        yield np.array([digest(joined[a:b], SEED) for a, b in pieces], dtype=np.uint64)


def set_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per group of hashes, how often each of the 64 bits is set.

    Four bits at a time are summed in 16-bit lanes of one word; groups are cut so that no
    lane overflows.
    """
    step = 65_535
    cuts, owner = [], []
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        for c in range(a, b, step):
            cuts.append(c)
            owner.append(i)
    counts = np.zeros((len(offsets) - 1, 64), np.int64)
    if not cuts:
        return counts
    for shift in range(16):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANE_MASK, cuts)
        for lane in range(4):
            part = (lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)
            np.add.at(counts[:, 16 * lane + shift], owner, part.astype(np.int64))
    return counts


def _mixed(hashes: np.ndarray, block: int) -> np.ndarray:
    """An independent one-to-one mix of the hashes for every block."""
    with np.errstate(over="ignore"):
        z = hashes + np.uint64((block + 1) * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def distinct_shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    pieces = [np.unique(piece) for piece in shingle_hashes(text, size)]
    return np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, np.uint64)


def text_fingerprints(texts: list, size: int) -> np.ndarray:
    """64-bit fingerprints of texts. A text without words has zero."""
    counts = np.zeros((len(texts), 64), np.int64)
    totals = np.zeros(len(texts), np.int64)
    pending: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        if pending:
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in pending])))
            np.add.at(counts, owners, set_bits(np.concatenate(pending), offsets))
            pending.clear()
            owners.clear()

    held = 0
    for i, text in enumerate(texts):
        for piece in shingle_hashes(text, size):
            totals[i] += len(piece)
            pending.append(piece)
            owners.append(i)
            held += len(piece)
            if held >= CHUNK:
                flush()
                held = 0
    flush()
    bits = counts * 2 > totals[:, None]
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``id`` (the key) and ``fp`` (array of one 64-bit word as long) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = text_fingerprints(batch.column(1).to_pylist(), size).view(np.int64)
            offsets = pa.array(np.arange(len(fps) + 1, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(fps))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "fp"])

    slim = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    return slim.mapInArrow(run, f"id {kind}, fp array<bigint>")


def sampled_blocks(sets: list[np.ndarray], blocks: int) -> np.ndarray:
    """Fingerprints of sets of distinct hashes, shape (sets, blocks), one SimHash a block.

    A block mixes all hashes in its own way, samples the three that come out least, and sets
    each bit that more than half of the sample has. Of two sets with Jaccard similarity s the
    samples are equal with a probability of about s cubed. An empty set has zeros.
    """
    out = np.zeros((len(sets), blocks), np.uint64)
    some = [i for i, s in enumerate(sets) if len(s)]
    if not some:
        return out
    sizes = np.array([len(sets[i]) for i in some])
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate([sets[i] for i in some])
    most = np.uint64(2**64 - 1)
    for block in range(blocks):
        z = _mixed(flat, block)
        low = []
        for k in range(3):
            least = np.minimum.reduceat(z, starts)
            # What is not there has no bits set.
            low.append(np.where(sizes > k, least, np.uint64(0)))
            z[z == np.repeat(least, sizes)] = most
        a, b, c = low
        out[some, block] = np.where(sizes == 1, a, (a & b) | (a & c) | (b & c))
    return out


def _set_names(sets: list[np.ndarray]) -> pa.Array:
    """128-bit names of sets of hashes."""
    return pa.array([xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets], pa.binary())


def _in_chunks(texts: list, size: int) -> Iterator[list[np.ndarray]]:
    """Sets of shingles of texts in order, a bounded number of shingles at a time."""
    held, n = [], 0
    for text in texts:
        held.append(distinct_shingles(text, size))
        n += len(held[-1])
        if n >= CHUNK:
            yield held
            held, n = [], 0
    if held:
        yield held


def set_fingerprints(docs: DataFrame, key: str, text: str, size: int, blocks: int) -> DataFrame:
    """``id``, ``node`` (a 128-bit name) and the blocks ``f0`` ... of every row's set of shingles."""
    kind = docs.schema[key].dataType.simpleString()
    names = [f"f{i}" for i in range(blocks)]

    def run(batches):
        for batch in batches:
            at = 0
            for sets in _in_chunks(batch.column(1).to_pylist(), size):
                fps = sampled_blocks(sets, blocks).view(np.int64)
                columns = [batch.column(0).slice(at, len(sets)), _set_names(sets)]
                columns += [pa.array(fps[:, i]) for i in range(blocks)]
                at += len(sets)
                yield pa.RecordBatch.from_arrays(columns, names=["id", "node", *names])

    slim = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    made = ", ".join(f"{n} bigint" for n in names)
    return slim.mapInArrow(run, f"id {kind}, node binary, {made}")


def shingle_sets(
    ends: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, size: int
) -> DataFrame:
    """``node`` and ``s``, the sorted hashes of its set of shingles, of the given nodes.

    The sets are made again from the texts, and only of these nodes. ``nodes`` gives a row's key
    (``low``) for each node; further rows with that key do no harm.
    """
    ids = nodes.join(ends, "node", "left_semi").select(F.col("low").alias("_low"))
    texts = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("text"))
    texts = texts.join(ids, F.col("_id").eqNullSafe(F.col("_low")), "left_semi").select("text")

    def run(batches):
        for batch in batches:
            for sets in _in_chunks(batch.column(0).to_pylist(), size):
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([_set_names(sets), lists], names=["node", "s"])

    sets = texts.mapInArrow(run, "node binary, s array<bigint>")
    return sets.join(ends, "node", "left_semi").dropDuplicates(["node"])


def _alike(a: str, b: str, least: float) -> Column:
    """Whether two sets have a Jaccard similarity of ``least``; their sizes are looked at first."""
    m, n = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    return (F.least(m, n) >= F.greatest(m, n) * (least - 1e-9)) & (common / (m + n - common) >= least)


def block_masks(blocks: int, together: int) -> list[int]:
    """Bit masks of all combinations of ``together`` out of ``blocks`` near-equal blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, together)]


def _signed(word: int) -> int:
    return word - (1 << 64) if word >= 1 << 63 else word


def _dealt(prints: DataFrame, blocks: int, together: int) -> DataFrame:
    """A row per node and block key: the columns of ``prints`` but ``fp``, and ``p``, ``n``, ``k``.

    ``p`` is the fingerprint.
    """
    keys = [
        F.struct(F.lit(n).alias("n"), F.get("fp", F.lit(0)).bitwiseAND(F.lit(_signed(mask))).alias("k"))
        for n, mask in enumerate(block_masks(blocks, together))
    ]
    looked = prints.withColumn("p", F.get("fp", F.lit(0)))
    rest = [c for c in looked.columns if c != "fp"]
    return looked.select(*rest, F.explode(F.array(*keys)).alias("x")).select(*rest, "x.n", "x.k")


def components(prints: DataFrame, distance: int, blocks: int, together: int) -> DataFrame:
    """``node`` and ``component`` of distinct fingerprints (``node``, ``fp``).

    A group of g fingerprints close to each other has about g * g / 2 links, and nothing
    needs them all. So every bucket first links its members to its least one only, and the
    components of these stars are found. Then all pairs of a bucket that are still in
    different components are compared: no link between components is lost, and a group that
    the stars have joined costs nothing more. That join checks whole fingerprints itself, so
    a large group just beyond the distance makes no rows.

    Spark sizes dealt rows as the nodes they come from, many times too low, and would broadcast
    them through the driver. So the joins of dealt rows ask for a merge.
    """
    stage = Staging(prints.sparkSession, "simhash")
    look = lambda p: F.bit_count(F.col("p").bitwiseXOR(F.col(p)))
    dealt = _dealt(prints, blocks, together)
    first = dealt.groupBy("n", "k").agg(F.min(F.struct("node", "p")).alias("m"), F.count("*").alias("c"))
    first = first.where("c > 1").select(
        F.col("n").alias("n2"), F.col("k").alias("k2"), F.col("m.node").alias("b"), F.col("m.p").alias("p2")
    )
    first = stage.keep(first, "leaders")
    key = (F.col("n") == F.col("n2")) & (F.col("k") == F.col("k2"))
    star = dealt.hint("merge").join(first, key & (F.col("node") != F.col("b")) & (look("p2") <= distance))
    star = connected_components(star.select(F.col("node").alias("a"), "b").distinct())
    rough = prints.join(star, "node", "left").withColumn("part", F.coalesce("component", "node"))
    rough = stage.keep(rough.select(*prints.columns, "part"), "parts")
    stage.drop(first)

    met = _dealt(rough, blocks, together).select("n", "k", "part", "p")
    other = met.select(
        F.col("part").alias("part2"), F.col("n").alias("n2"), F.col("k").alias("k2"), F.col("p").alias("p2")
    )
    across = met.hint("merge").join(other, key & (F.col("part") < F.col("part2")) & (look("p2") <= distance))
    merged = connected_components(across.select("part", "part2").distinct(), "part", "part2")
    return _joined(rough.select("node", "part"), merged)


def _joined(rough: DataFrame, merged: DataFrame) -> DataFrame:
    """``node`` and ``component``, given the components of its parts."""
    merged = merged.withColumnRenamed("node", "part")
    joined = rough.join(merged, "part", "left")
    return joined.select("node", F.coalesce("component", "part").alias("component"))


def similar_components(
    nodes: DataFrame,
    blocks: int,
    distance: int,
    similarity: float,
    sets_of: Callable[[DataFrame], DataFrame],
    stage: Staging,
) -> DataFrame:
    """``node`` and ``component`` of distinct sets, linked from a Jaccard ``similarity`` on.

    ``nodes`` has ``node`` and the blocks; ``sets_of`` gives the sets of a table of nodes. As in
    ``components``, stars come first: each node asks for the closest leader of its buckets. Then
    all pairs of a bucket in different components are compared; only buckets that hold several
    components carry fingerprints and sets. That join itself checks the Hamming distance and then
    the sets, so texts that are almost similar enough make no rows, however many they are.

    Many texts around the threshold of each other are left apart by one star, and the links
    between them grow with the square of their number. So the large buckets are starred again,
    each round with twice as many drawn leaders as before and every node linked to all that it is
    similar to. A round's links tell how many links between components there are; the rounds end
    when these are no more than the rows of the large buckets. Whatever they leave apart is
    compared as a whole, so they lose no link.
    """
    words = [f"f{i}" for i in range(blocks)]
    deal = lambda df, *more: df.select(
        "node", *more, F.posexplode(F.array(*words)).alias("n", "k")
    )
    dealt = deal(nodes)
    first = dealt.groupBy("n", "k").agg(F.min("node").alias("b"), F.count("*").alias("c"))
    first = stage.keep(first.where("c > 1").drop("c"), "leaders")
    star = dealt.join(first, ["n", "k"]).where(F.col("node") != F.col("b"))
    star = stage.keep(star.select(F.col("node").alias("a"), "b").distinct(), "star")
    left = nodes.select(F.col("node").alias("a"), F.array(*words).alias("fa"))
    right = nodes.select(F.col("node").alias("b"), F.array(*words).alias("fb"))
    each = F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    d = F.aggregate(each, F.lit(0), lambda s, x: s + x)
    near = star.join(left, "a").join(right, "b").select("a", "b", d.alias("d")).where(F.col("d") <= distance)
    near = stage.keep(near.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b")), "near")
    stage.drop(first, star)
    sets = stage.keep(sets_of(near.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    links = near.join(left, "a").join(right, "b").where(_alike("sa", "sb", similarity)).select("a", "b")
    # Every node has at most one link, to a leader, which is smaller.
    links = tree_roots(links)
    rough = nodes.join(links, "node", "left").select("node", F.coalesce("component", "node").alias("part"))
    rough = stage.keep(rough, "parts")
    stage.drop(near, sets)

    met = stage.keep(_of_several_parts(deal(nodes.join(rough, "node"), "part")), "met")
    looks = nodes.select("node", *words).join(sets_of(met.select("node").distinct()), "node")
    looks = stage.keep(looks, "looks")
    apart = sum(F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words)

    def linked(rows: DataFrame, other: DataFrame, pairs: Column) -> DataFrame:
        """Links between ``rows`` and ``other`` of the same bucket; only they leave the join."""
        side = lambda df, end: df.join(looks, "node").select(
            *[F.col(c).alias(f"{c}_{end}") for c in (*df.columns, *words, "s")]
        )
        same = (F.col("n_a") == F.col("n_b")) & (F.col("k_a") == F.col("k_b"))
        close = (apart <= distance) & _alike("s_a", "s_b", similarity)
        return side(rows, "a").join(side(other, "b"), same & pairs & close)

    heads = 1
    while True:
        large = met.where(F.col("c") > SMALL)
        found = linked(large, _drawn(large, heads), F.col("part_a") != F.col("part_b"))
        found = stage.keep(found.select("part_a", "part_b", "c_a"), "found")
        seen = found.agg(F.count("*").alias("n"), F.sum("c_a").alias("c")).first()
        if seen.n == 0:
            stage.drop(found)
            break
        # Of all links of a bucket of c nodes, about 2 * heads / c have a drawn end.
        enough = seen.c / (2 * heads) <= large.count()
        merged = connected_components(found.select("part_a", "part_b").distinct(), "part_a", "part_b")
        before = (found, rough, met)
        rough = _joined(rough, merged).withColumnRenamed("component", "part")
        rough = stage.keep(rough, "parts")
        met = stage.keep(_of_several_parts(met.drop("part", "c").join(rough, "node")), "met")
        stage.drop(*before)
        if enough:
            break
        heads *= 2

    # A pair that shares several blocks is looked at in the first of them only.
    earlier = [(F.col("n_a") > i) & (F.col(f"{w}_a") == F.col(f"{w}_b")) for i, w in enumerate(words)]
    slim = met.drop("c")
    across = linked(slim, slim, (F.col("part_a") < F.col("part_b")) & ~reduce(or_, earlier))
    merged = connected_components(across.select("part_a", "part_b").distinct(), "part_a", "part_b")
    out = stage.keep(_joined(rough, merged), "components")
    stage.drop(rough, met, looks)
    return out


def _of_several_parts(dealt: DataFrame) -> DataFrame:
    """Rows of buckets (``n``, ``k``) that hold several parts, with ``c``, their number of rows."""
    mixed = dealt.groupBy("n", "k").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("c")
    )
    return dealt.join(mixed.where("low < high").select("n", "k", "c"), ["n", "k"])


def _drawn(met: DataFrame, count: int) -> DataFrame:
    """Up to ``count`` rows of every bucket: ``n``, ``k``, ``node`` and ``part``, drawn by a hash.

    They are partial minima, so no bucket is sorted or held as a whole.
    """
    h = F.xxhash64("node", "n", F.lit(count))
    drawn = met.groupBy("n", "k", F.pmod(h, F.lit(count)).alias("slot"))
    drawn = drawn.agg(F.min(F.struct(h.alias("h"), "node", "part")).alias("m"))
    return drawn.select("n", "k", "m.node", "m.part")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    distance: int = DISTANCE,
    blocks: int = BLOCKS,
    together: int | None = None,
) -> DataFrame:
    """``id``, ``fp`` and ``component_id`` (smallest id reachable) of every input row.

    Null and empty texts have the fingerprint zero and link like any other. Rows with the
    same fingerprint are one node, so thousands of copies cost one. ``together`` defaults
    to ``blocks - distance``, which misses no pair; a smaller value costs fewer, a larger
    one more selective keys. Where ``together`` exceeds ``blocks - distance`` a pair can be
    missed. A null key is never a component's id unless nothing else is in it.
    """
    together = blocks - distance if together is None else together
    prints = keep(fingerprints(docs, key, text, size), "simhash-prints")
    prints = prints.withColumn("node", F.get("fp", F.lit(0)))
    nodes = keep(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.min("id").alias("low")), "simhash-nodes")
    parts = components(nodes.drop("low"), distance, blocks, together)
    return _labelled(prints.select("id", "fp", "node"), nodes, keep(parts, "simhash-components"))


def _labelled(prints: DataFrame, nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of ``prints`` with the smallest id of their component, without their node."""
    labelled = nodes.select("node", "low").join(parts, "node")
    least = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    member = labelled.join(least, "component").select(F.col("node").alias("_node"), "component_id")
    member = keep(member, "simhash-members")
    return prints.join(member, F.col("node") == F.col("_node")).drop("node", "_node")


def similar_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = 5,
    similarity: float = 0.8,
    blocks: int = 10,
    distance: int = 240,
) -> DataFrame:
    """``id`` and ``component_id`` (smallest id reachable) of every input row.

    Two texts are linked if their sets of distinct ``size``-word shingles have a Jaccard
    similarity of ``similarity``. Blocks and Hamming distance only propose: a pair at exactly
    0.8 shares one of ten blocks with probability 0.999, and about 87 of their 640 bits
    differ (standard deviation 30). Each proposed link is confirmed on the sets. A group of g
    texts just below the threshold still costs g * g comparisons within its buckets.

    Texts with the same set are one node, so thousands of copies cost one; null and empty
    texts are one. A text with fewer words has one shingle of all of them. A null key is
    never a component's id unless nothing else is in it. Keys are taken to identify rows.
    """
    stage = Staging(docs.sparkSession, "similar")
    prints = stage.keep(set_fingerprints(docs, key, text, size, blocks), "prints")
    own = [F.max(f"f{i}").alias(f"f{i}") for i in range(blocks)]
    nodes = stage.keep(prints.groupBy("node").agg(*own, F.min("id").alias("low")), "nodes")
    ids = stage.keep(prints.select("id", "node"), "ids")
    stage.drop(prints)

    def sets_of(ends: DataFrame) -> DataFrame:
        return shingle_sets(ends, nodes, docs, key, text, size)

    parts = similar_components(nodes.drop("low"), blocks, distance, similarity, sets_of, stage)
    out = _labelled(ids, nodes, parts)
    stage.drop(nodes, parts)
    return out


def one_of_each(docs: DataFrame, classes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that stand for their near-duplicate class, all columns kept.

    The row whose key is the class's smallest stays. ``classes`` comes from an operator
    above over the same rows; keys are taken to identify rows. Rows that share a key are one
    document and share its fate; rows with a null key stay.
    """
    gone = classes.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("gone")).distinct()
    rows = docs.select(whole(docs))
    return rows.join(gone, F.col(f"row.`{key}`") == F.col("gone"), "left_anti").select("row.*")
