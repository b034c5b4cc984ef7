import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sluice.llm import components, simhash
from sluice.llm.common import Staging
from sluice.llm.components import connected_components, tree_roots


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        low = low.replace(blank, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [
        xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    out = [None, "", "  \n", "One", "one", "\x85a b", "É é"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 400))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def test_components_equal_brute_force(spark):
    docs = texts()
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, fp int")
    got = {r.id: r for r in simhash.near_duplicates(frame).collect()}
    prints = [brute_fingerprint(t) for t in docs]
    assert [got[i].fp[0] % 2**64 for i in range(len(docs))] == prints
    close = [(a, b) for a, b in combinations(range(len(docs)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert [got[i].component_id for i in range(len(docs))] == union_find(len(docs), close)


def test_chains_of_close_fingerprints_join(spark):
    # Random walks of three flipped bits: neighbours are close, the ends are not.
    rng = random.Random(1)
    values = []
    for _ in range(5):
        v = rng.getrandbits(64)
        for _ in range(30):
            values.append(v)
            for _ in range(3):
                v ^= 1 << rng.randrange(64)
    signed = sorted({simhash._signed(v) for v in values})
    frame = spark.createDataFrame([(v, [v]) for v in signed], "node long, fp array<long>")
    got = {r.node: r.component for r in simhash.components(frame, 4, 7, 3).collect()}
    close = [
        (a, b)
        for a, b in combinations(range(len(signed)), 2)
        if ((signed[a] ^ signed[b]) % 2**64).bit_count() <= 4
    ]
    roots = union_find(len(signed), close)
    assert [got[v] for v in signed] == [signed[r] for r in roots]


def test_dealt_keys_are_not_broadcast(spark, monkeypatch):
    # Spark takes a row per node and key for as small as the nodes, which here are far below its limit.
    plans = []

    def seen(edges, *ends):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return connected_components(edges, *ends)

    monkeypatch.setattr(simhash, "connected_components", seen)
    frame = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    assert simhash.near_duplicates(frame).count() == len(texts())
    assert len(plans) == 2
    assert all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def brute_blocks(hashes, blocks):
    """Majority of the three least mixed hashes of a set, block by block."""
    out = []
    for block in range(blocks):
        mixed = simhash._mixed(np.array(sorted(hashes), np.uint64), block).tolist()
        sample = sorted(mixed)[:3]
        out.append(sum(1 << b for b in range(64) if 2 * sum(z >> b & 1 for z in sample) > len(sample)))
    return out


def test_sampled_blocks_equal_brute_force():
    rng = random.Random(6)
    sets = [{rng.getrandbits(64) for _ in range(n)} for n in (0, 1, 2, 3, 4, 50, 0)]
    got = simhash.sampled_blocks([np.array(sorted(s), np.uint64) for s in sets], 7)
    assert got.tolist() == [brute_blocks(s, 7) for s in sets]


def shingle_set(text):
    words = (text or "").split()
    n = min(5, len(words))
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def test_similar_documents_equal_brute_force_jaccard(spark):
    # Chains of edits: neighbours mostly lie above the threshold, far ones below.
    rng = random.Random(3)
    texts = [None, "", " \n", "one two", "one two", "a b c d e", "x " * 50_000]
    for _ in range(25):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 300))]
        for _ in range(6):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    names = ("node", "a", "b", "gone", "m", "low", "part", "component", "f0", "id", "row")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame = frame.select("*", *[F.lit("own").alias(c) for c in names])
    classes = simhash.similar_documents(frame)
    got = {r.id: r.component_id for r in classes.collect()}
    sets = [shingle_set(t) for t in texts]
    close = [
        (a, b)
        for a, b in combinations(range(len(texts)), 2)
        if sets[a] == sets[b] or (sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    ]
    want = union_find(len(texts), close)
    assert len(set(want)) < len(texts) - 40
    assert [got[i] for i in range(len(texts))] == want
    left = simhash.one_of_each(frame, classes)
    assert left.columns == frame.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want))


def test_similar_documents_of_odd_keys_and_empty_tables(spark):
    rows = [(None, "p q r s t u"), (None, "p q r s t u"), (4, "p q r s t u"), (4, "p q r s t u"), (7, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    classes = simhash.similar_documents(frame)
    got = sorted((tuple(r) for r in classes.collect()), key=repr)
    assert got == sorted([(None, 4), (None, 4), (4, 4), (4, 4), (7, 7)], key=repr)
    assert simhash.one_of_each(frame, classes).count() == 5
    assert simhash.similar_documents(frame.where("doc_id > 9")).count() == 0


def test_long_texts_overflow_no_lane():
    many = np.full(200_001, 2**64 - 1, np.uint64)
    counts = simhash.set_bits(many, np.array([0, 200_000, 200_001]))
    assert counts.tolist() == [[200_000] * 64, [1] * 64]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(frame).count() == 0


def test_connected_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = dict(connected_components(frame).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert connected_components(frame.where(F.lit(False))).count() == 0


def test_connected_components_equal_union_find_on_drawn_graphs(spark):
    rng = random.Random(11)
    for n, m in [(60, 25), (200, 180), (400, 1200)]:
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
        roots = union_find(n, edges)
        assert got == {x: roots[x] for e in edges if e[0] != e[1] for x in e}


def test_connected_components_write_few_tables(spark, monkeypatch):
    # Every table is a query, and its plan, stages and tasks stay in the driver for long.
    made = []

    class Counted(Staging):
        def keep(self, df, label):
            made.append(label)
            return super().keep(df, label)

    monkeypatch.setattr(components, "Staging", Counted)
    stars = spark.createDataFrame([(9 * i, 9 * i + j) for i in range(20) for j in range(1, 9)], "a long, b long")
    assert dict(connected_components(stars).collect()) == {i: i // 9 * 9 for i in range(180)}
    assert made == ["edges", "low"]
    made.clear()
    path = spark.createDataFrame([(i, i + 1) for i in range(4)], "a long, b long")
    assert dict(connected_components(path).collect()) == dict.fromkeys(range(5), 0)
    assert len(made) <= 10


def test_roots_of_trees_equal_components(spark, monkeypatch):
    made = []

    class Counted(Staging):
        def keep(self, df, label):
            made.append(label)
            return super().keep(df, label)

    monkeypatch.setattr(components, "Staging", Counted)
    rng = random.Random(12)
    up = {i: i - 1 for i in range(1, 30)} | {i: 100 for i in range(101, 180)}
    up |= {i: rng.randrange(200, i) for i in range(201, 260)}
    frame = spark.createDataFrame(list(up.items()), "a long, b long")
    roots = union_find(260, up.items())
    assert dict(tree_roots(frame).collect()) == {i: roots[i] for i in up}
    assert len(made) <= 7
    assert tree_roots(frame.where("a < 0")).count() == 0


def test_staging_forgets_what_it_drops(spark):
    stage = Staging(spark, "test-forget")
    kept = [stage.keep(spark.range(n), "same") for n in (1, 2, 3)]
    stage.drop(kept[0], kept[2])
    assert [frame is kept[1] for frame, _ in stage.kept] == [True]
    again = stage.keep(spark.range(4), "same")
    assert (kept[1].count(), again.count()) == (2, 4)


def test_a_large_group_around_the_threshold_makes_few_links(spark, monkeypatch):
    # Each copy has three words of its own: about half of all pairs are similar enough.
    rng = random.Random(8)
    base = [f"w{i}" for i in range(245)]
    texts = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(0, 245), 3):
            words[at] = f"own{i}"
        texts.append(" ".join(words))
    seen = []
    real = simhash.connected_components

    def counted(edges, *ends):
        seen.append(edges.count())
        return real(edges, *ends)

    monkeypatch.setattr(simhash, "connected_components", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in simhash.similar_documents(frame).collect()}
    sets = [shingle_set(t) for t in texts]
    pairs = combinations(range(len(texts)), 2)
    close = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(close) > 10_000
    assert [got[i] for i in range(len(texts))] == union_find(len(texts), close)
    assert max(seen) <= 3 * len(texts)
