"""Brute-force tests of the quality classifier, importance resampling and fill-in-middle."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import classifier, importance, middle, queries
from sluice.llm.common import table

# Names the operators use themselves, as extra columns of the input.
CLASHES = (
    "row", "key", "body", "n", "v", "k", "k2", "y", "score", "rank", "at", "before", "wanted", "may",
    "place", "c", "output", "form", "bucket", "n_words", "n_features", "weight",
)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def odd_frame(spark, more=()):
    """Null key, null, empty and long texts, repeated rows, and clashing column names."""
    texts = ["", None, "a b", "É\x00È z", "x " * 400_000, "ab12" * 250_000, "<P>", "\n", "word", "𝒳y \x85"]
    rows = [*enumerate(texts), (None, "one two"), (None, None), (2, "a b"), (2, "a b")]
    rows += [(100 + i, t) for i, t in enumerate(more)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.select("*", *[F.lit("own").alias(c) for c in CLASHES])


def rows_of(frame, *names):
    picked = frame.select("row.doc_id", *names, F.col("row.place").alias("own"))
    return sorted((tuple(r) for r in picked.collect()), key=repr)


# -- fill in middle ---------------------------------------------------------------


def brute_middle(key, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, mid, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(mid), f"<S>{suffix}<P>{prefix}<M>{mid}"
    return len(units), "psm", len(prefix), len(mid), f"<P>{prefix}<S>{suffix}<M>{mid}"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="azAZ@[`{ é漢𝒳\x00\n<PSM>9", max_size=40), min_size=1, max_size=6))
def test_cut_texts_equal_brute_force(texts):
    keys = [str(i) for i in range(len(texts))]
    out = [r for part in middle.transform_texts(pa.array(texts), keys) for r in part.to_pylist()]
    got = [(r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out]
    assert got == [brute_middle(k, t) for k, t in zip(keys, texts)]


def test_cut_texts_of_sliced_batches_and_small_pieces(monkeypatch):
    monkeypatch.setattr(middle, "PIECE_BYTES", 10)
    texts = ["skip", *[f"Ab{i} é{'x' * i}!" for i in range(30)]]
    array = pa.array(texts).slice(1)
    out = [r for part in middle.transform_texts(array, list(range(30))) for r in part.to_pylist()]
    assert [r["output"] for r in out] == [brute_middle(i, t)[4] for i, t in enumerate(texts[1:])]


def test_fill_in_middle_of_odd_rows(spark):
    docs = odd_frame(spark, [f"One two, three {i} <{'PSM'[i % 3]}" for i in range(60)])
    made = middle.fill_in_middle(docs)
    back = middle.restored(F.col("output"), F.col("form")).alias("back")
    got = rows_of(made, "n", "form", "prefix_chars", "middle_chars", "output", back)
    want = []
    for r in docs.select("doc_id", "text").collect():
        found = brute_middle(r.doc_id, r.text)
        want.append((r.doc_id, *found, r.text or "", "own"))
    assert got == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_an_empty_table(spark):
    docs = odd_frame(spark).where("doc_id > 10000")
    assert middle.fill_in_middle(docs).count() == 0


# -- importance resampling --------------------------------------------------------


def brute_grams(text, longest):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), grams


def brute_resample(rows, target, longest, buckets, least_words, share):
    place = lambda g: zlib.crc32(g.encode()) % buckets
    made = [brute_grams(text, longest) for _, text in rows]
    s = Counter(place(g) for _, grams in made for g in grams)
    t = Counter(place(g) for text in target for g in brute_grams(text, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))

    out = []
    for (key, _), (n_words, grams) in zip(rows, made):
        weight = sum(gain(place(g)) for g in grams) // len(grams) if grams else 0
        digest = hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()
        noise = math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 2**32)))
        out.append([key, n_words, len(grams), weight, weight + noise, None])
    may = sorted(
        (r for r in out if r[1] >= least_words),
        key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]),
    )
    for i, r in enumerate(may[: len(may) * share // 100]):
        r[5] = i + 1
    return sorted((tuple(r) for r in out), key=repr)


@pytest.mark.parametrize("longest,buckets,share", [(1, 10_000, 10), (3, 97, 50)])
def test_resampling_equals_brute_force(spark, longest, buckets, share):
    rng = random.Random(5)
    more = [" ".join(rng.choice(["alpha", "Beta", "é漢", "d-e", "9"]) for _ in range(rng.randrange(60))) for _ in range(90)]
    docs = odd_frame(spark, more + more[:5])
    target = spark.createDataFrame([("alpha beta alpha",), (None,), ("",)], "text string")
    got = importance.resample(docs, target, longest=longest, buckets=buckets, share=share)
    got = rows_of(got, "n_words", "n_features", "weight", "score", "rank")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_resample(rows, ["alpha beta alpha", None, ""], longest, buckets, 20, share)
    assert [r[:-1] for r in got] == want
    assert {r[-1] for r in got} == {"own"}


def test_ngrams_never_cross_texts(monkeypatch):
    texts = [b"a b", b"", b"c", b"d E f"]
    found = Counter()
    for owner, bucket in importance.features(texts, 2, 1 << 30):
        found.update(zip(owner.tolist(), bucket.tolist()))
    grams = {0: ["a", "b", "a b"], 2: ["c"], 3: ["d", "e", "f", "d e", "e f"]}
    assert found == Counter((i, zlib.crc32(g.encode()) % (1 << 30)) for i, gs in grams.items() for g in gs)


def test_resampling_of_empty_tables(spark):
    docs, none = odd_frame(spark), spark.createDataFrame([], "text string")
    assert importance.resample(docs.where("doc_id > 10000"), none).count() == 0
    drawn = importance.resample(docs, none)
    assert drawn.count() == docs.count()


# -- quality classifier -----------------------------------------------------------


def brute_words(hasher, text):
    out = []
    for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9\t-\r ]+", text.encode()):
        out.append(int(hasher.words(m.group())[0]))
    return [hasher.again if i and w == out[i - 1] else w for i, w in enumerate(out)]


def test_word_buckets_depend_on_the_word_alone(monkeypatch):
    monkeypatch.setattr(classifier, "PIECE_BYTES", 16)
    hasher = classifier.Hasher(1 << 12)
    texts = ["", "a b a", "Über 12ab!! AB ab", "x" * 100 + " y", "so so so !! !!", " ", "z" * 16 + "." * 40]
    for size in (1, 3, len(texts)):
        got = []
        for i in range(0, len(texts), size):
            for words, counts in classifier.batches_of_words(pa.array(texts[i : i + size]), hasher):
                got += [w.tolist() for w in np.split(words, np.cumsum(counts)[:-1])]
        assert got == [brute_words(hasher, t) for t in texts]
    assert hasher.words(b"AB") != hasher.words(b"ab") and hasher.words(b"Ab") == hasher.words(b"ab")


def test_context_sums_equal_brute_force(spark):
    texts = ["a b c a", None, "", "b b c", "d"] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {r.bucket: (r.n, r.v) for r in classifier.context_sums(docs, "text", 64, 8).collect()}
    places, signs = classifier.index_vectors(64, 8)
    hasher = classifier.Hasher(64)
    want = {}
    for text in texts:
        words = brute_words(hasher, text or "")
        for i, w in enumerate(words):
            n, v = want.get(w, (0, np.zeros(8)))
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if j != i:
                    v = v + np.bincount(places[words[j]], signs[words[j]], 8)
            want[w] = (n + 1, v)
    assert got.keys() == want.keys()
    assert all(got[w][0] == want[w][0] and got[w][1] == want[w][1].tolist() for w in want)


def test_pooling_equals_a_plain_mean():
    rng = np.random.default_rng(1)
    words = classifier.Words(rng.random((50, 4), np.float32), rng.random(50, np.float32) + 0.1)
    buckets, counts = rng.integers(0, 50, 9007).astype(np.int32), np.array([5, 0, 9000, 2])
    got = words.pooled(buckets, counts)
    assert not got[1].any()
    for i, part in enumerate(np.split(buckets, np.cumsum(counts)[:-1])):
        if len(part):
            w, v = words.weights[part], words.vectors[part]
            mean = np.average(v, 0, w)
            spread = np.sqrt(np.average((v - mean) ** 2, 0, w))
            assert np.allclose(got[i], np.concatenate((mean, spread)), atol=1e-4)


def test_classifier_is_right_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op11_quality_classifier(spark, folder)
    labels = table(spark, folder, "labels")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 40 and len(bad) > 5
    assert np.mean([r.predicted for r in good]) >= 0.97
    assert np.mean([1 - r.predicted for r in bad]) >= 0.8
    assert all(r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_classifier_learns_no_held_out_label(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} and !!") for i in range(200)], "doc_id long, text string")
    out = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = spark.createDataFrame([(i, int(i not in out)) for i in range(200)], "doc_id long, quality int")
    model = classifier.fit(docs, labels, buckets=256, size=8)
    assert model.network is None and model.base == 1.0


def test_classifier_of_odd_and_empty_tables(spark):
    docs = odd_frame(spark, ["good words here"] * 20 + ["@@ ## $$"] * 20)
    labels = spark.createDataFrame(
        [(100 + i, int(i < 20)) for i in range(40)] + [(None, 1), (3, None), (100, 1)], "doc_id long, quality int"
    )
    model = classifier.fit(docs, labels, buckets=256, size=8)
    rows = rows_of(classifier.classify(docs, model), "score")
    assert len(rows) == docs.count() and all(0 <= r[1] <= 1 and r[2] == "own" for r in rows)
    by_key = {r[0]: r[1] for r in rows}
    assert by_key[100] > 0.5 > by_key[139] and by_key[0] == by_key[1]
    nothing = docs.where("doc_id > 10000")
    assert classifier.classify(nothing, model).count() == 0
    empty = classifier.fit(nothing, labels.where("doc_id < 0"), buckets=256, size=8)
    assert {r[1] for r in rows_of(classifier.classify(docs, empty), "score")} == {0.5}


def test_temperature_spreads_overconfident_logits():
    y = np.array([1.0, 0.0, 1.0, 1.0])
    assert classifier.fit_temperature(np.array([9.0, 9.0, 9.0, 9.0]), y) > 4
    assert classifier.fit_temperature(np.zeros(0), np.zeros(0)) == 1.0
