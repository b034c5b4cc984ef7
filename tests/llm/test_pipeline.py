import random

import corpus_pipeline
from sluice.llm import decontaminate, secrets
from sluice.llm.common import keep, table


def test_each_stage_takes_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = keep(stage(spark, docs, sf_dir), "test-stage")
        assert left.columns == columns, name
        assert 0 < left.count() <= docs.count(), name
        docs = left
    bench = table(spark, sf_dir, "benchmark")
    assert decontaminate.judged(decontaminate.find_matches(docs, bench)).where("contaminated").count() == 0
    assert secrets.scan_secrets(docs).where("size(base) > 0").count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert mixed.where("taken <= 0 or taken > 2 * size").count() == 0


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def classes_of(spark, texts):
    """The id that stands for each text in the near-dedup stage, where all but pairs are unlike."""
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()}


def test_near_dedup_finds_pairs_from_the_threshold_on(spark):
    rng = random.Random(4)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts, wanted = [], []
    # Distinct shingles of each text and of both: 240 / 300 = 0.80 and so on to 340 / 400 = 0.85.
    for n, common in [(270, 240)] * 300 + [(370, 335)] * 60 + [(370, 340)] * 60 + [(270, 239)] * 150:
        base = word(common + 4)
        texts += [" ".join(base + word(n - common)) for _ in range(2)]
        wanted.append(jaccard(*texts[-2:]) >= 0.8)
    assert wanted.count(True) == 420
    left = classes_of(spark, texts)
    assert set(range(0, len(texts), 2)) <= left
    gone = [2 * i + 1 not in left for i in range(len(wanted))]
    assert not any(g and not w for g, w in zip(gone, wanted))
    assert sum(gone[:300]) >= 0.98 * 300 and sum(gone) >= 0.98 * 420


def test_near_dedup_counts_repeated_shingles_once(spark):
    rng = random.Random(8)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    often = word(10)
    texts = [" ".join(word(504) + often * 40) for _ in range(12)]
    assert max(jaccard(texts[0], t) for t in texts[1:]) < 0.05
    assert classes_of(spark, texts + texts[:2]) == set(range(12))
