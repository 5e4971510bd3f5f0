import itertools

import numpy as np
import pytest

import corpus_pipeline
from sylva.llm import jaccard, packing, quality, simhash


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "exact_dedup", "near_dedup", "mixture", "packing"]
    now, seen = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf).cache()
        assert now.columns == docs.columns
        seen.append(now.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    assert len({r.component_id for r in simhash.near_duplicates(now).collect()}) == seen[-1]
    assert all(r.predicted for r in quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).join(now.select("doc_id"), "doc_id").collect())
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in now.collect()}
    assert all(r.length <= packing.CAPACITY for r in out)


def shingled(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize(("hot", "nulls"), [(jaccard.HOT, True), (2, False)])
def test_near_stage_links_all_texts_of_similarity_four_fifths(spark, monkeypatch, hot, nulls):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rng = np.random.default_rng(6)
    vocab = [f"w{k}" for k in range(300)]
    common = " ".join(rng.choice(vocab, 25))  # a passage of many texts
    texts = [" ".join(rng.choice(vocab, rng.integers(3, 220))) + (" " + common if k % 3 == 0 else "") for k in range(60)]
    for k in range(90):
        w = texts[int(rng.integers(0, len(texts)))].split(" ")
        for _ in range(int(rng.integers(1, 6))):
            w[int(rng.integers(0, len(w)))] = "edited"
        texts.append(" ".join(w))
    rows = [(k, t) for k, t in enumerate(texts)] + [(200, None), (201, " "), (202, texts[5].upper().replace(" ", "\n")), *([(None, texts[6]), (None, "alone here")] if nulls else [])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, root = [shingled(t) for _, t in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            old, new = root[j], root[i]
            root = [new if r == old else r for r in root]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = sorted((k for (k, _), r in zip(rows, root) if k is not None and k == least[r]))
    assert 60 < len(want) < 140
    got = [r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()]
    assert sorted(k for k in got if k is not None) == want and got.count(None) == nulls
    assert corpus_pipeline.near(spark, df.limit(0), "").count() == 0
