"""Classes by exact Jaccard similarity where many unlike texts share passages, against all pairs."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from fuelgrid.llm import shingles


def jaccard(a, b):
    return len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b)))


def slow_classes(texts, width=5, similarity=0.8):
    sets = [shingles.shingle_set(t, width) for t in texts]
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if np.array_equal(sets[i], sets[j]) or jaccard(sets[i], sets[j]) >= similarity - 1e-12:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(k) for k in range(len(texts))]


def texts_with_passages(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passages = [" ".join(word() for _ in range(n)) for n in (60, 60, 30, 12)]
    out = []
    for _ in range(140):
        parts = rnd.sample(passages, rnd.randint(1, 3)) + [" ".join(word() for _ in range(rnd.choice((0, 3, 9, 15, 40))))]
        out.append(" ".join(parts))
    for t in rnd.sample(out, 20):
        w = t.split()
        w[rnd.randrange(len(w))] = word()
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [1024, 5])
def test_classes_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    texts = texts_with_passages(block)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(texts))] == slow_classes(texts)


def test_blocks_lose_no_similar_pair():
    rnd = np.random.default_rng(4)
    sets = []
    for _ in range(120):
        base = rnd.integers(0, 1 << 62, rnd.choice([3, 30, 70, 200]))
        sets += [np.unique(np.concatenate([base, rnd.integers(0, 1 << 62, extra)])).astype("<u8") for extra in (0, int(len(base) * 0.2), int(len(base) * 0.6))]
    sizes, roots = np.array([len(s) for s in sets]), np.arange(len(sets))
    i, j = shingles.met_in_block(roots, sizes, roots, np.ones(len(sets), bool), np.zeros(len(sets)), [shingles.parities(s) for s in sets], 0.8)
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    similar = {(a, b) for b in range(len(sets)) for a in range(b) if jaccard(sets[a], sets[b]) >= 0.8}
    assert similar <= found and len(found) == len(i) and len(found) < 2 * len(similar) + 50


def test_the_pipeline_follows_links_of_both_methods(spark):
    import corpus_pipeline
    from fuelgrid.llm import simhash

    # c's shingles of five words are b's, a's SimHash is b's: three in one class; d stays
    words = [f"w{k}" for k in range(40)]
    b, c = " ".join(words), " ".join(words + ["end"])
    a = " ".join(words * 3)
    docs = spark.createDataFrame([(3, a), (2, b), (1, c), (4, "quite another text of other words"), (5, None), (6, "")], "doc_id long, text string")
    both = lambda *m: {r.doc_id: r.component_id for r in simhash.merged(*m)(docs, "doc_id", "text").collect()}
    one = lambda df, k, t: df.select(k, F.when(F.col(k) == 3, 2).otherwise(F.col(k)).cast("long").alias("component_id"))
    two = lambda df, k, t: df.select(k, F.when(F.col(k) == 2, 1).otherwise(F.col(k)).cast("long").alias("component_id"))
    assert both(one, two) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    called, plain = [], simhash.near_duplicates
    simhash.near_duplicates = lambda *x: called.append(1) or plain(*x)
    try:
        kept = sorted(r.doc_id for r in corpus_pipeline.deduplicated(spark, docs, "").collect())
    finally:
        simhash.near_duplicates = plain
    assert called and 4 in kept and 1 in kept and 2 not in kept and not {5, 6} <= set(kept)


def test_what_explode_makes_of_the_sets_is_never_broadcast(spark, monkeypatch):
    """Spark takes the size of the sets' file for that of their shingles, which are many times as large in memory."""
    plans, written = [], shingles.written
    monkeypatch.setattr(shingles, "written", lambda df: plans.append((df.columns, df._jdf.queryExecution().sparkPlan().toString())) or written(df))
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, "quite another text of other words")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    (plan,) = [p for columns, p in plans if columns == ["shingle", "set", "n", "r"]]
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
