"""Shares of counts stay shares when hashes are shared."""

import numpy as np
import pytest

from fuelgrid.llm import lm


@pytest.mark.parametrize("bits", [8, 12, 40])
def test_shares_are_never_above_one(bits):
    rnd = np.random.default_rng(bits)
    texts = [" ".join(f"w{int(k)}" for k in rnd.zipf(1.3, 300) % 500) for _ in range(12)]
    size, doc, hashes = lm.grams(texts, bits)
    every = [np.unique(h) for h in hashes]
    counts = [np.bincount(np.searchsorted(e, h), minlength=len(e)).astype(np.int64) for e, h in zip(every, hashes)]
    learn = np.ones(len(texts), bool)
    (_, share, seen, *_), _ = lm.contexts(size, doc, hashes, counts, np.full(len(every[0]), -20.0), learn, len(doc), bits)
    assert share[seen > 0].max() <= 1 and share.min() >= 0  # a source that knows nothing here is skipped
    log2 = lm.source_log2(size, share, seen, np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), np.full(len(doc), -20.0))
    assert (log2 <= 0).all()


def test_equal_rows_of_different_tasks_score_alike(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "one and the same text " * 40)] * 600 + [(2, "another text of its own")] * 2, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, round(r.score, 6)) for r in lm.score(df, F.lit(True)).collect()}
    assert {i for i, _ in got} == {1, 2} and len(got) == 2


def test_tokens_that_share_32_bits_are_counted_apart(spark):
    from pyspark.sql import functions as F

    a, b = "thndinnt", "leoieau."
    assert lm.hash_of(a.encode(), 32) == lm.hash_of(b.encode(), 32)
    df = spark.createDataFrame([(1, f"{a} {a} {a} x"), (2, b), (3, a)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(df, F.col("doc_id") == 1).collect()}
    n, v = 5, 3  # three of a, x, the end
    assert [(got[i].n_known, got[i].train_tokens) for i in (1, 2, 3)] == [(5, n), (1, n), (2, n)]
    assert got[2].base_score == pytest.approx(np.log10(1 / (n + v + 1)) + np.log10(2 / (n + v + 1)))


def test_another_seed_is_taken_when_tokens_share_a_hash(spark):
    few = spark.createDataFrame([(bytearray(f"w{k}", "ascii"), 1) for k in range(40)], "token binary, c long")
    seed = lm.apart(few, 12)
    hashes = lambda s: len({lm.hash_of(f"w{k}".encode(), 12, s) for k in range(40)})
    assert hashes(seed) == 40 and all(hashes(s) < 40 for s in range(seed))


def test_texts_split_in_arrow_as_by_bytes():
    import pyarrow as pa

    texts = [None, "", " ", "a  B", " a\x1c\x0b\x0cb\u00a0\u2003c\x85 \u00c9", "\ta\n\r b", "x" * 9]
    size, words = lm.split(pa.array(texts, pa.string()))
    assert size.tolist() == [len(lm.tokens(t)) for t in texts]
    assert lm.as_bytes(words) == [w for t in texts for w in lm.tokens(t)[:-1]]
