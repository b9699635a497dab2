"""The scorer's short cuts change no bit: documents in groups, and places sorted by the upper bits of wide hashes."""

import numpy as np
import pytest

from fuelgrid.llm import lm


def _slowly_ranked(h, doc):
    every, which = np.unique(h, return_inverse=True)
    pairs = list(zip(h.tolist(), doc.tolist()))
    return every, which, [pairs.count(p) for p in pairs], [pairs[:i].count(p) for i, p in enumerate(pairs)]


@pytest.mark.parametrize("top", [10, 1 << 40, (1 << 64) - 8])
def test_ranks_of_hashes_that_differ_in_their_lowest_bits(top):
    rnd = np.random.default_rng(5)
    h = rnd.integers(0, top, 60, dtype=np.uint64)
    h = np.concatenate([h ^ np.uint64(x) for x in (0, 1, 2, 5)])[rnd.integers(0, 240, 300)]
    doc = np.sort(rnd.integers(0, 4, 300)).astype(np.int32)
    for got, want in zip(lm.ranked(h, doc), _slowly_ranked(h, doc)):
        assert got.tolist() == list(want)


@pytest.mark.parametrize("together", [1, 3, 512])
def test_documents_score_alike_in_any_group(monkeypatch, together):
    rnd = np.random.default_rng(6)
    size = rnd.integers(1, 70, 11)
    n = int(size.sum())
    seen = rnd.integers(0, 50, (4, n)).astype(np.float32)
    share = (rnd.random((4, n)) * (seen > 0) / 2).astype(np.float32)
    args = share, seen, rnd.integers(0, lm.BEFORE, n).astype(np.int8), rnd.integers(0, lm.HASHED, n).astype(np.int8), -rnd.integers(1, 90, n).astype("<f4")
    begin, alone = np.cumsum(size) - size, []
    for a, m in zip(begin, size):
        alone += lm.source_log2(np.array([m]), *[x[..., a : a + m] for x in args]).tolist()
    monkeypatch.setattr(lm, "LOCKSTEP", together)
    assert lm.source_log2(size, *args).tolist() == alone
    assert len(lm.source_log2(size[:0], *[x[..., :0] for x in args])) == 0
