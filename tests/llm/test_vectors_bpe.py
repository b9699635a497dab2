"""Vector codes, ball clusters and the word tokenizer against brute force and the library, on small tables and odd rows."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest

from fuelgrid.llm import ball_clusters, vector_codes, word_bpe

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("word_bpe_49k.json")


def floors(v, scale):
    return [math.floor(x * scale) for x in v]


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def sha(numbers):
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def slow_codes(rows, parts=16, entries=64, rounds=2):
    """vec_id -> (code, error, label_error), and the codebooks' digest, with plain loops over (vec_id, vector, label)."""
    fine = [(i, floors(v, 256), label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    size = len(fine[0][1]) // parts
    piece = lambda v, p: v[p * size : (p + 1) * size]
    books = [[piece(v, p) for _, v, _ in sorted(fine, key=lambda r: (r[0], r[1]))[:entries]] for p in range(parts)]
    near = lambda v, book: min((apart(v, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = [[] for _ in book]
            for _, v, _ in fine:
                mine[near(piece(v, p), book)[1]].append(piece(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(mine, book)]
    found = [(i, [near(piece(v, p), b) for p, b in enumerate(books)], label) for i, v, label in fine]
    sums = {}
    for _, f, label in found:
        sums[label] = sums.get(label, 0) + sum(d for d, _ in f)
    return sorted((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), sums[label]) for i, f, label in found), sha(x for b in books for e in b for x in e)


def slow_clusters(rows, k=8, rounds=10):
    fine = [(i, floors(v, 1024)) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    m = [v for _, v in sorted(fine, key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())[:k]]
    near = lambda v: min((apart(v, c), j) for j, c in enumerate(m))
    for _ in range(rounds):
        mine = [[] for _ in m]
        for _, v in fine:
            mine[near(v)[1]].append(v)
        m = [[sum(c) // len(x) for c in zip(*x)] if x else c for x, c in zip(mine, m)]
    found = [(i, *near(v)) for i, v in fine]
    each = [sum(d for _, d, j in found if j == c) for c in range(len(m))]
    return sorted((i, j, d, each[j], sum(each), sha(m[j])) for i, d, j in found)


@pytest.fixture(scope="module")
def some(spark):
    """A few hundred vectors with copies, ties, holes, odd lengths and a clashing column."""
    rnd = random.Random(5)
    rows = [(k, [round(rnd.gauss(0, 0.2), 2) for _ in range(64)], rnd.choice([None, 0, 1])) for k in range(150)]
    rows += [(200 + k, [0.25] * 64, 7) for k in range(80)] + [(7, [0.5, -0.5] * 32, 2)]
    odd = [(300, None, 1), (301, [0.1] * 63 + [None], 1), (302, [float("nan")] + [0.1] * 63, 1), (303, [float("-inf")] * 64, 1), (304, [], 1), (305, [0.1] * 48, 1)]
    return spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, code string"), rows


def floats(rows):
    return [(i, [float(np.float32(x)) for x in v], *rest) for i, v, *rest in rows]


def test_vector_codes_equal_brute_force(spark, some):
    df, rows = some
    coded, books = vector_codes.compress(df)
    want, digest = slow_codes(floats(rows))
    assert sorted((r.id, r.code, r.error) for r in coded.collect()) == [w[:3] for w in want] and vector_codes.digest(books) == digest
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want, digest = slow_codes([(r.vec_id, r.embedding, r.label) for r in table.collect()])
    got = vector_codes.op11_vector_codes(spark, SF).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == want and {r.codebooks_sha256 for r in got} == {digest}


def test_nearest_entry_equals_all_distances():
    rnd = np.random.default_rng(1)
    for size, k, spread in ((4, 64, 3), (1, 5, 2), (8, 256, 200), (4, 1, 9)):
        x, book = rnd.integers(-spread, spread, (500, size)), rnd.integers(-spread, spread, (k, size))
        every = ((x[:, None] - book[None]) ** 2).sum(2)
        entry, d = vector_codes.nearest(x, book)
        assert (entry == every.argmin(1)).all() and (d == every.min(1)).all()


def test_vector_codes_come_back(some):
    coded, books = vector_codes.compress(some[0])
    back = {r.id: r.vec for r in vector_codes.decode(coded.filter("id != 7"), books).collect()}
    error = {r.id: r.error for r in coded.collect()}
    for i, v, _ in floats(some[1]):
        if i != 7:
            assert apart(floors(back[i], 256), floors(v, 256)) == error[i]


def test_ball_clusters_equal_brute_force(spark, some):
    for k in (8, 3):
        got, _ = ball_clusters.cluster(some[0], k=k)
        assert sorted(tuple(r) for r in got.collect()) == sorted((i, j, d) for i, j, d, *_ in slow_clusters([r[:2] for r in floats(some[1])], k))
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = ball_clusters.op12_ball_clusters(spark, SF).collect()
    assert sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == slow_clusters([(r.vec_id, r.embedding) for r in table.collect()])


def test_balls_are_assigned_whole_and_exactly():
    rnd = np.random.default_rng(2)
    hubs = rnd.integers(-900, 900, (6, 64))
    x = np.concatenate([hubs[k % 6] + rnd.integers(-40, 40, 64)[None] for k in range(3000)] + [np.tile(hubs[0], (500, 1))])
    tree, order = ball_clusters.Tree.grow(x)
    tree = ball_clusters.Tree.unpacked(len(x), 64, *tree.packed())
    assert (tree.points == x[order]).all()
    m = np.concatenate([hubs, hubs[:1], x[:1]])
    want = ((tree.points[:, None] - m[None]) ** 2).sum(2).argmin(1)
    assert (tree.labels(m) == want).all()
    n, total = tree.sums(m)
    assert (n == np.bincount(want, minlength=8)).all() and all((total[k] == tree.points[want == k].sum(0)).all() for k in range(8))
    balls, rows = tree.filtered(m)
    assert sum((tree.high - tree.low)[nodes].sum() for nodes, _ in balls) > 0.5 * len(x)


def test_vectors_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 1)], [(None, [0.5] * 64, None), (None, [0.5] * 64, None)], [(1, [1e30, -1e30] * 32, 1), (2, [3.0] * 64, 1)]):
        df = spark.createDataFrame(rows, schema)
        kept = sum(v is not None for _, v, _ in rows)
        assert vector_codes.compress(df)[0].count() == kept and ball_clusters.cluster(df)[0].count() == kept


POOL = ["a", "b", " ", "  ", "\n", "\t", "　", "\x85", "\x1c", "́", "é", "e", "̈", "'s", "'t", "'", "<|endoftext|>", "<|", "|>", "1", "23", "!?", "...", "你好", "ﬁ", "İ", "Σ", "🏽", "👍", "‍", "word", "the quick ", "가", "ᆨ", "ᅡ", "\x00", "end. And", "J̌", "퟿"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@pytest.mark.parametrize("bits", [2, 5, 7])
def test_joins_agree_with_the_library(library, monkeypatch, bits):
    monkeypatch.setattr(word_bpe, "CUT_BITS", bits)
    rnd = random.Random(bits)
    texts = ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 150))) for _ in range(1500)] + [None, "", "x" * 20_000, "é" * 9000, "ab " * 9000]
    own = word_bpe.Encoder(BPE)
    decode = word_bpe.Decoder(BPE).decode
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        ids, n = own.encode(part)
        for t, got in zip(part, np.split(ids, np.cumsum(n)[:-1])):
            want = library.encode(t or "", add_special_tokens=False).ids
            assert got.tolist() == want and decode(want) == library.decode(want, skip_special_tokens=False)


def test_shared_passages_share_chunks():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    passage = " ".join(words[:1500]).encode()
    one, two = passage, " ".join(words[1500:]).encode() + passage
    parts = [{t[a:b] for a, b in zip(at, at[1:])} for t in (one, two) for at in [word_bpe.cuts(t).tolist()]]
    assert len(parts[0] & parts[1]) >= len(parts[0]) - 3
    assert all(len(c) <= word_bpe.LONGEST for c in parts[0] | parts[1])


def test_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(word_bpe, "CHUNKS_REMEMBERED", 3)
    monkeypatch.setattr(word_bpe, "WORDS_REMEMBERED", 60)
    own = word_bpe.Encoder(BPE)
    for k in range(30):
        t = " ".join(f"word{k}x{j} plain" for j in range(40))
        assert own.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_word_bpe_digests_equal_the_library(spark, library):
    got = {r.doc_id: r for r in word_bpe.op13_word_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == want


def test_word_bpe_takes_odd_rows(spark, library):
    rows = [(None, "a  b", "n"), (3, None, "n"), (3, "", "n"), (3, "a  b", "n"), (9, "word " * 30_000, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = word_bpe.encode(df, BPE)
    assert sorted(tuple(r.ids) for r in got.collect()) == sorted(tuple(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows)
    texts = sorted(r.text for r in word_bpe.decode(got, BPE).collect())
    assert texts == sorted(library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t, _ in rows)
    assert word_bpe.digests(word_bpe.encode(df.limit(0), BPE), BPE).count() == 0


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_ball_clusters"])
def test_vector_queries_equal_their_sql(spark, name):
    import duckdb

    from fuelgrid.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
