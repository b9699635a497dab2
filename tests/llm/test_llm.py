"""The training-data operators against brute force, round trips and held-out accuracy, on small tables and odd rows."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fuelgrid.llm import chat, classifier, fingerprints, licenses, lm, mixing, pieces, quality_rules, shingles, simhash, token_files

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
ODD = [(3, "a  b\n\n c  "), (None, " B  　 x y   z \x85 q"), (3, ""), (5, None), (5, None), (9, "ﬁne don't 's Straße\t t" * 40), (10, "word " * 9000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", None) for i, t in ODD], "doc_id long, text string, fp string, source string")


def texts(df):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    return sorted(((r.doc_id, r.text or "") for r in df.collect()), key=key)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def canon(t):
    t = t.lower() if t.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).upper().lower())
    return " ".join(t.split())


def test_fingerprints_equal_brute_force(docs):
    own = texts(docs)
    got = {r.doc_id: r for r in fingerprints.edited(docs).collect()}
    for k, (i, t) in enumerate(own):
        after, n = own[(k + 1) % len(own)][1], len(t) // 4
        e = t[: len(t) - n] + after[:n]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert got[i].near_edited == (canon(e) == canon(t)) and got[i].near_next == (canon(after) == canon(t))


@pytest.mark.parametrize("bits", [64, 1])
def test_fingerprints_stand_for_one_canonical_text(spark, odd, bits):
    more = odd.union(spark.createDataFrame([(11, "FINE  don't 's STRASSE\t t" * 40, "", "")], odd.schema))
    got = fingerprints.fingerprints(more, bits=bits).join(more.select("doc_id", "text"), "doc_id").collect()
    by = defaultdict(set)
    for r in got:
        if list(i for i, _ in ODD).count(r.doc_id) == 1:
            by[r.fingerprint].add(canon(r.text or ""))
    assert all(len(x) == 1 for x in by.values()) and fingerprints.fingerprints(more, bits=bits).count() == more.count()
    assert len({r.fingerprint for r in got if r.doc_id in (9, 11)}) == 1


def simhash_of(t):
    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in words(t)]
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def test_simhash_classes_equal_brute_force(docs):
    own = texts(docs)
    fp = {i: simhash_of(t) for i, t in own}
    near = defaultdict(set)
    for i in fp:
        for j in fp:
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                near[i].add(j)
    want = {}
    for i in sorted(fp):
        stack = [i] if i not in want else []
        while stack:
            for j in near[stack.pop()]:
                if j not in want:
                    want[j] = i
                    stack.append(j)
    got = {r.doc_id: r for r in simhash.op2_simhash(docs.sparkSession, SF).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(int(r.fingerprint, 16) == fp[i] for i, r in got.items())
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(want.values())


def test_simhash_links_chains_within_two_bits(spark):
    base = 0x0F0F0F0F0F0F0F0F
    fps = [base, base ^ 3, base ^ 15, base ^ 63, base ^ (1 << 62), base ^ (127 << 40)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    root = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    assert len({root[x] for x in fps[:5]}) == 1 and fps[5] not in root


def test_pieces_equal_the_library_and_come_back(spark, docs, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for df in (docs, odd):
        got = pieces.encode(df).collect()
        want = Counter(tuple(sp.encode(t)) for _, t in texts(df))
        assert Counter(tuple(r.ids) for r in got) == want
        assert all(r.round_trip for r in got)
    assert sorted(r.text for r in pieces.decode(pieces.encode(odd)).collect()) == sorted(t for _, t in texts(odd))


def test_mix_nears_targets_and_repeats(docs):
    a = mixing.op4_mixing(docs.sparkSession, SF).collect()
    assert sorted(a) == sorted(mixing.op4_mixing(docs.sparkSession, SF).collect())
    assert all(r.taken <= 3 * r["size"] for r in a)
    total = sum(r["size"] for r in a)
    assert sum({r.source_size: r.target for r in a}.values()) == pytest.approx(total)
    assert sum(r.taken for r in a) == pytest.approx(total, rel=0.35)


def test_mix_takes_odd_rows(odd):
    got = mixing.copies(odd).collect()
    assert len(got) == len(ODD) and {r.target for r in got} == {float(sum(len(words(t or "")) for _, t in ODD))}
    assert mixing.mix(odd).count() == len(ODD)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mix_keeps_columns_of_any_name_and_draws_null_ids_by_text(spark):
    rows = [(None, f"{k} " * 10, "a" if k % 10 else "b", k, "x", "y", "z") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _size int, _source string, row string, size string")
    got = mixing.mix(df)
    assert got.columns == df.columns and {(r._source, r.row, r.size) for r in got.distinct().collect()} == {("x", "y", "z")}
    taken = Counter(r.source for r in got.collect())
    target = {r.row.source: r.target / 10 for r in mixing.copies(df).collect()}
    assert taken["a"] == pytest.approx(target["a"], rel=0.1) and taken["b"] == pytest.approx(target["b"], rel=0.1)


def test_mix_brings_each_source_near_its_target(spark):
    got = mixing.op4_mixing(spark, "/root/testdata/sf0.01")
    per = got.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most"))
    for r in per.collect():
        assert abs(r.taken - r.target) <= 0.1 * r.target + 6 * r.most ** 0.5 * r.target ** 0.5 / 2


def test_chat_reads_back(spark):
    got = {r.conv_id: r for r in chat.op5_chat(spark, SF).collect()}
    want = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want[r.conv_id].append((r.role, r.text or ""))
    want[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(want)
    for k, v in want.items():
        loss = "".join(t for r, t in v if r == "assistant")
        turns = "".join(f"{r}\n{t}\n" for r, t in v)
        assert (got[k].n_turns, got[k].turns_sha256) == (len(v), hashlib.sha256(turns.encode()).hexdigest())
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_folds_edits_regenerations_and_deletions(spark):
    rows = [
        (1, 0, "m1", "delta", "user", "Hel"), (1, 1, "m1", "delta", "user", "lo"), (1, 2, "m2", "delta", "assistant", "bad"), (1, 3, "m2", "regenerate", None, None),
        (1, 4, "m2", "delta", "assistant", "go"), (1, 5, "m2", "delta", "assistant", "od <|&amp;|>"), (1, 6, "m1", "edit", "user", "Hi"), (1, 7, "m3", "delta", "user", "x"),
        (1, 8, "m3", "delete", None, None), (None, None, "a", "delta", None, None),
    ]
    log = spark.createDataFrame(rows, "conv_id long, seq long, message string, event string, role string, text string")
    got = chat.parse(chat.render(chat.fold(log))).orderBy("conv_id", "message").collect()
    assert [(r.role, r.text, r.loss_text) for r in got] == [("", "", ""), ("user", "Hi", ""), ("assistant", "good <|&amp;|>", "good <|&amp;|>")]
    assert chat.digests(chat.render(chat.fold(log.limit(0)))).count() == 0
    with pytest.raises(Exception, match="unknown event"):
        chat.fold(log.withColumn("event", F.lit("what"))).collect()


def test_chat_finds_turns_at_the_marks_and_not_at_the_rows(spark):
    turns = [(1, 0, "user", "a </s>\n<|x|>\n & b"), (1, 1, "assistant", ""), (1, 2, "assistant", "é" * 500 + "<|assistant|>\nno</s>\n"), (2, 0, None, None)]
    rendered = chat.render(chat.fold(chat.log_of(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))))
    whole = {r.conv_id: r for r in chat.digests(rendered).collect()}
    assert whole[1].n_turns == 3 and whole[1].loss_sha256 == hashlib.sha256(turns[2][3].encode()).hexdigest() and whole[2].n_turns == 1
    pieces = []
    for r in rendered.collect():
        for k in range(0, len(r.formatted), 7):
            lo, hi = max(r.loss_from, k) - k, min(r.loss_to, k + 7) - k
            pieces.append((r.conv_id, (r.message.turn or 0) * 10000 + k, r.formatted[k : k + 7], lo if hi > lo else 0, hi if hi > lo else 0))
    cut = chat.digests(spark.createDataFrame(pieces, "conv_id long, message long, formatted string, loss_from int, loss_to int"))
    assert {r.conv_id: r for r in cut.collect()} == whole
    broken = rendered.withColumn("formatted", F.replace("formatted", F.lit("</s>"), F.lit("")))
    with pytest.raises(Exception, match="within a turn"):
        chat.digests(broken).collect()


def test_licenses_found_and_inherited(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "hello"), (3, "a/b/c/y.py", "x\nLicensed under the Apache License, Version 2.0 blah"),
        (4, "COPYING", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007"), (5, "z", "q " * 50000), (6, None, None), (7, "q/r/s", ""), (7, "q/r/s", ""),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()
    assert Counter((r.id, r.final_license) for r in got) == Counter([(1, "MIT"), (2, "MIT"), (3, "Apache-2.0"), (4, "GPL-3.0"), (5, "GPL-3.0"), (6, None), (7, "GPL-3.0"), (7, "GPL-3.0")])


def test_license_cosines_equal_brute_force(docs):
    pages = docs.withColumn("path", F.lit("d/x"))
    own = texts(docs)
    df = Counter(x for _, t in own for x in set(licenses.terms(t)))
    idf = {t: math.log((len(own) + 1) / (df[t] + 1)) + 1 for t in licenses.VOCABULARY}
    want = {}
    for i, t in own:
        lines = re.split(r"\n|(?<=[.!?;])\s", t)
        best = 0.0
        for p in lines + [f"{a} {b}" for a, b in zip(lines, lines[1:])]:
            v = {x: n * idf[x] for x, n in Counter(licenses.terms(p)).items() if x in idf}
            size = math.sqrt(sum(w * w for w in v.values())) or 1
            best = max([best] + [sum(v.get(x, 0) * w for x, w in u.items()) / size for _, u in licenses.vectors(idf)])
        want[i] = best if best >= licenses.THRESHOLD - 1e-9 else None
    got = {r.doc_id: r.similarity for r in licenses.scan(pages, "doc_id").collect()}
    assert {i: x for i, x in got.items() if x} == pytest.approx({i: x for i, x in want.items() if x})


def test_classifier_ranks_rows_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    got = classifier.op7_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").dropDuplicates(["doc_id"]), "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.9


def test_classifier_margins_equal_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    m = classifier.Model(0.3, rng.standard_normal(classifier.WIDTH), rng.standard_normal((classifier.WIDTH, 4)))
    rows = [(rng.choice(classifier.WIDTH, k, replace=False), rng.standard_normal(k)) for k in (1, 2, 30)]
    starts = np.cumsum([0, *[len(i) for i, _ in rows]])
    got, _ = m.margin(starts, np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]))
    for z, (i, x) in zip(got, rows, strict=True):
        pairs = sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for b in range(len(i)) for a in range(b))
        assert z == pytest.approx(m.bias + m.w[i] @ x + pairs)


def test_classifier_learns_nothing_from_held_out_labels(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    turned = labels.withColumn("quality", F.when(classifier.remainder(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: r.score for r in classifier.classify(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_classifier_takes_odd_rows(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = classifier.classify(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert classifier.classify(odd.limit(0), labels).count() == 0


def test_token_files_equal_the_library(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tk, start = Tokenizer.from_file(path), 0
    more = odd.union(spark.createDataFrame([(20, "b <|endoftext|> x<|endoftext|>", "", "")], odd.schema))
    got = token_files.read(token_files.write(more, path, length=4)).orderBy("start").collect()
    for r, (i, t) in zip(got, texts(more), strict=True):
        ids = np.array([*tk.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids))
        start += len(ids)
    files = token_files.write(more, path, length=4).collect()
    for f in files:
        part = token_files.PartReader(f.ids_file)
        seqs = [part.sequence(k) for k in range(-(-f.n_ids // 4))]
        assert sum(int(m.sum()) for _, m in seqs) == f.n_ids and all(len(s) == 4 for s, _ in seqs)
    assert token_files.read(token_files.write(odd.limit(0), path)).count() == 0


def base_counts(t):
    w = words(t)
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


@pytest.mark.parametrize("bits", [64, 4])
def test_quality_counts_equal_brute_force(docs, odd, bits):
    for df in (docs, odd):
        got = Counter((r.row.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.counts(df.select("doc_id", "text"), hash_bits=bits).collect())
        assert got == Counter((r.doc_id, *base_counts(r.text or "")) for r in df.collect())


def votes_of(t):
    """The production rules' votes on a text, from their definitions."""
    n, chars, symbols, _, repeats = base_counts(t)
    w = words(t)
    plain = len(regex.findall(r"(?<![^\x20\x09-\x0D])\p{L}[\p{L}\p{M}'’-]*+[.,;:!?]?+(?![^\x20\x09-\x0D])", t))
    capitals, shouts, distinct = len(regex.findall(r"\p{Lu}", t)), t.count("!"), len(set(w))
    stutters = sum(a == b for a, b in zip(w, w[1:]))
    vote = lambda bad, good: 0 if bad else 1 if good else 2
    return (
        vote(symbols > 0.1 * n, symbols <= 0.01 * n), vote(plain < 0.7 * n, plain >= 0.95 * n), vote(capitals > 0.4 * chars, capitals <= 0.15 * chars),
        vote(shouts > 0.15 * n, shouts <= 0.02 * n), vote(stutters > 0.1 * n, stutters <= 0.03 * n), vote(n >= 20 and distinct < 2 * n**0.5, n >= 20 and distinct >= 3.5 * n**0.5),
        vote(repeats > 0.3 * n, repeats <= 0.1 * n), vote(n > 0 and not 2 * n <= chars <= 15 * n, 3 * n <= chars <= 10 * n),
    )


def slow_em(votes, prior=0.85, hold=0.02):
    """The probability of good of each row of votes; every document counts by itself."""
    v = np.array(votes)
    n, rules = v.shape
    start = np.array([[[0.03, 0.80, 0.17]] * rules] + [[[0.80, 0.05, 0.15] if r == k else [0.15, 0.60, 0.25] for r in range(rules)] for k in range(rules)])
    first = np.array([prior] + [(1 - prior) / rules] * rules)
    share, habit, weight = first, start, 5 + hold * n
    one = np.eye(3)[v]
    for _ in range(200):
        p = share * np.prod(np.einsum("nrv,krv->nkr", one, habit), axis=2)
        p /= p.sum(1, keepdims=True)
        mass = weight * first + p.sum(0)
        new = (weight * first[:, None, None] * start + np.einsum("nk,nrv->krv", p, one)) / mass[:, None, None]
        moved, share, habit = np.abs(new - habit).max(), mass / mass.sum(), new
        if moved < 1e-7:
            break
    p = share * np.prod(np.einsum("nrv,krv->nkr", one, habit), axis=2)
    return p[:, 0] / p.sum(1)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_quality_verdicts_equal_brute_force(request, table):
    df = request.getfixturevalue(table)
    own = texts(df)
    good = slow_em([votes_of(t) for _, t in own])
    base = [base_counts(t) for _, t in own]
    want = [(i, bool(b[0] < 20 or 100 * b[4] > 30 * b[0]), g) for (i, _), b, g in zip(own, base, good)]
    got = [(r.doc_id, r.base_failed, r.quality, r.kept) for r in quality_rules.quality_rules(df).collect()]
    key = lambda r: (str(r[0]), r[1], round(r[2], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-6) and a[3] == (not b[1] and b[2] >= 0.5)


def test_a_lone_bad_vote_of_a_rule_that_errs_is_outvoted():
    """Rule 2 alone condemns what rules 0 and 1 call good; they condemn together. Not all must pass."""
    patterns = [((1, 1, 1), 700), ((1, 1, 0), 120), ((0, 0, 1), 60), ((0, 0, 0), 60), ((0, 0, 2), 20)]
    classes = quality_rules.estimate(patterns, 3)
    good = {v: quality_rules.posterior(v, classes)[0] for v, _ in patterns}
    alone = quality_rules.estimate([((1, 1, 1), 900), ((1, 1, 0), 3), ((0, 0, 1), 60)], 3)
    assert good[(1, 1, 1)] > 0.9 and max(good[v] for v in ((0, 0, 1), (0, 0, 0), (0, 0, 2))) < 0.5
    assert quality_rules.posterior((1, 1, 0), alone)[0] > 0.5


def test_quality_rules_take_empty_tables_and_clashing_columns(spark, docs):
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0 and quality_rules.keep_good(docs.limit(0)).count() == 0
    more = docs.withColumns({"row": F.lit(1), "w": F.lit("x"), "kept": F.lit("y"), "quality": F.lit(None)})
    got = quality_rules.keep_good(more)
    assert got.columns == more.columns and got.count() == quality_rules.keep_good(docs).count() > 0


def test_quality_rules_keep_what_labels_call_good(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules.op9_quality_rules(spark, sf)
    assert got.filter("base_failed AND kept").count() == 0
    kept = {r.doc_id for r in quality_rules.keep_good(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id").collect()}
    assert kept == {r.doc_id for r in got.filter("kept").collect()}
    seen = got.drop("quality").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    assert np.mean([r.kept for r in seen if r.quality == 1]) > 0.95


def test_lm_base_equals_brute_force_and_probabilities_sum(spark, docs):
    got = {r.doc_id: r for r in lm.op10_lm(spark, SF).collect()}
    own = texts(docs)
    c = Counter(x for i, t in own if zlib.crc32(str(i).encode()) % 7 != 2 for x in lm.tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in own:
        want = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in lm.tokens(t))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(lm.tokens(t)), sum(c[x] > 0 for x in lm.tokens(t)), n)
        assert got[i].base_score == pytest.approx(want) and got[i].score < 0


def test_lm_spellings_are_a_distribution():
    """Shared nodes give each word what it gets alone, and a bit's two values have the probabilities p and 1 - p."""
    rng = np.random.default_rng(1)
    counts = lm.Sights(rng.integers(0, 9, (int(lm.FIRST[-1]), 2)).astype(np.float32))
    w = np.full((lm.INPUTS, lm.GATES), 0.3, np.float32)

    def spell(ws):
        out = np.zeros(len(ws))
        for at, end in lm._runs(ws):
            for place, rows, node, now, ctx in lm._nodes(ws[at:end]):
                own = sum(np.log2(np.where(bit == 1, p, 1 - p)) for slots, bit in lm._bits(now, ctx) for p in [lm._mixed(counts, w, place, slots, bit)[2]])
                out[at + rows] += own[node]
        return out

    ws = sorted({b"", b"a", b"ab", b"abc", b"b", b"x" * 300} | {bytes([k]) for k in range(256) if bytes([k]).strip()})
    assert spell(ws) == pytest.approx([spell([x])[0] for x in ws], rel=1e-5)
    first = [bytes([k]) for k in range(256) if k != 32]
    heads = np.zeros(256)
    for place, rows, node, now, ctx in lm._nodes(sorted(first)):
        if place == 0:
            for slots, bit in lm._bits(now, ctx):
                p = lm._mixed(counts, w, 0, slots, bit)[2]
                heads[now.astype(int)] += np.log2(np.where(bit == 1, p, 1 - p))
    closing = spell([b""])[0]
    assert sum(2.0 ** heads[k] for k in range(256) if k != 32) + 2.0**closing == pytest.approx(1, abs=1e-4)


def slow_lm(sequence, taught, n, spelt, total):
    """log2 of one text's probability, token by token; ``taught`` are the counts of the other documents' tokens."""
    hist = [Counter(), Counter(), Counter()]
    names = [lambda i: (sequence[i],), lambda i: ((sequence[i - 1] if i else b""), sequence[i]), lambda i: ((sequence[i - 2] if i > 1 else b"" if i else None), (sequence[i - 1] if i else b""), sequence[i])]
    known = lambda kind, i: taught[names[kind](i)] + hist[kind][names[kind](i)]
    bits_of_hash = max(32, total.bit_length() + lm.SPARE_BITS)
    states, weights, out, queue, last = defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: list(lm.START)), 0.0, [], 0
    stretch = lambda p: math.log(p / (1 - p))
    clip = lambda v, a, b: min(max(v, a), b)
    for i, token in enumerate(sequence):
        one, two, three, cached = known(0, i), known(1, i), known(2, i), hist[0][(token,)]
        seen = [queue_two if i else 0, queue_one if i else taught[(b"",)], i, max(n, 0)]
        share = [x / max(y, 1) for x, y in zip((three, two, cached, taught[(token,)]), seen)]
        spots = [None, last, lm.hash_of(sequence[i - 1] if i else b"", bits_of_hash) % lm.HASHED]
        bits, log2 = [], spelt[token]
        for s in range(3, -1, -1):
            top, half = lm.SOURCES[s]
            start = clip(top * seen[s] / (seen[s] + half), 1e-4, 0.999) if half else top
            level = min(lm.PLACES - 1, int(math.log2(seen[s] + 1)))
            where = [(s, k, level if k == 0 else spots[k]) for k in range(3)]
            x = [stretch(start)] + [stretch(clip((states[a][0] + lm.HOLD * start) / (states[a][1] + lm.HOLD), 1e-4, 1 - 1e-4)) for a in where] + [0.3]
            gate = (s, min(lm.GATE - 1, level // 2))
            z = clip(sum(a * b for a, b in zip(x, weights[gate])), -8, 8)
            mixed = 1 / (1 + math.exp(-z))
            cell = (s, "map", int(clip(math.floor(z * 1.5) + lm.MAPPED // 2, 0, lm.MAPPED - 1)))
            fine = (states[cell][0] + lm.HOLD_MAP * mixed) / (states[cell][1] + lm.HOLD_MAP)
            m = clip((mixed + fine) / 2, 1e-6, 1 - 1e-6) if seen[s] > 0 else 0.0
            inside, rest = m * share[s], math.log2(1 - m) + log2
            log2 = float(np.logaddexp2(math.log2(inside), rest)) if inside > 0 else rest
            bits.append((where + [cell], gate, x, mixed, 2 ** (math.log2(inside) - log2) if inside > 0 else 0.0, seen[s] > 0))
        out += log2
        queue.append(bits[::-1])
        if (i + 1) % lm.STEP == 0:
            for token_bits in queue:
                reach = 1.0
                for where, gate, x, mixed, y, on in token_bits:
                    if on:
                        for a in where:
                            states[a] = [states[a][0] + y * reach, states[a][1] + reach]
                        weights[gate] = [w + lm.RATE * reach * (y - mixed) * v for w, v in zip(weights[gate], x)]
                    reach *= 1 - y
            queue = []
        last = (three > 0) * 8 + (two > 0) * 4 + (cached > 0) * 2 + (taught[(token,)] > 0)
        queue_one, queue_two = one, two
        for kind in range(3):
            hist[kind][names[kind](i)] += 1
    return out


def rows_of(sequence):
    yield from ((t,) for t in sequence)
    yield from zip([b"", *sequence], sequence)
    yield from zip([None, b"", *sequence], [b"", *sequence], sequence)


def test_lm_scores_equal_a_slow_scorer_whatever_the_partitions(spark, docs):
    own = texts(docs)
    learn = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in own}
    seq = {i: lm.tokens(t) for i, t in own}
    every = Counter(x for i, q in seq.items() if learn[i] for x in rows_of(q))
    n = sum(len(q) for i, q in seq.items() if learn[i])
    counts = lm.token_counts(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2).cache()
    shared = spark.sparkContext.broadcast(lm.Sights(lm.predictor_counts(counts)))
    spelt = {bytes(r.token): float(np.float32(r.spelt)) for r in lm.spelt_log2(counts, shared, lm.mixing_weights(counts, shared)).collect()}
    got = {r.doc_id: r.score for r in lm.op10_lm(spark, SF).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    again = {r.doc_id: r.score for r in lm.op10_lm(spark, SF).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == pytest.approx(again, rel=1e-9)
    held = [i for i, _ in own if not learn[i]]
    for i in [i for i, _ in own if learn[i]][::12] + held[::4]:
        taught = every - Counter(rows_of(seq[i])) if learn[i] else every
        want = slow_lm(seq[i], taught, n - len(seq[i]) * learn[i], spelt, n)
        assert got[i] == pytest.approx(want * math.log10(2), rel=1e-4)


def test_lm_tells_texts_that_occur_twice_and_beats_the_base(spark):
    sf = "/root/testdata/sf0.01"
    text = dict(texts(spark.read.parquet(f"{sf}/documents.parquet")))
    times = Counter(text.values())
    got = [r for r in lm.op10_lm(spark, sf).collect() if r.n_tokens > 20]
    once = sorted(r.bits_per_byte for r in got if times[text[r.doc_id]] == 1)
    twice = [r.bits_per_byte for r in got if times[text[r.doc_id]] == 2]
    tenth = once[len(once) // 10]
    assert sum(x <= tenth for x in twice) > 0.7 * len(twice)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_counts_come_back_as_they_were_asked():
    bits = 48
    h = np.unique(np.random.default_rng(3).integers(0, 1 << bits, 5000).astype(np.uint64))
    n = np.arange(len(h)) * 70000
    for cells in (1, 3, 700):
        parts = [(c, *lm.unpacked(lm.packed(h[k], n[k]))) for c, k in lm.cut(h, cells, bits)]
        assert [c for c, *_ in parts] == sorted({int(x) * cells >> bits for x in h})
        assert np.array_equal(np.concatenate([x for _, x, _ in parts]), h) and np.array_equal(np.concatenate([x for *_, x in parts]), n)


def test_lm_takes_odd_rows(odd):
    assert lm.score(odd, F.col("doc_id") == 9).count() == len(ODD)
    assert lm.score(odd, F.lit(False)).filter("score < 0").count() == len(ODD)
    assert lm.score(odd.limit(0), F.lit(True)).count() == 0


def test_pipeline_keeps_ids_and_drops_copies(spark, docs):
    got = corpus_pipeline.run(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "simhash_near_dedup", "mixing", "sentencepiece"]
    rows = got.collect()
    assert rows and all(r.round_trip for r in rows)
    text = dict(texts(docs))
    kept = {r.doc_id for r in rows}
    assert kept <= set(text) and len({text[i] for i in kept}) == len(kept)
    verdict = {r.doc_id: r.kept for r in quality_rules.op9_quality_rules(spark, SF).collect()}
    assert all(verdict[i] for i in kept)
    assert all(n <= mixing.CEILING for n in Counter(r.doc_id for r in rows).values())


def test_keep_one_tells_rows_apart_by_id_and_text(spark):
    one, two = "alpha beta gamma delta epsilon zeta", "some other words stand here and go on"
    rows = [(1, one), (2, one), (2, two), (None, "no id at all here"), (None, "no id at all here"), (4, two), (4, two), (5, "five five"), (5, "five five")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, one), (2, two), (None, "no id at all here"), (5, "five five")], key=str)


def test_keep_one_and_links_take_any_column_and_empty_tables(spark, odd):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4)], "doc_id long, text string, _gone int, row int")
    assert [tuple(r) for r in simhash.keep_one(df).collect()] == [(1, "a b c d e f", 1, 2)]
    assert simhash.keep_one(odd.limit(0)).count() == 0 and simhash.near_duplicates(odd.limit(0)).count() == 0
    assert shingles.near_duplicates(odd.limit(0)).count() == 0
    for classes in (simhash.near_duplicates, shingles.near_duplicates):
        got = classes(odd).collect()
        assert len(got) == len(ODD)
        by = defaultdict(set)
        for r in got:
            by[r.component_id].add(r.doc_id)
        assert {5, 3} in [x - {None} for x in by.values()]  # null and empty texts are alike


def test_bitmaps_never_part_similar_sets():
    rng = np.random.default_rng(11)
    for _ in range(400):
        n = int(rng.integers(1, 900))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone = int(rng.integers(0, max(1, n // 6) + 1))
        y = np.unique(np.concatenate((x[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 6 + 1))).astype(np.uint64))))
        met = len(np.intersect1d(x, y))
        if met >= 0.8 * (len(x) + len(y) - met):
            assert shingles.may_be_similar(shingles.parities(x), shingles.parities(y), len(x), len(y), 0.8)
    far = [np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64)) for _ in range(2)]
    assert not shingles.may_be_similar(*map(shingles.parities, far), *map(len, far), 0.8)


def shingle_set(t):
    w = t.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stage_finds_planted_pairs_from_similarity_08(spark):
    rng = np.random.default_rng(5)
    own, near = [], []
    for k in range(120):
        w = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 400))]
        if k % 3 == 0:  # passages that many have
            w[10:40] = [f"boiler{x}" for x in range(30)]
        edit, d = list(w), rng.uniform(0.01, 0.04)
        for at in rng.choice(len(w), max(1, int(d * len(w))), replace=False):
            edit[at] = f"new{at}"
        own += [" ".join(w), " ".join(edit)]
    family = [f"v{x}" for x in range(200)]
    own += [" ".join(["x" + str(k) if at == 3 * k else v for at, v in enumerate(family)]) for k in range(60)] + ["", "  ", "two words", "Two  words"]
    sets, root = [shingle_set(t) for t in own], list(range(len(own)))
    for b in range(len(own)):
        for a in range(b):
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] or sets[b] else 1
            if j >= 0.8:
                near.append(j)
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    assert sum(0.8 <= j < 0.95 for j in near) > 50
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(df).collect()}
    assert got == dict(enumerate(root))
    assert {r.doc_id for r in corpus_pipeline.deduplicated(spark, df, SF).collect()} == set(root)


@pytest.mark.parametrize("other", ["Licensed under the Elastic License", "Licensed under the Frobnicate Public License, version 3", "Released under the Acme Zebra Quux license"])
def test_notices_of_unknown_licenses_are_no_template(spark, other):
    rows = [(k, f"s/{k}", "plain prose about nothing at all under the sun") for k in range(200)]
    rows += [(200, "s/200", other), (201, "s/201", "Licensed under the MIT license")]
    got = {r.id: r.license for r in licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert got[200] is None and got[201] == "MIT"
