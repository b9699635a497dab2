"""LM scoring by online logistic context mixing of bit predictors.

Texts are sequences of tokens: words with A-Z lower-cased, then one end. A token is coded in bits, and every bit is
predicted before it is seen:

* its *source* is a run of hidden bits, each a yes or a no: is it drawn from what followed the two tokens before it,
  from what followed the one before it, from the document so far, from the corpus at large? After four noes it is
  spelt. A source gives each token its share of the source's counts, so the token's probability is the sum over the
  sources. Each bit has several predictors in contexts of their own: how much the source knows here, how well the token
  before was known, the hash of the token before. They are combined in the logistic domain by weights that a gate
  selects, and the mix is refined by an adaptive map of its own value. Predictors, weights and map are corrected towards
  what the tokens say of their sources, online within each document, ``STEP`` tokens at a time, from a start that is the
  same for every document.
* its *spelling* is its bytes and a closing space, eight bits each (an end is the space alone). Four predictors, of
  the last one, two, three bytes and of all bytes of the word so far, look up the bit counts of their hashed context.
  A gate of their evidence and the place in the word selects the weights of the mix. These weights are learned online,
  each word predicted from the counts without one sight of it, in lessons: sets of words fixed by their hashes.

What the corpus teaches are exact counts of one, two and three tokens in a row, over all documents to learn from. A
document that is itself learned from is scored by what the others teach: its own counts are taken off, and come back
one by one as its text goes on. So scores of known and held-out documents compare, and a copy of a document shows.

So every text has a probability, and its logarithm over its bytes is its bits per byte. The result doesn't depend on
partitions, as counts are sums of whole numbers, lessons are fixed by the words and a document needs no other's state.

Spark does the corpus work. Documents are dealt to blocks; a block asks for the counts of its different rows of
tokens by hashes, in sorted lists cut into cells of the hash range; a cell adds up what all blocks bring and
answers each of them, in the order that it was asked. No two different tokens share a hash: theirs have so many bits that it
is unlikely, all tokens of the corpus are checked for it, and another seed is taken until it holds. So counts of tokens, and
the base score, are exact. Hashes of two and three tokens have as many bits as make one row of tokens in a thousand
share its hash with another, whatever the corpus's size (``SPARE_BITS`` more than count its tokens). A row's count is
bounded by those of the shorter rows inside it, so a shared hash never gives a share above 1, and to a row of known tokens
at most what these are counted together; below that bound one row in a thousand may still count what is another's. Cells and blocks
are of bounded size and their numbers follow the input; a frequent word is one number for each block. Only the spelling's tables, of a fixed size (``SLOTS``), and its
weights reach the driver, and are broadcast.

Of the token, the bits that are mixed online are the choices of its source; only words that no source knows are spelt by the
bits of their bytes, whose tables and weights are learned from the corpus and stay as they are within a text.

Cases: a null or empty text is the end alone. Repeated rows score alike, in whatever blocks they are. A null id isn't held
out. Without documents to learn from, counts and predictors are empty and every bit of a spelling costs about one bit.
Texts of any length are scored whole and adapt from end to end. An empty table gives an empty result. Further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, partitions, written

#: Slots of the spelling's four tables: a power of two each. What grows with the corpus are the counts of tokens.
SLOTS = (1 << 16, 1 << 18, 1 << 19, 1 << 21)
FIRST = np.concatenate(([0], np.cumsum(SLOTS))).astype(np.int64)
#: Slots a row of the tables' sums, bytes of a block's texts, hashes of a cell, words learned at a
#: time, lessons, tokens of a step, documents that take it together.
CHUNK, BLOCK_BYTES, CELL, LESSON, LESSONS, STEP, LOCKSTEP = 1 << 14, 5 << 20, 2_000_000, 20_000, 512, 16, 512
#: Bytes of a table's rows that are cut into tokens at a time, and tokens that are counted at a time.
PIECE, HELD = 2 << 20, 2_000_000
GATES, INPUTS, PRIOR = 4 * 3 * 3, len(SLOTS) + 1, 0.4
SPARE_BITS = 10
#: What a source is thought to be worth at first: at most, and the evidence at which it is worth half of that.
SOURCES = ((0.9, 4.0), (0.6, 40.0), (0.3, 60.0), (0.97, 0.0))
PLACES, BEFORE, HASHED, GATE, MAPPED = 8, 16, 32, 3, 12
START, RATE, HOLD, HOLD_MAP = (0.1, 0.4, 0.25, 0.25, 0.0), 0.004, 8.0, 20.0


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of tokens of each text, the tokens of all texts in order, but for their ends): ``tokens`` in Arrow."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    some = pc.greater(pc.binary_length(words), 0)  # white space at a text's ends gives empty words
    of = pc.list_parent_indices(lists).to_numpy()[some.to_numpy(zero_copy_only=False)]
    return np.bincount(of, minlength=len(texts)).astype(np.int64) + 1, words.filter(some)


def as_bytes(words: pa.Array) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def _runs(words: list[bytes]) -> Iterator[tuple[int, int]]:
    """Cuts a sorted list so that a run's words, padded to the longest, take some megabytes at most."""
    at, widest = 0, 0
    for i, w in enumerate(words):
        width = max(widest, len(w) + 1)
        if i > at and (i - at + 1) * width > 1 << 21:
            yield at, i
            at, width = i, len(w) + 1
        widest = width
    if words:
        yield at, len(words)


def _nodes(words: list[bytes]) -> Iterator[tuple]:
    """(place, rows, node of each row, byte and contexts of each node), place by place, for sorted, different words.

    A word's bytes and the closing space are a path in a tree. Words next to one another share the nodes of what they
    have in common, so these are worked out once: ``rows`` are the words that reach the place, each at one node.
    """
    text = np.array([w + b" " for w in words], f"S{max(map(len, words)) + 1}")
    text = text.view(np.uint8).reshape(len(words), -1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    common = np.append(-1, np.argmin(text[1:] == text[:-1], axis=1))
    prefix = np.zeros(len(words), np.uint64)
    for place in range(text.shape[1]):
        rows = np.flatnonzero(size > place)
        new = common[rows] <= place
        new[:1] = True
        first = rows[new]
        back = [text[first, place - d].astype(np.uint64) if place >= d else np.full(len(first), 32, np.uint64) for d in (1, 2, 3)]
        now = text[first, place].astype(np.uint64)
        shift = np.uint64(8)
        two = back[0] << shift | back[1]
        yield place, rows, np.cumsum(new) - 1, now, (back[0], two, two << shift | back[2], prefix[first])
        prefix[rows] = (prefix[rows] ^ (text[rows, place] + np.uint64(1))) * np.uint64(0x100000001B3) + np.uint64(0x9E37)


def _bits(now: np.ndarray, contexts: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slot of each predictor, bit) for each bit of the nodes' bytes, highest first."""
    for k in range(7, -1, -1):
        node = (now | np.uint64(256)) >> np.uint64(k + 1)
        slots = [(contexts[0] << np.uint64(8) | node).astype(np.int64)]
        for c, s, first in zip(contexts[1:], SLOTS[1:], FIRST[1:]):
            h = (c * np.uint64(256) + node) * np.uint64(0x9E3779B97F4A7C15)
            slots.append((h >> np.uint64(65 - s.bit_length())).astype(np.int64) + first)
        yield np.stack(slots), ((now >> np.uint64(k)) & np.uint64(1)).astype(np.int64)


class Sights:
    """What the counts of the tables' slots say, worked out once: for each slot, and for each slot without one sight of
    a zero or of a one, the logarithm of ones against zeros, and how much evidence there is."""

    def __init__(self, counts: np.ndarray):
        prior = np.float32(PRIOR)
        less = [np.maximum(counts - np.eye(2, dtype=np.float32)[bit], 0) for bit in (0, 1)]
        ratio = lambda n: np.log(n[:, 1] + prior) - np.log(n[:, 0] + prior)
        self.ratio, self.ratio_less = ratio(counts), np.stack([ratio(n) for n in less], axis=1)
        self.seen, self.seen_less = self.level(counts), np.stack([self.level(n) for n in less], axis=1)

    @staticmethod
    def level(counts: np.ndarray) -> np.ndarray:
        """The evidence of the slots of the last two tables, as the share of the gate that it stands for."""
        n, out = counts.sum(1), np.zeros(len(counts), np.int8)
        two, three = slice(FIRST[2], FIRST[3]), slice(FIRST[3], FIRST[4])
        out[two] = 3 * ((n[two] >= 1).astype(np.int8) + (n[two] >= 32))
        out[three] = 9 * ((n[three] >= 1).astype(np.int8) + (n[three] >= 4) + (n[three] >= 32))
        return out


def _mixed(sights: Sights, w: np.ndarray, place: int, slots: np.ndarray, bit: np.ndarray, less: bool = False):
    """(inputs, gate, probability of a one); with ``less`` one sight of the bit itself is left out of the counts."""
    x = np.empty((INPUTS, slots.shape[1]), np.float32)
    if less:
        x[:-1] = sights.ratio_less[slots, bit]
        gate = sights.seen_less[slots[2], bit] + sights.seen_less[slots[3], bit]
    else:
        np.take(sights.ratio, slots, out=x[:-1])
        gate = sights.seen[slots[2]] + sights.seen[slots[3]]
    x[-1] = 0.3
    gate = gate.astype(np.intp) + min(place, 2)
    z = (x * w[:, gate]).sum(0)
    return x, gate, 1 / (1 + np.exp(-np.clip(z, -16, 16)))


def token_counts(docs: DataFrame, learn: Column, text_col: str = "text") -> DataFrame:
    """(token binary, c): every token of ``docs`` and how often the documents to learn from have it, in order."""
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])  # words of texts that don't teach, of texts that do
        ends, size = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            taught = pa.chunked_array(held[1], pa.binary()).value_counts()
            others = pa.chunked_array(held[0], pa.binary()).unique()
            for keys, n in ((taught.field(0), taught.field(1)), (others, pa.array(np.zeros(len(others), np.int64))), (pa.array([b""], pa.binary()), pa.array([ends]))):
                yield pa.record_batch([keys, n.cast(pa.int64())], ["token", "n"])

        for b in batches:
            step = max(1, b.num_rows * PIECE // max(1, b.nbytes))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                learn = part.column(1)
                for teaches in (0, 1):
                    texts = part.column(0).filter(learn if teaches else pc.invert(learn))
                    words = split(texts)[1].cast(pa.binary())
                    held[teaches].append(words)
                    ends, size = ends + teaches * len(texts), size + len(words)
                if size > HELD:
                    yield from flush()
                    held, ends, size = ([], []), 0, 0
                    pa.default_memory_pool().release_unused()
        if size or ends or any(held):
            yield from flush()

    sums = rows.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))
    return sums.repartitionByRange(partitions(docs.sparkSession), "token").sortWithinPartitions("token")


def sorted_words(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    """A batch's tokens in order and their counts. Read from files its order may be another one than it was written in."""
    words, c = as_bytes(batch.column(0)), batch.column(1).to_numpy()
    order = sorted(range(len(words)), key=words.__getitem__)
    return [words[i] for i in order], c[order]


def predictor_counts(counts: DataFrame) -> np.ndarray:
    """Each slot's counts of zeros and ones, from (token, c)."""
    total = int(FIRST[-1])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((total, 2), np.int64)
        for b in batches:
            words, every = sorted_words(b)
            for at, end in _runs(words):
                c = every[at:end]
                for _, rows, node, now, contexts in _nodes(words[at:end]):
                    own = np.bincount(node, c[rows]).astype(np.int64)
                    for slots, bit in _bits(now, contexts):
                        for s in slots:
                            np.add.at(table.reshape(-1), 2 * s + bit, own)
        for k in range(0, total, CHUNK):
            part = table[k : k + CHUNK]
            if part.any():
                yield pa.record_batch([pa.array([k]), pa.array([part.tobytes()], pa.binary())], ["chunk", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1)):
                part = np.frombuffer(data.as_buffer(), np.int64)
                sums[k] = sums[k] + part if k in sums else part
        for k, x in sums.items():
            yield pa.record_batch([pa.array([k]), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["chunk", "data"])

    known = counts.filter("c > 0").select("token", "c")
    parts = known.mapInArrow(add, "chunk long, data binary").repartition(partitions(counts.sparkSession), "chunk")
    out = np.zeros((total, 2), np.float32)
    for row in parts.mapInArrow(merge, "chunk long, data binary").toLocalIterator():  # SLOTS bounds them
        x = np.frombuffer(bytes(row["data"]), np.float32).reshape(-1, 2)
        out[row["chunk"] : row["chunk"] + len(x)] = x
    return out


def mixing_weights(counts: DataFrame, shared) -> np.ndarray:
    """Weights by input and gate. Words are dealt to ``LESSONS`` lessons by the hashes of their beginnings; each lesson
    is learned online in the words' order, ``LESSON`` words at a time. Lessons are averaged by their tokens, in whole
    numbers, so that neither tasks nor their order make a difference."""
    start = np.full((INPUTS, GATES), 0.3, np.float32)
    start[-1] = 0
    known = counts.filter("c > 0").select("token", "c")

    def learned(words: list[bytes], counts_: list[int], w: np.ndarray, norm: np.ndarray) -> None:
        every = np.array(counts_, np.int64)
        for at, end in _runs(words):
            c = every[at:end]
            for place, rows, node, now, contexts in _nodes(words[at:end]):
                own = np.bincount(node, c[rows])
                for slots, bit in _bits(now, contexts):
                    x, gate, p = _mixed(shared.value, w, place, slots, bit, True)
                    err, weight = (bit - p) * own, np.bincount(gate, own, GATES)
                    for i in range(INPUTS):
                        g = np.bincount(gate, err * x[i], GATES) / np.maximum(weight, 1)
                        norm[i] += g**2
                        w[i] += 0.02 * g / np.sqrt(norm[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lesson, words, every, total, w, norm = None, [], [], 0, None, None

        def ended() -> pa.RecordBatch:
            learned(words, every, w, norm)
            return pa.record_batch([pa.array([total]), pa.array([w.astype(np.float32).tobytes()], pa.binary())], ["n", "w"])

        for b in batches:
            for k, word, c in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist()):
                if k != lesson:
                    if lesson is not None:
                        yield ended()
                    lesson, words, every, total = k, [], [], 0
                    w, norm = start.copy(), np.full((INPUTS, GATES), 1e-2)
                if len(words) == LESSON:
                    learned(words, every, w, norm)
                    words, every = [], []
                words.append(word)
                every.append(c)
                total += c
        if lesson is not None:
            yield ended()

    dealt = known.select(F.pmod(F.xxhash64(F.substring("token", 1, 3)), F.lit(LESSONS)).alias("lesson"), "token", "c")
    dealt = dealt.repartition(partitions(counts.sparkSession), "lesson").sortWithinPartitions("lesson", "token")
    out, total, unit = np.zeros((INPUTS, GATES), object), 0, 1 << 24
    for r in dealt.mapInArrow(run, "n long, w binary").collect():  # LESSONS bounds them
        w = np.frombuffer(bytes(r["w"]), np.float32).reshape(INPUTS, GATES)
        out += np.rint(w.astype(float) * unit).astype(np.int64).astype(object) * r["n"]
        total += r["n"]
    return (out / (total * unit)).astype(np.float32) if total else start


def spellings(words: list[bytes], sights: Sights, weights: np.ndarray) -> np.ndarray:
    """The log2 probability of the spelling of each of some sorted, different words."""
    out = np.zeros(len(words))
    for at, end in _runs(words):
        for place, rows, node, now, contexts in _nodes(words[at:end]):
            own = np.zeros(len(now))
            for slots, bit in _bits(now, contexts):
                p = _mixed(sights, weights, place, slots, bit)[2]
                own += np.log2(np.where(bit == 1, p, 1 - p))
            out[at + rows] += own[node]
    return out


def spelt_log2(counts: DataFrame, shared, weights: np.ndarray) -> DataFrame:
    """(token, c, spelt): the log2 probability of each token's spelling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, c = sorted_words(b)
            out = spellings(words, shared.value, weights)
            yield pa.record_batch([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array(out)], ["token", "c", "spelt"])

    return counts.select("token", "c").mapInArrow(run, "token binary, c long, spelt double")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def grams(texts: pa.Array | list[str | None], bits: int, token_bits: int | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(number of tokens of each text, text of each token, hashes of each token: alone, after one, after two).

    What comes before a text is an end, and before that something that no text has. Tokens alone have ``token_bits``.
    """
    if isinstance(texts, list):
        texts = pa.array([None if t is None else t.encode("utf-8", "surrogatepass") for t in texts], pa.binary()).view(pa.string())
    size, words = split(texts)
    words = words.dictionary_encode()  # each different word is hashed once
    own = as_bytes(words.dictionary)
    own = np.fromiter(map(xxhash.xxh64_intdigest, own, repeat(seed)), np.uint64, len(own))
    last = np.zeros(int(size.sum()), bool)
    last[np.cumsum(size) - 1] = True
    one = np.empty(len(last), np.uint64)
    one[last], one[~last] = xxhash.xxh64_intdigest(b"", seed), own[words.indices.to_numpy()]
    del words
    pa.default_memory_pool().release_unused()
    begin = np.cumsum(size) - size

    def before(x: np.ndarray, first: int) -> np.ndarray:
        out = np.append(np.uint64(first), x[:-1])
        out[begin] = first
        return out

    odd = np.uint64(0x9E3779B97F4A7C15)
    two = _mix((before(one, xxhash.xxh64_intdigest(b"", seed)) + np.uint64(1)) * odd + one)
    three = _mix((before(two, 0) + np.uint64(2)) * odd + one)
    return size, np.repeat(np.arange(len(texts), dtype=np.int32), size), [x >> np.uint64(64 - b) for x, b in ((one, token_bits or bits), (two, bits), (three, bits))]


def hash_of(token: bytes, bits: int, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(token, seed) >> (64 - bits)


def apart(counts: DataFrame, bits: int) -> int:
    """The first seed by which all tokens of ``counts`` have different hashes of ``bits`` bits."""

    def run(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.fromiter((hash_of(t, bits, seed) for t in as_bytes(b.column(0))), np.uint64, b.num_rows)
            yield pa.record_batch([pa.array(h.view(np.int64))], ["h"])

    for seed in count():
        hashes = counts.select("token").mapInArrow(lambda batches, seed=seed: run(batches, seed), "h long")
        if hashes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return seed


def ranked(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(different hashes in order, which of them each place has, how often its document has it, and had it before)."""
    width = max(1, len(h).bit_length())
    over = max(0, int(h.max(initial=0)).bit_length() + width - 64)  # lowest bits of a hash that have no room
    both = np.sort(h >> np.uint64(over) << np.uint64(width) | np.arange(len(h), dtype=np.uint64))  # hash and place in one number, whose sort is the fastest
    order = (both & np.uint64((1 << width) - 1)).astype(np.int32)
    s = h[order] if over else both >> np.uint64(width)
    if over and (s[1:] < s[:-1]).any():  # hashes that differ in those bits alone
        order = np.argsort(h, kind="stable")
        s = h[order]
    d = doc[order]  # one hash's places stay in order, and so do its documents
    new = np.append(True, s[1:] != s[:-1])
    heads = np.flatnonzero(new | np.append(True, d[1:] != d[:-1]))
    size = np.diff(np.append(heads, len(h)))
    which, own, earlier = (np.empty(len(h), np.int32) for _ in range(3))
    which[order] = np.cumsum(new) - 1
    own[order] = np.repeat(size, size)
    earlier[order] = np.arange(len(h)) - np.repeat(heads, size)
    return s[new], which, own, earlier


def squeezed(x: np.ndarray, kinds: tuple[str, ...]) -> bytes:
    """Whole numbers as one run of bytes for each part of them, least part first, each run compressed."""
    out, at = [], 0
    for k in kinds:
        width = np.dtype(k).itemsize
        raw = (x >> np.uint64(at)).astype(k).tobytes()
        small = pa.compress(raw, "zstd", asbytes=True)
        out.append(len(small).to_bytes(4, "little") + small)
        at += 8 * width
    return len(x).to_bytes(4, "little") + b"".join(out)


def restored(data: bytes, kinds: tuple[str, ...]) -> tuple[np.ndarray, int]:
    """(the numbers, bytes read)."""
    n, at, shift, out = int.from_bytes(data[:4], "little"), 4, 0, np.zeros(0, np.uint64)
    for k in kinds:
        width, size = np.dtype(k).itemsize, int.from_bytes(data[at : at + 4], "little")
        part = np.frombuffer(pa.decompress(data[at + 4 : at + 4 + size], n * width, "zstd"), k, n).astype(np.uint64)
        out = out | part << np.uint64(shift) if len(out) else part << np.uint64(shift)
        at, shift = at + 4 + size, shift + 8 * width
    return out, at


STEPS, COUNTS = ("<u2", "<u1", "<u1", "<u4"), ("<u1", "<u1", "<u2", "<u4")


def packed(h: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted hashes as steps and a whole number for each, in few bytes."""
    return squeezed(np.diff(h, prepend=np.uint64(0)), STEPS) + squeezed(n.astype(np.uint64), COUNTS)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, at = restored(data, STEPS)
    return np.cumsum(step, dtype=np.uint64), restored(data[at:], COUNTS)[0].astype(np.int64)


def cut(h: np.ndarray, cells: int, bits: int) -> Iterator[tuple[int, slice]]:
    """(cell, slice) for each cell of the hash range that sorted hashes touch."""
    at = 0
    while at < len(h):
        cell = int(h[at]) * cells >> bits
        end = int(np.searchsorted(h, np.uint64(-(-((cell + 1) << bits) // cells)))) if cell + 1 < cells else len(h)
        yield cell, slice(at, end)
        at = end


ASKED = "cell long, block long, kind int, data binary"


def asked(rows: DataFrame, cells: int, bits: int, token_bits: int | None = None, seed: int = 0) -> DataFrame:
    """(cell, block, kind, data): the different hashes of one, two and three tokens (kind 0, 1, 2) of each block of
    ``rows`` (id, text, learn, block), and how often the texts to learn from have each."""

    def tally(h: np.ndarray, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.sort(h << np.uint64(1) | taught.astype(np.uint64))
        h = key >> np.uint64(1)
        heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        return h[heads], np.add.reduceat((key & np.uint64(1)).astype(np.int64), heads)

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if len(parts) == 1:
            return parts[0]
        h, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        heads = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
        return h[order][heads], np.add.reduceat(n[order], heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for b in batches:
            blocks, learn = b.column(3).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            for block in np.unique(blocks):
                mine = np.flatnonzero(blocks == block)
                _, doc, hashes = grams(b.column(1).take(pa.array(mine)), bits, token_bits, seed)
                taught = learn[mine][doc]
                for kind, h in enumerate(hashes):
                    parts = found.setdefault((int(block), kind), [])
                    parts.append(tally(h, taught))
                    if len(parts) >= 8:
                        parts[:] = [merged(parts)]
        for (block, kind), parts in found.items():
            h, n = merged(parts)
            out = [(cell, packed(h[k], n[k])) for cell, k in cut(h, cells, bits if kind else token_bits or bits)]
            cols = [pa.array([c for c, _ in out], pa.int64()), pa.array([block] * len(out), pa.int64()), pa.array([kind] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())]
            yield pa.record_batch(cols, ["cell", "block", "kind", "data"])

    return rows.mapInArrow(run, ASKED)  # with all columns, so that the score reads the same shuffled rows


def spelt_cells(counts: DataFrame, shared, weights: np.ndarray, cells: int, bits: int, seed: int = 0) -> DataFrame:
    """The spellings' log2 probabilities as further rows of what is asked: block -1, each a number of 32 bits.

    They are worked out here, not read from :func:`spelt_log2`, as a step of its own would hold a second Python worker,
    with the tables, in each task. A task's tokens go out together, so that the rows are as few as its cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, value = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            h, value = h[order], value[order]
            out = [(cell, packed(h[k], value[k])) for cell, k in cut(h, cells, bits)]
            cols = [pa.array([c for c, _ in out], pa.int64()), pa.array([-1] * len(out), pa.int64()), pa.array([0] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())]
            return pa.record_batch(cols, ["cell", "block", "kind", "data"])

        for b in batches:
            words, _ = sorted_words(b)
            h = np.fromiter((hash_of(t, bits, seed) for t in words), np.uint64, len(words))
            held.append((h, spellings(words, shared.value, weights).astype("<f4").view("<u4")))
            size += len(words)
            if size > HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return counts.select("token", "c").mapInArrow(run, ASKED)


ANSWERS = "block long, kind int, cell long, counts binary, spelt binary"


def answered(cell: pa.Table) -> pa.Table:
    """(block, kind, cell, counts, spelt) for each question of a cell: the sums over all blocks, in the order asked."""
    blocks, kinds, data = cell["block"].to_numpy(), cell["kind"].to_numpy(), cell["data"]
    out = []
    for kind in range(3):
        rows = np.flatnonzero((kinds == kind) & (blocks >= 0))
        if not len(rows):
            continue
        parts = [unpacked(data[int(r)].as_py()) for r in rows]
        h, n = (np.concatenate(x) for x in zip(*parts))
        every, which = np.unique(h, return_inverse=True)
        total = np.bincount(which, n, len(every)).astype(np.int64)
        bits = np.zeros(len(every), "<u4")
        if kind == 0:
            for r in np.flatnonzero(blocks < 0):
                of, b = unpacked(data[int(r)].as_py())
                bits[np.searchsorted(every, of)] = b
        at = 0
        for r, (own, _) in zip(rows, parts):
            w = which[at : at + len(own)]
            at += len(own)
            out.append((int(blocks[r]), kind, cell["cell"][0].as_py(), squeezed(total[w].astype(np.uint64), COUNTS), bits[w].tobytes() if kind == 0 else b""))
    kinds_of = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    cols = list(zip(*out)) if out else [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds_of)], [x.split()[0] for x in ANSWERS.split(", ")])


def source_log2(size: np.ndarray, share: np.ndarray, seen: np.ndarray, history: np.ndarray, hashed: np.ndarray, spelt: np.ndarray) -> np.ndarray:
    """The log2 probability of each token. ``share`` and ``seen`` are, for each source, the token's share of it and how
    much it knows here (0: nothing, its bit is skipped); ``history`` and ``hashed`` are contexts below ``BEFORE`` and
    ``HASHED``; ``spelt`` is the spelling's log2 probability. Documents of ``size`` tokens run in lockstep, ``LOCKSTEP`` of
    like size at a time, whose state the processor's cache holds."""
    order = np.argsort(-size, kind="stable")
    starts, size, out = (np.cumsum(size) - size)[order], size[order], np.zeros(len(spelt))
    for at in range(0, len(size), LOCKSTEP):
        _in_lockstep(starts[at : at + LOCKSTEP], size[at : at + LOCKSTEP], share, seen, history, hashed, spelt, out)
    return out


def _in_lockstep(starts: np.ndarray, size: np.ndarray, share: np.ndarray, seen: np.ndarray, history: np.ndarray, hashed: np.ndarray, spelt: np.ndarray, out: np.ndarray) -> None:
    """Sets ``out`` at the tokens of the documents that start at ``starts``, the longest first."""
    n, k, f = len(size), len(SOURCES), np.float32
    slots = (PLACES, BEFORE, HASHED, MAPPED)
    yes, no = [np.zeros(n * k * m, f) for m in slots], [np.zeros(n * k * m, f) for m in slots]
    weights = [np.full(n * k * GATE, x, f) for x in START]
    top, half = (np.array(x, f)[:, None, None] for x in zip(*SOURCES))
    for i in range(0, int(size[0]), STEP):
        live = int(np.searchsorted(-size, -i))  # documents longer than i
        place = i + np.arange(STEP)
        valid = place < size[:live, None]
        at = np.where(valid, starts[:live, None] + place, starts[:live, None])
        # all arrays are source, document, token; a document's state of a source starts at its row times the slots
        row = (np.arange(live)[None, :, None] * k + np.arange(k)[:, None, None]).astype(np.intp)
        known = seen.take(at, axis=1)
        on = (known > 0) & valid
        start = np.clip(top * known / np.maximum(known + half, f(1e-9)), f(1e-4), f(0.999))
        level = np.minimum(PLACES - 1, np.log2(known + 1).astype(np.intp))
        spots = [row * PLACES + level, row * BEFORE + history[at], row * HASHED + hashed[at]]
        x = [np.log(start / (1 - start))]
        for y, z, spot in zip(yes, no, spots):
            x.append(np.log((y.take(spot) + f(HOLD) * start) / (z.take(spot) + f(HOLD) * (1 - start))))
        gate = row * GATE + np.minimum(GATE - 1, level // 2)
        z = weights[-1].take(gate) * f(0.3)
        for w, v in zip(weights, x):
            z += w.take(gate) * v
        z = np.clip(z, f(-8), f(8))
        mixed = 1 / (1 + np.exp(-z))
        spots.append(row * MAPPED + np.clip(np.floor(z * f(1.5)).astype(np.intp) + MAPPED // 2, 0, MAPPED - 1))
        ones = yes[-1].take(spots[-1])
        fine = (ones + f(HOLD_MAP) * mixed) / (ones + no[-1].take(spots[-1]) + f(HOLD_MAP))
        m = np.where(on, np.clip((mixed + fine) / 2, f(1e-6), f(1 - 1e-6)), 0).astype(float)
        passed = 1 - m  # none of the sources up to here
        for j in range(1, k):
            passed[j] *= passed[j - 1]
        parts = m * share.take(at, axis=1)
        parts[1:] *= passed[:-1]
        inside, rest, bits = parts.sum(0), passed[-1], spelt[at].astype(float)
        total = inside + rest * np.exp2(np.maximum(bits, -1000))
        log2 = np.where(inside > 0, np.log2(total), np.log2(rest) + bits)
        out[at[valid]] = log2[valid]
        parts /= total
        parts *= on
        reach = np.empty_like(parts)  # how likely the source's bit was met at all
        met = np.zeros_like(inside)
        for j in range(k):
            np.subtract(1, met, out=reach[j])
            met += parts[j]
        reach *= on
        for y, z, spot, m_ in zip(yes, no, spots, slots):
            end = live * k * m_
            y[:end] += np.bincount(spot.ravel(), parts.ravel(), end)
            z[:end] += np.bincount(spot.ravel(), (reach - parts).ravel(), end)
        pull, end = RATE * (parts - reach * mixed), live * k * GATE
        for w, v in zip(weights, [*x, None]):
            w[:end] += np.bincount(gate.ravel(), (pull * (0.3 if v is None else v)).ravel(), end)


def contexts(size: np.ndarray, doc: np.ndarray, hashes: list[np.ndarray], counts: list[np.ndarray], spelt: np.ndarray, learn: np.ndarray, n: int, bits: int, token_bits: int | None = None, seed: int = 0) -> tuple:
    """(:func:`source_log2`'s arguments, the corpus's counts of each token) from a block's tokens and the answers."""
    begin = np.cumsum(size) - size

    def before(x: np.ndarray, first: np.ndarray | int) -> np.ndarray:
        out = np.append(x[:1], x[:-1])
        out[begin] = first
        return out

    n_tokens, mine = len(doc), learn[doc]
    share, seen = np.empty((4, n_tokens), np.float32), np.empty((4, n_tokens), np.float32)
    seen[2] = np.arange(n_tokens, dtype=np.int32) - begin[doc]
    seen[3] = np.maximum(n - size * learn, 0)[doc]
    known, most, prior = np.zeros(n_tokens, np.int8), None, None  # counts of the row without its first token, or its last
    for kind, (h, c) in enumerate(zip(hashes, counts)):
        _, which, own, earlier = ranked(h, doc)
        others = c[which] - own * mine  # what the other documents teach
        now = others + earlier
        if kind:  # what a shared hash adds beyond the counts of the rows inside this one is not this row's
            now = np.minimum(now, np.minimum(most, prior))
        known += ((now > 0) << (kind + 1) if kind else others > 0).astype(np.int8)
        if kind == 0:
            whole, ends = c[which], spelt[which]
            share[3], share[2] = others, earlier
            known += (earlier > 0).astype(np.int8) << 1
            # every document ends once: the end before its first token is known as often as there are other documents
            seen[1] = prior = before(now, others[begin + size - 1])
        else:
            share[2 - kind] = now
            if kind == 1:
                seen[0], prior = before(now, 0), before(now, now[begin])  # nothing is known before a text's first token
        most = now
    share /= np.maximum(seen, 1)
    hashed = before(hashes[0] >> np.uint64((token_bits or bits) - bits), hash_of(b"", bits, seed)) & np.uint64(HASHED - 1)
    return (size, share, seen, before(known, 0), hashed.astype(np.int8), ends), whole


def _score_block(docs: pa.Table, answers: pa.Table, n: int, v: int, bits: int, token_bits: int, seed: int) -> pa.Table:
    texts, learn = docs["text"].combine_chunks(), docs["learn"].to_numpy(zero_copy_only=False)
    if not len(texts):
        return pa.table({c: pa.array([], k) for c, k in (("id", docs["id"].type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64()))})
    size, doc, hashes = grams(texts, bits, token_bits, seed)
    kinds, cells = answers["kind"].to_numpy(), answers["cell"].to_numpy()
    counts, spelt = [], np.zeros(0)
    for kind in range(3):
        rows = np.flatnonzero(kinds == kind)
        rows = rows[np.argsort(cells[rows])]
        counts.append(np.concatenate([restored(answers["counts"][int(r)].as_py(), COUNTS)[0] for r in rows]).astype(np.int64))
        if kind == 0:
            spelt = np.concatenate([np.frombuffer(answers["spelt"][int(r)].as_py(), "<f4") for r in rows])
    args, c = contexts(size, doc, hashes, counts, spelt, learn, n, bits, token_bits, seed)
    begin = np.cumsum(size) - size
    total = lambda x: np.add.reduceat(x, begin)
    score = total(source_log2(*args))
    length = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    return pa.table({
        "id": docs["id"], "held_out": ~learn, "n_tokens": size, "n_known": total((c > 0).astype(np.int64)),
        "base_score": total(np.log10((c + 1) / (n + (v + 1)))), "score": score * np.log10(2), "bits_per_byte": -score / np.maximum(length, 1),
    })


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row; ``learn`` says
    which rows of ``docs`` to learn from, and the others are held out."""
    spark = docs.sparkSession
    counts = written(token_counts(docs, learn, text_col))
    n, v, different = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count("*")).first()
    shared = spark.sparkContext.broadcast(Sights(predictor_counts(counts)))
    weights = mixing_weights(counts, shared)

    size = only(docs, text_col).agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    blocks, cells = -(-size // BLOCK_BYTES) + 1, -(-3 * n // CELL) + 1
    bits = max(32, int(n).bit_length() + SPARE_BITS)
    token_bits = min(63, max(bits, 2 * int(different).bit_length() + 4))
    seed = apart(counts, token_bits)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
        F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.spark_partition_id()), F.lit(blocks)).alias("block"),  # equal rows of different tasks part
    ).repartition(max(partitions(spark), blocks), "block")
    questions = asked(rows, cells, bits, token_bits, seed).union(spelt_cells(counts, shared, weights, cells, token_bits, seed))
    answers = questions.groupBy("cell").applyInArrow(answered, ANSWERS)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda d, a: _score_block(d, a, n, v, bits, token_bits, seed),
        f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double",
    )
    return out.withColumn("train_tokens", F.lit(n).cast("long")).withColumnRenamed("id", id_col)


def op10_lm(spark, sf_dir: str) -> DataFrame:
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7, F.lit(0)) != 2
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), learn)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
