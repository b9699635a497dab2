"""Byte-pair encoding with word ends, by content-defined chunks that are encoded once and used again.

A text is cut where a rolling hash over its last bytes has some bits zero. Cuts depend on those bytes alone, so texts that
share a passage share its chunks, wherever the passage stands. A worker encodes a chunk once and remembers its ids, for all
documents of all tasks that it runs. A chunk's ids count from its first white space to its last; what stands outside, a
beginning and an end that its neighbours' words run into, is settled at the joins: the end of one chunk and the beginning of
the next are put together and encoded anew, over as many chunks as it takes until white space is met on both sides. There
the ids agree with those of the whole text: this tokenizer's normaliser, its rules for words and its special strings never
reach across ASCII white space, from which the agreement is exact. Words that are met at joins and in new chunks are remembered
likewise.

Spark deals the documents out. Nothing is shuffled: sending chunks to one place and their ids back would move the corpus
twice. A worker's memory of chunks and words is bounded and starts anew when it is full.

Cases: null and empty texts have no ids. A text without any white space is one word, encoded whole. Special strings in a text
get their ids, as the library gives them. Runs without a cut are cut at ``LONGEST`` bytes. Repeated rows, null ids and empty
tables need no care. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only
from .pieces import _slices

#: Bytes that the rolling hash sees, its bits that are zero at a cut (a chunk has some 2^CUT_BITS bytes), and a chunk's most bytes.
WINDOW, CUT_BITS, LONGEST = 16, 7, 4096
CHUNKS_REMEMBERED, WORDS_REMEMBERED, TOGETHER = 100_000, 600_000, 500
#: Marks that end a word of letters and are a word of their own.
MARKS = (b".", b",", b";", b":", b"!", b"?")
#: One number for each byte value, from a hash of it.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def cuts(text: bytes) -> np.ndarray:
    """The places, 0 and the end among them, where ``text`` is cut; all are starts of characters."""
    n = len(text)
    if not n:
        return np.zeros(1, np.int64)
    raw = np.frombuffer(text, np.uint8)
    h, reach = GEAR[raw], 1
    while reach < WINDOW:  # the hash of twice as many bytes from two hashes
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    starts = (raw & 0xC0) != 0x80
    found = np.flatnonzero((h[:-1] >> np.uint32(32 - CUT_BITS) == 0) & starts[1:]) + 1
    at = np.concatenate(([0], found, [n]))
    if np.diff(at).max() > LONGEST:
        more = [np.arange(a, b, LONGEST) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        at = np.concatenate([*more, [n]])
        while not (ok := starts[at[:-1]]).all():
            at[:-1] -= ~ok
    return np.unique(at)


class Numbered(dict):
    """Gives each new key the next number, and lists the new ones."""

    def __init__(self):
        self.fresh = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class Spans:
    """Lists of ids, end to end, by number."""

    def __init__(self, flat: np.ndarray | None = None, count: np.ndarray | None = None):
        self.flat = np.zeros(0, np.uint32) if flat is None else flat
        self.count = np.zeros(0, np.int64) if count is None else count
        self.start = np.cumsum(self.count) - self.count

    def __add__(self, more: Spans) -> Spans:
        return Spans(np.concatenate([self.flat, more.flat]), np.concatenate([self.count, more.count]))

    def ids(self, which: np.ndarray) -> np.ndarray:
        n = self.count[which]
        return self.flat[np.repeat(self.start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def merged(self, which: np.ndarray, owner: np.ndarray, owners: int) -> Spans:
        """A list for each owner: those of its ``which``, in order."""
        return Spans(self.ids(which), np.bincount(owner, self.count[which], owners).astype(np.int64))


class Encoder:
    """Encodes batches of texts; lives in one worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])  # ends a word
        self.forget()

    def forget(self) -> None:
        self.words, self.word_ids = Numbered(), Spans()
        self.forget_chunks()

    def forget_chunks(self) -> None:
        """``chunks``: of a chunk its beginning, its end and the number of what is between; None where it has no white space."""
        self.chunks: dict[bytes, tuple[bytes, bytes, int] | None] = {}
        self.chunk_ids = Spans()

    def _separately(self, words: list[bytes]) -> Spans:
        each = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return Spans(np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64))

    def _together(self, words: list[bytes]) -> Spans:
        """Words of letters in one call: the library makes one word of each, whose last id tells it from the next."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):  # a letter to Python alone
            return self._separately(words)
        return Spans(ids, np.diff(ends, prepend=0))

    def learn(self) -> None:
        """Encodes the words that were numbered since."""
        fresh, self.words.fresh = self.words.fresh, []
        stems = [w[:-1] if w[-1:] in MARKS and w[:-1].isalpha() else w for w in fresh]  # letters and a mark: two words for the library
        numbered = Numbered()
        first = np.fromiter(map(numbered.__getitem__, stems), np.int64, len(stems))
        second = np.fromiter((numbered[w[-1:]] if len(w) > len(s) else -1 for w, s in zip(fresh, stems)), np.int64, len(stems))
        plain, odd = [], []
        for w in numbered:
            (plain if w.isalpha() or not w.isascii() and w.decode().isalpha() else odd).append(w)
        own = Spans()
        if numbered:
            got = [self._together(plain[at : at + TOGETHER]) for at in range(0, len(plain), TOGETHER)]
            got += [self._separately(odd[at : at + TOGETHER]) for at in range(0, len(odd), TOGETHER)]
            own = Spans(np.concatenate([x.flat for x in got]), np.concatenate([x.count for x in got]))
        place = np.empty(len(numbered), np.int64)
        place[np.fromiter(map(numbered.__getitem__, plain + odd), np.int64, len(numbered))] = np.arange(len(numbered))
        which = np.stack((first, second), 1)
        owner = np.broadcast_to(np.arange(len(fresh))[:, None], which.shape)[which >= 0]
        self.word_ids += own.merged(place[which[which >= 0]], owner, len(fresh))

    def learn_chunks(self, fresh: dict[bytes, list[bytes]]) -> None:
        """Encodes new chunks: what stands between a chunk's first white space and its last."""
        inner, first = [], len(self.chunk_ids.count)
        for c, words in fresh.items():
            head, tail = not c[:1].isspace(), not c[-1:].isspace()
            if head and tail and len(words) == 1:
                self.chunks[c] = None
                continue
            self.chunks[c] = (words[0] if head else b"", words[-1] if tail else b"", first + len(inner))
            inner.append(words[head : len(words) - tail])
        which = np.array([n for words in inner for n in map(self.words.__getitem__, words)], np.int64)
        self.learn()
        owner = np.repeat(np.arange(len(inner)), [len(words) for words in inner])
        self.chunk_ids += self.word_ids.merged(which, owner, len(inner))

    def joined(self, chunks: list[bytes]) -> list[int]:
        """A text's chunks as what to put end to end: a word at a join by its number, what a chunk is made of by -1 - number."""
        out, open_, known, number = [], b"", self.chunks, self.words.__getitem__
        for c in chunks:
            own = known[c]
            if own is None:  # no white space: the join reaches on
                open_ += c
                continue
            begin, end, of = own
            if open_ or begin:
                out.append(number(open_ + begin))
            out.append(~of)
            open_ = end
        if open_:
            out.append(number(open_))
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many are each text's."""
        if len(self.words) > WORDS_REMEMBERED:
            self.forget()
        elif len(self.chunks) > CHUNKS_REMEMBERED:
            self.forget_chunks()
        rows, fresh = [], {}
        for t in texts:
            raw = (t or "").encode()
            at = cuts(raw).tolist()
            own = [raw[a:b] for a, b in zip(at, at[1:])]
            fresh.update({c: c.split() for c in own if c not in self.chunks and c not in fresh})
            rows.append(own)
        self.learn_chunks(fresh)
        parts = [self.joined(own) for own in rows]
        self.learn()
        which = np.array([n for own in parts for n in own], np.int64)
        owner = np.repeat(np.arange(len(parts)), [len(own) for own in parts])
        found = (self.word_ids + self.chunk_ids).merged(np.where(which >= 0, which, len(self.words) + ~which), owner, len(texts))
        return found.flat, found.count


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder: tasks that run in it one after another share what it has met."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Decoder:
    """Ids to text: the strings of the ids with spaces between, as the library joins them where no decoder is set."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.decoder is not None:
            raise ValueError("this tokenizer has a decoder of its own")
        self.strings = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]

    def decode(self, ids: list[int]) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in ids])


_decoders: dict[str, Decoder] = {}


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) for each row."""
    rows = only(docs, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for b in batches:
            for part in _slices(b, 1):
                ids, n = own.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([part.column(0), pa.array(n), lists], [id_col, "n_tokens", "ids"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids); null ids give an empty text."""
    rows = only(encoded, id_col, ids_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(tokenizer)
        for b in batches:
            texts = [own.decode(x.as_py() or []) for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, text string")


def digests(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of (id, n_tokens, ids): of the ids as little-endian 32-bit numbers, and
    of the text that they decode to."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(tokenizer)
        for b in batches:
            of_ids, of_text = [], []
            for x in b.column("ids"):
                ids = x.values.to_numpy(zero_copy_only=False)
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids.tolist()).encode()).hexdigest())
            yield pa.record_batch([b.column(id_col), b.column("n_tokens"), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_word_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
