"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

A batch's distinct words, which no piece can cross, are laid end to end and indexed by a suffix array; each piece of
the vocabulary is binary-searched for the range of its occurrences; the occurrences, edges of a lattice over the text,
are sorted by position; and the lattice is relaxed by joining, in every word at once, the adjacent pair whose edge
scores best, leftmost first, until none is left. That is the order in which the model's own merges apply, so the ids
are the ones its library gives.

Spark deals the documents out; a task remembers the words it has met, up to a bound, and never holds more than a few
megabytes of text. Nothing is shuffled or sent to the driver.

Cases: null and empty texts have no ids. A text's own U+2581 is encoded as a space, as the model's library does, so
such a text doesn't come back unchanged (``round_trip`` is false). Characters outside the vocabulary become bytes.
Words over 64 characters take a heap instead of the lockstep, so their cost stays n log n. Repeated rows, null ids and
empty tables need no care. Further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import only

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LOCKSTEP, TEXT_AT_ONCE, CHARS_AT_ONCE, REMEMBERED = 64, 1 << 22, 1 << 18, 300_000
NONE = np.float32(-np.inf)


@dataclass
class Vocabulary:
    """What is used of a model file. ``score`` is -inf for pieces that text never turns into."""

    pieces: list[str]
    score: np.ndarray
    byte_ids: np.ndarray  # the id of each of the 256 bytes
    dummy_prefix: bool = True

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        score = np.array([sp.get_score(i) if ok else NONE for i, ok in enumerate(plain)], np.float32)
        byte_ids = np.full(256, sp.unk_id(), np.int32)
        for i in range(n):
            if sp.is_byte(i):
                byte_ids[int(pieces[i][1:-1], 16)] = i
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p, ok in zip(pieces, plain) if ok):
            raise ValueError("pieces of this model cross words; it can't be matched word by word")
        return cls(pieces, score, byte_ids)


class Encoder:
    """Encodes batches of texts; lives in one task."""

    unit = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        usable = np.flatnonzero(vocabulary.score > NONE)
        self.ids = usable.astype(np.int32)
        self.lengths = np.array([len(vocabulary.pieces[i]) for i in usable], np.int64)
        self.depth = int(self.lengths.max())
        self.codes = np.zeros((len(usable), self.depth), np.uint32)
        for row, i in zip(self.codes, usable):
            row[: len(vocabulary.pieces[i])] = [ord(c) for c in vocabulary.pieces[i]]
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position * (depth + 1) + length, piece id) of every piece occurrence in ``text``, by position."""
        letters = np.unique(text)
        rank = (np.searchsorted(letters, text) + 1).astype(">u2")
        padded = np.concatenate([rank, np.zeros(self.depth, ">u2")]).astype(">u2")
        suffixes = np.lib.stride_tricks.sliding_window_view(padded, self.depth)[: len(text)]
        keys = np.ascontiguousarray(suffixes).view(">u8").astype(np.uint64)  # four characters a key
        order = np.lexsort(keys.T[::-1])
        table = np.ascontiguousarray(suffixes[order]).view(f"S{2 * self.depth}").ravel()
        near = np.searchsorted(letters, self.codes)
        known = (letters[np.minimum(near, len(letters) - 1)] == self.codes) | (self.codes == 0)
        can = np.flatnonzero(known.all(1))
        inside = np.arange(self.depth) < self.lengths[can, None]
        low = np.where(inside, near[can] + 1, 0).astype(">u2")
        high = np.where(inside, near[can] + 1, 0xFFFF).astype(">u2")
        as_bytes = lambda x: np.ascontiguousarray(x).view(f"S{2 * self.depth}").ravel()
        first, last = np.searchsorted(table, as_bytes(low)), np.searchsorted(table, as_bytes(high), "right")
        n = last - first
        hits = order[np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        packed = ((hits * (self.depth + 1) + np.repeat(self.lengths[can], n)) << 20) | np.repeat(self.ids[can], n)
        packed.sort()
        return packed >> 20, packed & 0xFFFFF

    def learn(self, units: list[str]) -> None:
        """Adds the ids of new distinct units to what is remembered."""
        parts, counts, at = [], [], 0
        while at < len(units):
            end, chars = at, 0
            while end < len(units) and (end == at or chars + len(units[end]) < CHARS_AT_ONCE):
                chars += len(units[end]) + 1
                end += 1
            flat, count = self._encode(units[at:end])
            parts.append(flat)
            counts.append(count)
            at = end
        self.flat = np.concatenate([self.flat, *parts])
        self.count = np.concatenate([self.count, *counts])

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\0".join(units) + "\0"
        text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(u) for u in units], np.int64)
        base = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        at, piece = self.edges(text)
        lattice = np.full(len(text) * (self.depth + 1) + self.depth + 1, -1, np.int32)
        lattice[at] = piece
        scores = np.append(self.v.score, NONE)  # -1 finds the last
        cuts = np.zeros(len(text) + 1, bool)  # where tokens start
        for length in np.unique(size[size <= LOCKSTEP]):
            own = np.flatnonzero(size == length)
            b = np.broadcast_to(np.arange(length + 2), (len(own), length + 2)) * 1
            b = np.minimum(b, length)
            left = np.arange(len(own))
            while len(left):
                x = b[left]
                span = x[:, 2:] - x[:, :-2]
                fits = (span <= self.depth) & (x[:, 1:-1] < length)
                p = np.where(fits, scores[lattice[(base[own[left], None] + x[:, :-2]) * (self.depth + 1) + np.where(fits, span, 0)]], NONE)
                if p.shape[1] == 0:
                    break
                best = p.argmax(1)
                go = p[np.arange(len(left)), best] > NONE
                left, best, x = left[go], best[go], x[go]
                shifted = np.concatenate([x[:, 1:], np.full((len(x), 1), length)], 1)
                b[left] = np.where(np.arange(length + 2) > best[:, None], shifted, x)
            cuts[(base[own, None] + b[:, :-1]).ravel()[(b[:, :-1] < length).ravel()]] = True
        for u in np.flatnonzero(size > LOCKSTEP):
            cuts[base[u] + np.array(self._heap(lattice, scores, int(base[u]), int(size[u])))] = True
        starts = np.flatnonzero(cuts)
        unit_of = np.searchsorted(base, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], len(text)), (base + size)[unit_of])
        ids = lattice[starts * (self.depth + 1) + (ends - starts)]
        width = np.ones(len(ids), np.int64)
        odd = np.flatnonzero(ids < 0)  # one character each
        spelt = [chr(c).encode("utf-8", "surrogatepass") for c in text[starts[odd]].tolist()]
        width[odd] = [len(s) for s in spelt]
        flat = np.repeat(ids, width)
        first = np.cumsum(width) - width
        for k, s in zip(first[odd].tolist(), spelt):
            flat[k : k + len(s)] = self.v.byte_ids[list(s)]
        return flat.astype(np.int32), np.bincount(unit_of, width, len(units)).astype(np.int64)

    def _heap(self, lattice: np.ndarray, scores: np.ndarray, base: int, n: int) -> list[int]:
        """The token starts of one long unit: its pairs wait in a heap by score and place."""
        after, before, alive, heap = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and after[j] - i <= self.depth and (s := scores[lattice[(base + i) * (self.depth + 1) + after[j] - i]]) > NONE:
                heapq.heappush(heap, (-float(s), i, after[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, k = heapq.heappop(heap)
            if alive[i] and after[i] < n and after[after[i]] == k:
                alive[after[i]] = False
                after[i] = k
                if k < n:
                    before[k] = i
                offer(i)
                if i:
                    offer(before[i])
        return [i for i in range(n) if alive[i]]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many are each text's."""
        if len(self.seen) > REMEMBERED:
            self.forget()
        fresh: list[str] = []
        seen, rows = self.seen, []
        for t in texts:
            found = self.unit.findall((SPACE if self.v.dummy_prefix else "") + t.replace(" ", SPACE)) if t else []
            for u in found:
                if u not in seen:
                    seen[u] = len(seen)
                    fresh.append(u)
            rows.append(np.fromiter(map(seen.__getitem__, found), np.int64, len(found)))
        if fresh:
            self.learn(fresh)
            self.start = np.cumsum(self.count) - self.count
        words = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        n = self.count[words]
        pick = np.repeat(self.start[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return self.flat[pick], np.bincount(row_of, n, len(texts)).astype(np.int64)


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.bytes = [p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
        for value, i in enumerate(vocabulary.byte_ids.tolist()):
            self.bytes[i] = bytes([value])
        self.drop = vocabulary.dummy_prefix

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.drop and text.startswith(" ") else text


def _slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of some megabytes of text each."""
    sizes = pc.binary_length(batch.column(text_at)).fill_null(0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and total + n > TEXT_AT_ONCE:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if batch.num_rows > at:
        yield batch.slice(at)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id, n_tokens, ids, round_trip) for each row: its ids, and whether decoding them gives its text."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    rows = only(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for b in batches:
            for part in _slices(b, 1):
                texts = part.column(1).to_pylist()
                ids, n = encoder.encode(texts)
                ends = np.cumsum(n)
                back = [decoder.decode(ids[e - k : e].tolist()) == (t or "") for t, e, k in zip(texts, ends.tolist(), n.tolist())]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids))
                yield pa.record_batch([part.column(0), pa.array(n), lists, pa.array(back)], [id_col, "n_tokens", "ids", "round_trip"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(id, text) from (id, ids); null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    rows = only(encoded, id_col, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for b in batches:
            texts = [decoder.decode(x.as_py() or []) for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, text string")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
