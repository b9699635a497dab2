"""Token ids in Arrow stream files of fixed-size lists, for random access without copying.

A part is two files in the shared folder. ``ids`` holds record batches of two columns, both fixed-size lists of
``LENGTH``: sequence (unsigned ids, of 16 bits where the vocabulary allows) and mask (true for an id, false for the
padding at the part's end). ``index`` has a
row for each document: its id, where it starts in the part, and its number of ids. Any sequence or document is a
slice of a memory map.

Documents are sorted into parts by ranges of their ids, so the parts in order hold all ids in order. A task writes
under a name of its own and reports it only when both files are closed; the manifest, a written table, lists one file
for each part, so a task that is tried again or run twice leaves at most a file that nothing refers to.

Cases: null and empty texts are the end id alone. Null ids come first. Rows that repeat an id are ordered by their
texts. Very long texts span batches. An empty table writes no part and reads back as no rows. Further columns are
ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, partitions, shared_dir, written

LENGTH, SEQUENCES, END = 2048, 128, 0
REMEMBERED, TEXT_AT_ONCE = 1_000_000, 1 << 22


def schema(length: int, vocabulary: int) -> pa.Schema:
    """Ids of up to 65,536 pieces take two bytes each."""
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema({"sequence": pa.list_(kind, length), "mask": pa.list_(pa.bool_(), length)})


INDEX = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64()})


class Seen(dict):
    """Units and their numbers; one that is asked for the first time gets the next, and is noted as fresh."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.fresh.append(unit)
        return n


class Encoder:
    """Encodes texts unit by unit with the tokenizers library, and remembers the units it has met.

    A unit starts at each space that stands before a character other than white space. The tokenizer's own splitting
    always cuts there, so the units' ids in a row are the text's ids. New units are laid end to end and encoded in
    one call; the bytes that each id stands for tell whose it is.
    """

    odd = re.compile(r" (?=\s|$)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        # a byte-level vocabulary spells each byte as one character; added tokens are spelt as they are
        self.width = np.array([len((self.tokenizer.id_to_token(i) or "").encode("utf-8") if i in self.tokenizer.get_added_tokens_decoder() else self.tokenizer.id_to_token(i) or "") for i in range(self.size)], np.int64)
        self.forget()

    def forget(self) -> None:
        self.seen = Seen()
        self.flat, self.count, self.start = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @classmethod
    def units(cls, text: str) -> list[str]:
        """The text's units; all but the first are without the space that they start with."""
        parts = text.split(" ")
        if not cls.odd.search(text):
            return parts
        out = parts[:1]
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def learn(self, fresh: list[str]) -> None:
        ids, ends = [np.zeros(0, np.uint32)], []
        for at in range(0, len(fresh), 20_000):
            own = fresh[at : at + 20_000]
            got = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(own)], add_special_tokens=False)[0].ids, np.uint32)
            spelt = np.cumsum(self.width[got])
            wanted = np.cumsum(np.fromiter((len(u.encode("utf-8", "surrogatepass")) + 1 for u in own), np.int64, len(own)))
            last = np.searchsorted(spelt, wanted)
            if not len(got) or not np.array_equal(spelt[last], wanted):
                raise ValueError("an id crosses two units; this tokenizer doesn't cut before spaces")
            ends.append(np.diff(last + 1, prepend=0))
            ids.append(got)
        self.flat = np.concatenate([self.flat, *ids])
        self.count = np.concatenate([self.count, *ends])
        self.start = np.cumsum(self.count) - self.count

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.seen) > REMEMBERED:
            self.forget()
        rows = [self.units(t) for t in texts]
        firsts = [e.ids for e in self.tokenizer.encode_batch_fast([r[0] for r in rows], add_special_tokens=False)]
        last = np.cumsum([len(r) - 1 for r in rows], dtype=np.int64)  # where each text's units end among those of all
        units = chain.from_iterable(islice(r, 1, None) for r in rows)
        places = np.fromiter(map(self.seen.__getitem__, units), np.int64, int(last[-1]) if rows else 0)
        if self.seen.fresh:
            fresh, self.seen.fresh = self.seen.fresh, []
            try:
                self.learn(fresh)
            except ValueError:
                self.forget()
                raise
        n = self.count[places]
        ends = np.cumsum(n)
        pick = np.repeat(self.start[places] - (ends - n), n)
        pick += np.arange(len(pick))
        ids, ends = self.flat[pick], np.concatenate([[0], ends])[last]
        return [np.concatenate([np.array(f, np.uint32), x]) for f, x in zip(firsts, np.split(ids, ends[:-1]))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder: tasks that run in it one after another share what it has met."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class PartWriter:
    """Fills fixed-size sequences with the ids of one document after another."""

    def __init__(self, folder: str, length: int, vocabulary: int):
        self.length, self.schema, name = length, schema(length, vocabulary), uuid.uuid4().hex
        self.store, base = fs.FileSystem.from_uri(folder)
        self.store.create_dir(base, recursive=True)
        self.names = [f"{folder}/{name}.ids.arrow", f"{folder}/{name}.index.arrow"]
        self.files = [self.store.open_output_stream(f"{base}/{name}.{kind}.arrow") for kind in ("ids", "index")]
        self.out = [pa.ipc.new_stream(f, s) for f, s in zip(self.files, (self.schema, INDEX))]
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_docs = 0
        self.index: list[tuple] = []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.index.append((key, self.n_ids, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.n_docs += 1
        if self.n_held >= self.length * SEQUENCES:
            self.flush(False)

    def flush(self, end: bool) -> None:
        ids = np.concatenate([*self.held, np.zeros(0, np.uint32)]).astype(np.uint32)
        whole = len(ids) // self.length * self.length
        for at in range(0, whole, self.length * SEQUENCES):
            self._batch(ids[at : min(whole, at + self.length * SEQUENCES)])
        rest = ids[whole:]
        if end and len(rest):
            self._batch(rest)
            rest = rest[:0]
        self.held, self.n_held = [rest], len(rest)
        if self.index:
            cols = zip(*self.index)
            self.out[1].write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in cols], schema=INDEX))
            self.index = []

    def _batch(self, ids: np.ndarray) -> None:
        short = -len(ids) % self.length
        mask = np.arange(len(ids) + short) < len(ids)
        ids = np.concatenate([ids, np.zeros(short, np.uint32)]).astype(self.schema.field("sequence").type.value_type.to_pandas_dtype())
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out[0].write_batch(pa.record_batch(cols, schema=self.schema))

    def close(self) -> None:
        self.flush(True)
        for x in (*self.out, *self.files):
            x.close()


class PartReader:
    """Random access to a part. From a local folder the file is memory-mapped and ids are views of it."""

    def __init__(self, ids_file: str):
        store, path = fs.FileSystem.from_uri(ids_file)
        source = pa.memory_map(path) if store.type_name == "local" else store.open_input_file(path).read_buffer()
        self.batches = list(pa.ipc.open_stream(source))  # views; nothing of a map is read yet
        self.length = self.batches[0].schema.field("sequence").type.list_size if self.batches else 1
        self.ends = np.cumsum([b.num_rows for b in self.batches]) * self.length

    def sequence(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of the n-th sequence."""
        k = int(np.searchsorted(self.ends, n * self.length, "right"))
        at = n * self.length - (int(self.ends[k - 1]) if k else 0)
        view = lambda c: self.batches[k].column(c).flatten().slice(at, self.length).to_numpy(zero_copy_only=c == "sequence")
        return view("sequence"), view("mask")

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views that together are the ids from ``start`` on."""
        k = int(np.searchsorted(self.ends, start, "right"))
        while n > 0:
            at = start - (int(self.ends[k - 1]) if k else 0)
            ids = self.batches[k].column("sequence").flatten().to_numpy()[at : at + n]
            yield ids
            start, n, k = start + len(ids), n - len(ids), k + 1


def write(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Writes the files and returns their manifest: (part, ids_file, index_file, n_docs, n_ids)."""
    folder = shared_dir(docs.sparkSession)
    rows = only(docs, id_col, text_col).toDF("id", "text").repartitionByRange(partitions(docs.sparkSession), F.col("id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("id").asc_nulls_first(), "text").select("id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, out, part = encoder(tokenizer), np.array([END], np.uint32), None, 0
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1)
            out, part, at = out or PartWriter(folder, length, encode.size), b.column(2)[0].as_py() if b.num_rows else part, 0
            while at < b.num_rows:
                own, size = [], 0
                while at + len(own) < b.num_rows and size < TEXT_AT_ONCE:
                    own.append(texts[at + len(own)].as_py() or "")
                    size += len(own[-1])
                for key, ids in zip(keys[at:], encode.encode(own)):
                    out.add(key, np.concatenate([ids, end]))
                at += len(own)
        if out:
            out.close()
            yield pa.record_batch([pa.array([x]) for x in (part, *out.names, out.n_docs, out.n_ids)], ["part", "ids_file", "index_file", "n_docs", "n_ids"])

    return written(rows.mapInArrow(run, "part long, ids_file string, index_file string, n_docs long, n_ids long"))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; start counts the ids of all before it."""
    spark = manifest.sparkSession
    start, parts = 0, []
    for r in manifest.orderBy("part").collect():  # a row for each file
        parts.append((r.ids_file, r.index_file, start))
        start += r.n_ids
    files = spark.createDataFrame(parts, "ids_file string, index_file string, before long").repartition(max(1, len(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                ids = PartReader(f["ids_file"])
                store, path = fs.FileSystem.from_uri(f["index_file"])
                with store.open_input_stream(path) as s:
                    for docs in pa.ipc.open_stream(s):
                        crc = []
                        for at, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()):
                            c = 0
                            for view in ids.span(at, n):
                                c = zlib.crc32(view.astype("<u4"), c)
                            crc.append(c)
                        began = pa.array(docs.column("start").to_numpy() + f["before"])
                        yield pa.record_batch([docs.column("doc_id"), began, docs.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read(write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")))
