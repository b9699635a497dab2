"""Vector compression by product codes: each part of a vector becomes the number of its codebook's nearest entry.

The search for the nearest entry goes by partial distances. The dimensions of a part are taken in descending variance of
the codebook. After the first, each vector completes the distance to the entry that looks nearest so far; entries whose
accumulated integer distance strictly exceeds the least complete distance are masked out, for all vectors of a batch at
once, and only what is left goes on to the next dimension. So the result is exact, and of equal distances the lowest entry
is taken.

Codebooks learn from all vectors, in rounds: each task sums its vectors by part and entry, the sums meet in a table of one
row for each entry (parts times entries, parameters that bound what the driver reads), and the new codebooks go out with
the next round. A round reads the table once and shuffles only those sums; rows are never shuffled, so copies of a vector,
however many, cost what other rows cost.

Cases: rows whose vector is null, is empty or holds null or non-finite components are dropped. Vectors have the length that
most of the rest have and that the parts divide (of equal counts the longer); others, which can't be cut alike, are dropped
too. Fewer vectors than entries make a smaller codebook. Rows that repeat a vec_id stay, each with a row of its own; among
first entries they come in order of their integers, and null ids last. Integers keep within 2^25 on either side. Labels'
sums are null beyond 64 bits. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, written
from .vectors import integers, whole

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Sums of labels are broadcast up to so many labels; beyond, a shuffle joins them.
BROADCAST_LABELS, AT_ONCE = 200_000, 2048


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest row of ``book`` for each row of ``x``, by partial-distance search."""
    n, k = len(x), len(book)
    variance = k * (book * book).sum(0) - book.sum(0) ** 2
    order = np.argsort(-variance, kind="stable")
    first = order[0]
    partial = (x[:, first, None] - book[None, :, first]) ** 2
    guess = partial.argmin(1)
    best = ((x - book[guess]) ** 2).sum(1)  # the least complete distance so far
    rows, entry = np.nonzero(partial <= best[:, None])
    partial = partial[rows, entry]
    for d in order[1:]:
        partial = partial + (x[rows, d] - book[entry, d]) ** 2
        starts = np.flatnonzero(np.diff(rows, prepend=-1))  # every row keeps its best entry, so all rows are here
        least = np.minimum.reduceat(partial, starts)
        looks = np.flatnonzero(partial == least[rows])
        guess = entry[looks[np.flatnonzero(np.diff(rows[looks], prepend=-1))]]
        best = np.minimum(best, ((x - book[guess]) ** 2).sum(1))
        left = partial <= best[rows]
        rows, entry, partial = rows[left], entry[left], partial[left]
    return entry[np.flatnonzero(np.diff(rows, prepend=-1))], best  # all that are left are at the least distance


def cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def _usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """(id, vec, label) of the rows that are kept, and their vectors' length."""
    rows = only(vectors, id_col, vec_col, label_col).toDF("id", "vec", "label")
    fine = rows.filter(whole(F.col("vec"), F.size("vec")) & (F.size("vec") > 0) & (F.size("vec") % parts == 0))
    lengths = fine.groupBy(F.size("vec").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).limit(1).collect()
    width = lengths[0]["n"] if lengths else parts
    return fine.filter(F.size("vec") == width), width


def _first_entries(rows: DataFrame, width: int, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    exact = F.transform("vec", lambda x: F.floor(x.cast("double") * scale))
    first = rows.select("id", "vec", exact.alias("whole")).orderBy(F.col("id").asc_nulls_last(), "whole").limit(entries).select("vec").toArrow()
    return cut(integers(first.column(0).combine_chunks(), width, scale), parts)


def _blocks(column: pa.Array, width: int, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(column), AT_ONCE):
        yield at, integers(column.slice(at, AT_ONCE), width, scale)


def train(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """The codebooks, an (entries, width / parts) array of integers for each part, from all ``rows`` (id, vec, label)."""
    books = _first_entries(rows, width, parts, entries, scale)
    size = width // parts

    def round_of(now: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((parts, len(now[0])), np.int64)
            sums = np.zeros((parts, len(now[0]), size), np.int64)
            for b in batches:
                for _, x in _blocks(b.column(0), width, scale):
                    for p, part in enumerate(cut(x, parts)):
                        entry, _ = nearest(part, now[p])
                        n[p] += np.bincount(entry, minlength=len(now[p]))
                        np.add.at(sums[p], entry, part)
            p, e = np.nonzero(n)
            cols = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e])]
            yield pa.record_batch(cols + [pa.array(sums[p, e, d]) for d in range(size)], ["part", "entry", "n", *names])

        return run

    names = [f"s{d}" for d in range(size)]
    kind = "part int, entry int, n long, " + ", ".join(f"{c} long" for c in names)
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *names)]
    for _ in range(rounds if len(books[0]) else 0):
        now = books
        books = [b.copy() for b in now]
        for r in rows.select("vec").mapInArrow(round_of(now), kind).groupBy("part", "entry").agg(*wide).collect():
            books[r["part"]][r["entry"]] = [int(r[c]) // int(r["n"]) for c in names]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def assign(rows: DataFrame, books: list[np.ndarray], width: int, scale: int = SCALE) -> DataFrame:
    """(id, label, code, error) of ``rows`` (id, vec, label): entries as two hex digits a part, squared distances summed."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _blocks(b.column(1), width, scale):
                found = [nearest(part, book) for part, book in zip(cut(x, len(books)), books)]
                codes = np.stack([e for e, _ in found], 1).astype(np.uint8)
                error = np.sum([d for _, d in found], axis=0)
                part = b.slice(at, len(x))
                yield pa.record_batch([part.column(0), part.column(2), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["id", "label", "code", "error"])

    return rows.select("id", "vec", "label").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def decode(coded: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """(id, vec) from (id, code): the entries that a code names, end to end, each divided by ``scale``."""
    kind = coded.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.frombuffer(bytes.fromhex("".join(b.column(1).to_pylist())), np.uint8).reshape(-1, len(books))
            vecs = np.concatenate([book[codes[:, p]] for p, book in enumerate(books)], 1) / scale
            yield pa.record_batch([b.column(0), pa.array(list(vecs.astype(np.float32)), pa.list_(pa.float32()))], ["id", "vec"])

    return coded.select("id", "code").mapInArrow(run, f"id {kind}, vec array<float>")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """The table (id, label, code, error) of all kept vectors, written, and the codebooks that it was coded with."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits number 256 entries at most")
    rows, width = _usable(vectors, id_col, vec_col, label_col, parts)
    books = train(rows, width, parts, entries, rounds, scale)
    return written(assign(rows, books, width, scale)), books


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    total = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    total = written(total)
    total = F.broadcast(total) if total.count() <= BROADCAST_LABELS else total
    out = coded.join(total, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round_sql(k: int, size: int = 4) -> str:
    """The assignment to the codebooks of a round, and their entries' means."""
    d = " + ".join(f"(x[{j}] - c[{j}]) * (x[{j}] - c[{j}])" for j in range(1, size + 1))
    sums = ", ".join(f"sum(x[{j}])::HUGEINT AS t{j}" for j in range(1, size + 1))
    means = ", ".join(f"((t{j} - ((t{j} % n + n) % n)) // n)::BIGINT" for j in range(1, size + 1))
    return f"""
a{k} AS MATERIALIZED (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, p, e, {d} AS d FROM part JOIN b{k} USING (p)) GROUP BY r, p),
b{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m, c) AS c
  FROM b{k} LEFT JOIN (SELECT p, e, [{means}] AS m FROM (SELECT p, e, count(*) AS n, {sums} FROM part JOIN a{k} USING (r, p) GROUP BY p, e)) USING (p, e)
)"""


#: For vectors of 64 components, as the table has them.
OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = 64
),
part AS MATERIALIZED (SELECT r, p, v[4 * p + 1 : 4 * p + 4] AS x FROM kept, range({PARTS}) t(p)),
b0 AS MATERIALIZED (
  SELECT p, e, x AS c FROM part JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept) USING (r) WHERE e < {ENTRIES}
),
{",".join(_round_sql(k) for k in range(ROUNDS + 1))},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""
