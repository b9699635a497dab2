"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Score = sigmoid(bias + sum w_i x_i + sum over i < j of <v_i, v_j> x_i x_j). The pairwise part is worked out in time
linear in the features by the sum-of-squares identity, 1/2 sum over f of ((sum v_if x_i)^2 - sum v_if^2 x_i^2).

Fitting takes at most ``SAMPLE`` labelled rows, those of least hashed id, so it is the same at every size and the
driver holds no more than their sparse features. Scoring reads every whole text, in Arrow batches on the executors,
with the model (a few megabytes, of fixed size) broadcast.

The features come from the text alone: labels, lang, source and ids are never inputs of a score.

Cases: a null text counts as empty; an empty text has all features zero but the constant ones and gets the score those
give. Repeated rows score alike. Where no row is labelled, or all labels are one class, the model falls back to the
smoothed share of good labels. Ids labelled twice take the lower label. An empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

BUCKETS, RANK, SAMPLE = 1 << 16, 8, 20_000
THRESHOLD = 0.7
#: Structure statistics follow the hashed words in the feature space.
STATISTICS = ("capitals", "symbols", "shouts", "bars", "digits", "stutter", "variety", "word_length", "lines", "log_length", "marks", "constant")
WIDTH = BUCKETS + len(STATISTICS)
_UPPER = bytes(range(65, 91))


class _Buckets(dict):
    """Word -> hashed bucket, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        b = self[word] = xxhash.xxh32_intdigest(word) % BUCKETS
        return b


def _statistics(text: bytes, ids: np.ndarray, distinct: int) -> list[float]:
    n, chars = max(1, len(ids)), max(1, len(text))
    share = lambda those, whole: (len(text) - len(text.translate(None, those))) / whole
    return [
        min(2.0, 2 * share(_UPPER, chars)),
        min(2.0, share(b"#*$%&|<>", n)),
        min(2.0, share(b"!", n)),
        min(2.0, 2 * share(b"|", n)),
        min(2.0, share(b"0123456789", chars)),
        2 * float(np.count_nonzero(ids[1:] == ids[:-1])) / n,
        min(2.0, distinct / (4 * n**0.5)),
        min(2.0, chars / n / 8),
        min(2.0, 10 * text.count(b"\n") / n),
        np.log1p(len(ids)) / 8,
        min(2.0, 5 * share(b".,;:?", n)),
        1.0,
    ]


def features(texts: Iterator[str | None], memo: _Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows as (start of each row, feature, value); word counts are log-scaled and of unit length."""
    starts, idx, val, at = [0], [], [], 0
    for t in texts:
        text = (t or "").encode("utf-8", "surrogatepass")
        ids = np.fromiter(map(memo.__getitem__, text.split()), np.int64)
        some, counts = np.unique(ids, return_counts=True)
        x = np.log1p(counts)
        x /= max(1e-9, np.sqrt(x @ x))
        idx += [some, np.arange(BUCKETS, WIDTH)]
        val += [x, _statistics(text, ids, len(some))]
        at += len(some) + len(STATISTICS)
        starts.append(at)
    cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return np.array(starts), cat(idx, np.int64), cat(val, np.float32)


@dataclass
class Model:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, starts: np.ndarray, idx: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each row, and the rows' sums of v_i x_i."""
        if len(starts) == 1:
            return np.zeros(0), np.zeros((0, self.v.shape[1]))
        vx = self.v[idx] * val[:, None]
        sums = np.add.reduceat(vx, starts[:-1])
        pair = 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts[:-1]))
        return self.bias + np.add.reduceat(self.w[idx] * val, starts[:-1]) + pair, sums

    def score(self, *rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*rows)[0], -30, 30)))


def fit(starts: np.ndarray, idx: np.ndarray, val: np.ndarray, labels: np.ndarray, rank: int = RANK, epochs: int = 8, batch: int = 256, rate: float = 0.1, l2: float = 1e-4, seed: int = 7) -> Model:
    """AdaGrad on the logistic loss, rows in a seeded order."""
    rng, n = np.random.default_rng(seed), len(labels)
    share = (labels.sum() + 1) / (n + 2)
    m = Model(float(np.log(share / (1 - share))), np.zeros(WIDTH, np.float32), (0.02 * rng.standard_normal((WIDTH, rank))).astype(np.float32))
    if n == 0 or labels.min() == labels.max():
        m.v[:] = 0
        return m
    gw, gv, gb = np.full(WIDTH, 1e-3, np.float32), np.full((WIDTH, rank), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(n)
        for rows in np.array_split(order, -(-n // batch)):
            sizes = starts[rows + 1] - starts[rows]
            own = np.concatenate(([0], np.cumsum(sizes)))
            pick = np.repeat(starts[rows] - own[:-1], sizes) + np.arange(own[-1])
            i, x = idx[pick], val[pick]
            z, sums = m.margin(own, i, x)
            err = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - labels[rows]) / len(rows)
            e = np.repeat(err, sizes) * x
            some, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, e) + l2 * m.w[some]
            pairs = e[:, None] * (np.repeat(sums, sizes, axis=0) - m.v[i] * x[:, None])
            dv = np.stack([np.bincount(back, pairs[:, f]) for f in range(rank)], 1) + l2 * m.v[some]
            gw[some] += dw**2
            gv[some] += dv**2
            gb += err.sum() ** 2
            m.w[some] -= rate * dw / np.sqrt(gw[some])
            m.v[some] -= rate * dv / np.sqrt(gv[some])
            m.bias -= rate * err.sum() / gb**0.5
    return m


def remainder(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id has remainder 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % parts, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """The model fitted on at most ``sample`` labelled rows, those of least hashed id."""
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = only(docs, id_col, text_col).toDF("_id", "_text").join(F.broadcast(chosen), "_id")  # sample bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Buckets()
        for b in batches:
            starts, idx, val = features((t.as_py() for t in b.column(1)), memo)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x))  # noqa: E731, B023
            yield pa.record_batch([b.column(0), b.column(2), lists(idx.astype(np.int32)), lists(val)], ["_id", "_y", "idx", "val"])

    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.select("_id", "_text", "_y").mapInArrow(run, f"_id {kind}, _y int, idx array<int>, val array<float>").toArrow()
    out = out.sort_by("_id").combine_chunks()
    flat = lambda c, kind: np.concatenate([np.asarray(x.flatten()) for x in out[c].chunks] or [np.zeros(0)]).astype(kind)
    sizes = np.asarray(pc.list_value_length(out["idx"]).combine_chunks()) if len(out) else np.zeros(0, int)
    return fit(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), flat("idx", np.int64), flat("val", np.float32), np.asarray(out["_y"].combine_chunks() if len(out) else [], np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = only(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Buckets()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = shared.value.score(*features((t.as_py() for t in part.column(1)), memo))
                yield pa.record_batch([part.column(0), pa.array(got, pa.float64())], [id_col, "score"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", at: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``at`` or more, whole."""
    shared, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Buckets()
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                yield part.filter(pa.array(shared.value.score(*features((t.as_py() for t in part.column(column)), memo)) >= at))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted; rows of the held-out remainder teach nothing."""
    model = train(docs, labels.filter(remainder(F.col("doc_id"), parts) != held))
    out = score(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), parts) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
