"""Clustering around centroids, with balls of vectors assigned whole.

Each task lays its vectors out in blocks and grows a metric tree over each: a node halves its vectors along the line
between two far ones and stores their number, their integer sum and a radius around their mean. A round descends the trees
of a block level by level, all nodes of a level at once. By the triangle inequality a centroid that is farther from the
ball's centre than the nearest one by more than two radii is nearest to none of the ball's vectors; where one centroid
is left, the ball counts for it whole, by its stored number and sum; else its halves are looked at, and at the leaves the
exact integer distances to the centroids that are left decide. Radii and distances of balls are doubles, compared with a
margin far above their rounding, and ties are never decided by balls, so the assignment is exact.

Trees are made once and written as a table of blocks in the shared folder; each round reads it, sums by centroid in each
task and gathers one row a centroid. Neither vectors nor trees are shuffled, and the driver holds centroids only.

Cases: kept are vectors of exactly ``width`` components, none null or non-finite. Fewer vectors than centroids make fewer
centroids. Vectors that repeat an id stay, each for itself, and are ordered among the first centroids by their components;
null ids come last there. Centroids that are equal never split a ball, the smaller number wins. A centroid without vectors
stays where it is. Integers keep within 2^25 on either side; sums of distances beyond 64 bits are null. An empty table gives an empty result. Further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, written
from .vectors import integers, squared, whole

CENTROIDS, ROUNDS, SCALE, WIDTH, SEED = 8, 10, 1024, 64, 3
BLOCK, LEAF = 4096, 24
#: Of what doubles may be off by: relative to the numbers compared.
MARGIN = 1e-9


class Tree:
    """A metric tree over the integer vectors of a block, which it puts into its own order.

    Nodes are numbered level by level; ``low`` and ``high`` bound a node's vectors, ``child`` is the number of its first
    half, the second follows (0: a leaf)."""

    ARRAYS = {"low": np.int32, "high": np.int32, "child": np.int32, "radius": np.float64, "total": np.int64}

    def __init__(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, child: np.ndarray, radius: np.ndarray, total: np.ndarray):
        self.points, self.low, self.high, self.child, self.radius = points, low, high, child, radius
        self.total = total.reshape(len(low), points.shape[1])
        self.centre = self.total / (high - low)[:, None]

    @classmethod
    def grow(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree, and the order that it puts the rows of ``points`` in."""
        order, x = np.arange(len(points)), points.astype(np.float64)
        low, high, child, radius, total = [0], [len(points)], [], [], []
        at = 0
        while at < len(low):
            own = order[low[at] : high[at]]
            mine = x[own]
            total.append(points[own].sum(0))
            apart = mine - total[-1] / len(own)
            from_centre = (apart * apart).sum(1)
            radius.append(np.sqrt(from_centre.max()) * (1 + MARGIN) + MARGIN)
            if len(own) > leaf and from_centre.max() > 0:
                one = mine[from_centre.argmax()]
                two = mine[((mine - one) ** 2).sum(1).argmax()]
                half = len(own) // 2
                order[low[at] : high[at]] = own[np.argpartition(mine @ (two - one), half)]
                child.append(len(low))
                low += [low[at], low[at] + half]
                high += [low[at] + half, high[at]]
            else:
                child.append(0)
            at += 1
        return cls(points[order], np.array(low, np.int32), np.array(high, np.int32), np.array(child, np.int32), np.array(radius), np.stack(total)), order

    def filtered(self, centroids: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
        """(nodes, centroid of each) assigned whole, and (rows, centroid of each) settled in leaves."""
        m = centroids.astype(np.float64)
        first = np.array([next(k for k, c in enumerate(centroids) if np.array_equal(c, own)) for own in centroids])
        nodes, open_ = np.zeros(1, np.int64), (first == np.arange(len(m)))[None, :]
        balls, rows = [], []
        while len(nodes):
            c = self.centre[nodes]
            d = np.sqrt(np.maximum(((c[:, None, :] - m[None, :, :]) ** 2).sum(2), 0))
            near = np.where(open_, d, np.inf).min(1)
            open_ = open_ & (d - near[:, None] <= 2 * self.radius[nodes, None] + MARGIN * (1 + d))
            alone = open_.sum(1) == 1
            balls.append((nodes[alone], open_[alone].argmax(1)))
            leaf = ~alone & (self.child[nodes] == 0)
            if leaf.any():
                ends, n = self.high[nodes[leaf]].astype(np.int64), (self.high - self.low)[nodes[leaf]].astype(np.int64)
                own = np.repeat(ends - np.cumsum(n), n) + np.arange(n.sum())
                far = np.where(np.repeat(open_[leaf], n, axis=0), squared(self.points[own], centroids), np.iinfo(np.int64).max)
                rows.append((own, far.argmin(1)))  # the first of equals
            down = ~alone & ~leaf
            nodes, open_ = np.stack((self.child[nodes[down]], self.child[nodes[down]] + 1), 1).ravel().astype(np.int64), np.repeat(open_[down], 2, axis=0)
        return balls, rows

    def sums(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each centroid the number and the sum of the vectors nearest to it."""
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        balls, rows = self.filtered(centroids)
        for nodes, to in balls:
            np.add.at(n, to, (self.high - self.low)[nodes])
            np.add.at(total, to, self.total[nodes])
        for own, to in rows:
            n += np.bincount(to, minlength=len(n))
            np.add.at(total, to, self.points[own])
        return n, total

    def labels(self, centroids: np.ndarray) -> np.ndarray:
        """The nearest centroid of each row, in the tree's order."""
        out = np.zeros(len(self.points), np.int32)
        balls, rows = self.filtered(centroids)
        for nodes, to in balls:
            for a, b, k in zip(self.low[nodes].tolist(), self.high[nodes].tolist(), to.tolist()):
                out[a:b] = k
        for own, to in rows:
            out[own] = to
        return out

    def packed(self) -> list[bytes]:
        kind = np.int16 if np.abs(self.points).max(initial=0) < 1 << 15 else np.int32
        return [self.points.astype(kind).tobytes(), *(np.ascontiguousarray(getattr(self, a), k).tobytes() for a, k in self.ARRAYS.items())]

    @classmethod
    def unpacked(cls, n: int, width: int, points: bytes, *arrays: bytes) -> Tree:
        kind = np.int16 if len(points) == 2 * n * width else np.int32
        x = np.frombuffer(points, kind).astype(np.int64).reshape(n, width)
        return cls(x, *(np.frombuffer(a, k) for a, k in zip(arrays, cls.ARRAYS.values())))


COLUMNS = ["points", *Tree.ARRAYS]


def trees(vectors: DataFrame, id_col: str, vec_col: str, scale: int, width: int, block: int = BLOCK) -> DataFrame:
    """(ids, points, low, high, child, radius, total): a row for each block of up to ``block`` vectors."""
    rows = only(vectors, id_col, vec_col).toDF("id", "vec")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
            tree, order = Tree.grow(x)
            own = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids.take(pa.array(order)))
            return pa.record_batch([own, *(pa.array([p], pa.binary()) for p in tree.packed())], ["ids", *COLUMNS])

        held, n = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, block - n)
                held.append((part.column(0), integers(part.column(1), width, scale)))
                n, at = n + part.num_rows, at + part.num_rows
                if n == block:
                    yield made(pa.concat_arrays([i for i, _ in held]), np.concatenate([x for _, x in held]))
                    held, n = [], 0
        if n:
            yield made(pa.concat_arrays([i for i, _ in held]), np.concatenate([x for _, x in held]))

    return rows.mapInArrow(run, f"ids array<{kind}>, " + ", ".join(f"{c} binary" for c in COLUMNS))


def first_centroids(vectors: DataFrame, id_col: str, vec_col: str, k: int, seed: int, scale: int, width: int) -> np.ndarray:
    """The vectors of the ``k`` ids that hash least."""
    rows = only(vectors, id_col, vec_col).toDF("id", "vec")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    exact = F.transform("vec", lambda x: F.floor(x.cast("double") * scale))
    first = rows.orderBy(digest.asc_nulls_last(), exact).limit(k).select("vec").toArrow()
    return integers(first.column(0).combine_chunks(), width, scale)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every kept vector, its distance squared, written; and the centroids, in integers."""
    kept = vectors.filter(whole(F.col(f"`{vec_col}`"), width))
    centroids = first_centroids(kept, id_col, vec_col, k, seed, scale, width)
    grown = written(trees(kept, id_col, vec_col, scale, width))
    kind = kept.schema[id_col].dataType.simpleString()
    names = [f"s{d}" for d in range(width)]

    def each(b: pa.RecordBatch) -> Iterator[Tree]:
        for r in range(b.num_rows):
            held = [b.column(c)[r].as_py() for c in COLUMNS]
            n = int(np.frombuffer(held[2], np.int32)[0])  # the first node has them all
            yield Tree.unpacked(n, width, *held)

    def round_of(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(now), np.int64), np.zeros(now.shape, np.int64)
            for b in batches:
                for tree in each(b):
                    more, added = tree.sums(now)
                    n += more
                    total += added
            own = np.flatnonzero(n)
            cols = [pa.array(own.astype(np.int32)), pa.array(n[own])]
            yield pa.record_batch(cols + [pa.array(total[own, d]) for d in range(width)], ["cluster", "n", *names])

        return run

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *names)]
    schema = "cluster int, n long, " + ", ".join(f"{c} long" for c in names)
    for _ in range(rounds if len(centroids) else 0):
        now = centroids
        centroids = now.copy()
        for r in grown.select(*COLUMNS).mapInArrow(round_of(now), schema).groupBy("cluster").agg(*wide).collect():
            centroids[r["cluster"]] = [int(r[c]) // int(r["n"]) for c in names]
    last = centroids

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, tree in enumerate(each(b)):
                to = tree.labels(last)
                away = ((tree.points - last[to]) ** 2).sum(1)
                yield pa.record_batch([b.column("ids")[r].values, pa.array(to), pa.array(away)], ["id", "cluster", "distance"])

    return written(grown.mapInArrow(assigned, f"id {kind}, cluster int, distance long")), centroids


def op12_ball_clusters(spark, sf_dir: str) -> DataFrame:
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("all")).collect()  # a row for each centroid
    hashed = {k: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for k, c in enumerate(centroids.tolist())}
    fits = lambda n: n if n < 1 << 63 else None
    table = [(r["cluster"], fits(int(r["all"])), fits(sum(int(x["all"]) for x in sums)), hashed[r["cluster"]]) for r in sums]
    known = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(k: int) -> str:
    """The assignment to the centroids of a round, and their means."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d
  FROM (SELECT r, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{k}) GROUP BY r
),
s{k} AS (
  SELECT k, i, ((t - ((t % n + n) % n)) // n)::BIGINT AS m
  FROM (
    SELECT k, i, sum(x)::HUGEINT AS t, count(*) AS n
    FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept JOIN a{k} USING (r)) GROUP BY k, i
  )
),
c{k + 1} AS MATERIALIZED (
  SELECT k, coalesce(m, c) AS c FROM c{k} LEFT JOIN (SELECT k, list(m ORDER BY i) AS m FROM s{k} GROUP BY k) USING (k)
)"""


OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = {WIDTH}
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c
  FROM (SELECT v, sha256('{SEED}:' || vec_id::VARCHAR) AS h FROM kept ORDER BY h, v LIMIT {CENTROIDS})
),
{",".join(_round_sql(k) for k in range(ROUNDS + 1))}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN c{ROUNDS} USING (k)
"""
