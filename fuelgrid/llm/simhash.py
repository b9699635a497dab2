"""SimHash near-duplicate classes by meet-in-the-middle ball hashing.

Two fingerprints within two bits of one another share a variant that is within one bit of both. So every distinct
fingerprint emits itself and its 64 one-bit variants, the variants are shuffled, and fingerprints that meet at a
variant are linked. At a variant v the fingerprints that can meet are v itself and v with one bit flipped: 65 at most,
however many documents there are, so one 64-bit mask and a flag hold a whole bucket and the shuffle can combine.
Linking each to one of its bucket keeps all links: any two of a bucket are within two bits.

Copies collapse to their fingerprint before the variants are made, so a group of copies of any size costs one row.

Cases: a null or blank text has no words; its fingerprint is zero and links like any other. Repeated rows keep one
row each in the result. A null id gets a fingerprint and belongs to its class, but never names it unless it is alone.
An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, partitions, written

BROADCAST_IDS, VARIANTS_A_TASK = 2_000_000, 50_000
SHINGLE, RADIUS, BITS, SEED = 3, 2, 64, 42
#: Links that a task joins at once.
CHUNK = 1 << 18


def _hashes(text: str | None, width: int) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    first, last = [0, *ends[: max(0, len(words) - width)].tolist()], (ends[min(width, len(words)) - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return [h(line[a:b], SEED) for a, b in zip(first, last)]


def _majority(hashes: list[int]) -> int:
    """The signed 64-bit number whose bits are set where over half of the hashes have theirs."""
    if not hashes:
        return 0
    n, total = len(hashes), np.zeros(BITS, np.int64)
    values = np.array(hashes, "<u8")
    for at in range(0, n, 65536):
        bits = np.unpackbits(values[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp): the SimHash of each whole text as a signed long."""
    rows = only(docs, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_majority(_hashes(t.as_py(), width)) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(fp, pa.int64())], [id_col, "fp"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, fp long")


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: links that join the same fingerprints as all pairs of distinct ``fp`` within two bits."""
    flips = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(BITS)])
    # 65 variants of each: as many tasks as there are fingerprints for, since a plan that joins small partitions can't know
    tasks = max(partitions(prints.sparkSession), -(-prints.count() // VARIANTS_A_TASK))
    distinct = prints.select("fp").distinct().repartition(tasks, "fp")
    own = distinct.select(F.col("fp").alias("v"), F.lit(0).cast("long").alias("mask"), F.lit(1).alias("own"))
    near = distinct.select("fp", F.explode(flips).alias("bit")).select(
        F.col("fp").bitwiseXOR(F.col("bit")).alias("v"), F.col("bit").alias("mask"), F.lit(0).alias("own")
    )
    met = own.union(near).groupBy("v").agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own"))
    met = met.filter(F.bit_count("mask") + F.col("own") > 1)
    flipped = F.transform(F.filter(flips, lambda f: F.col("mask").bitwiseAND(f) != 0), lambda f: F.col("v").bitwiseXOR(f))
    members = met.select(F.when(F.col("own") == 1, F.concat(F.array("v"), flipped)).otherwise(flipped).alias("m"))
    pairs = members.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).filter("a < b")
    return pairs.distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def _key(x):
    """What orders as ``x`` does in Spark: nulls first, structs field by field."""
    if isinstance(x, dict):
        x = tuple(map(_key, x.values()))
    return (x is not None, x) if x is not None else (False,)


def hung(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: links that join the same nodes as ``edges`` (a, b), where each node of every ``CHUNK`` links of a task
    hangs on the least that these join it to. So chains within a task are gone before anything is shuffled."""
    kind = edges.schema["a"].dataType.simpleString()
    if any(k in kind for k in ("float", "double", "array", "interval", "map")):  # their order isn't Python's
        return edges

    def joined(links: pa.Table) -> pa.RecordBatch:
        nodes = pa.concat_arrays([x for c in ("a", "b") for x in links.column(c).chunks])
        if pa.types.is_integer(nodes.type):
            keys = nodes.to_numpy()
        else:
            found = [_key(x) for x in nodes.to_pylist()]
            place = {k: n for n, k in enumerate(sorted(set(found)))}
            keys = np.array([place[k] for k in found])
        _, first, code = np.unique(keys, return_index=True, return_inverse=True)
        a, b = code.reshape(2, -1)
        root, old = np.arange(len(first)), None
        while old is None or (root != old).any():
            old, low = root, np.minimum(root[a], root[b])
            root = old.copy()
            np.minimum.at(root, old[a], low)
            np.minimum.at(root, old[b], low)
            while (root[root] != root).any():
                root = root[root]
        low = np.flatnonzero(root != np.arange(len(root)))
        return pa.record_batch([nodes.take(pa.array(first[root[low]])), nodes.take(pa.array(first[low]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] * (batch.num_rows > 0)
            if sum(x.num_rows for x in held) >= CHUNK:
                yield joined(pa.Table.from_batches(held))
                held = []
        if held:
            yield joined(pa.Table.from_batches(held))

    return edges.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), a < b: root is the least node that it is joined to.

    Two steps take turns until each node hangs on one root that hangs on none: a node's larger neighbours are hung on its
    least one, then its smaller neighbours and itself on the least of these. Between them each task joins what it holds of
    the links (``hung``), which saves most steps. Every step keeps the components; links are written to the shared folder, and
    what a step knows of the nodes, one row each, is the result once nothing is left to do.
    """
    now, large = written(hung(written(edges.select("a", "b")))), True
    while True:
        ends = F.array(F.struct(F.col("a").alias("node"), F.lit(None).cast(now.schema["a"].dataType).alias("on")), F.struct(F.col("b").alias("node"), F.col("a").alias("on")))
        nodes = now.select(F.inline(ends)).groupBy("node").agg(F.min("on").alias("low"), F.max("on").alias("high"), (F.count("on") < F.count("*")).alias("holds"))
        nodes = written(nodes)
        if nodes.filter("low < high OR (holds AND low IS NOT NULL)").isEmpty():
            return nodes.select("node", F.coalesce("low", "node").alias("root"))
        low = nodes.filter("low IS NOT NULL").select("node", "low")
        if large:
            met = now.join(low.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("low", "a").alias("a"), "b")
        else:
            met = now.join(low.withColumnRenamed("node", "b"), "b").select(F.inline(F.array(F.struct(F.col("low").alias("a"), F.col("a").alias("b")), F.struct(F.col("low").alias("a"), F.col("b").alias("b")))))
            met = met.filter("a < b")
        now, large = written(hung(written(met))), not large


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id) for each row: component_id is the least id in the row's class."""
    prints = written(fingerprints(docs, id_col, text_col, width))
    firsts = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    roots = written(components(links(prints)))
    # one row for each fingerprint, then one for each root: both far fewer than the documents where there are copies
    named = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return prints.join(classes, prints.fp == classes["of"]).select(id_col, "fp", "component_id")


def merged(*methods: Callable[[DataFrame, str, str], DataFrame]) -> Callable[[DataFrame, str, str], DataFrame]:
    """Classes that follow the links of all ``methods``: (id, component_id) of each row, rows told apart by id."""

    def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        found = [written(m(docs, id_col, text_col).select(id_col, "component_id")) for m in methods]
        ids = [f.select(F.col("component_id").alias("a"), F.col(id_col).alias("b")).filter("a <> b") for f in found]
        edges = ids[0]
        for more in ids[1:]:
            edges = edges.union(more)
        roots = written(components(edges))
        out = found[0].select(id_col).join(roots, F.col(id_col) == roots["node"], "left")
        return out.select(id_col, F.coalesce("root", id_col).alias("component_id"))

    return classes


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: Callable[[DataFrame, str, str], DataFrame] = near_duplicates) -> DataFrame:
    """One row of ``docs``, whole, of each class that ``classes`` finds: that of the least id, then text hash.

    Rows without an id come last. Rows are told apart by id and text hash, so one id may stand at several texts, and
    only copies go; of rows that agree in both any one stays, whole. Further columns, whatever their names, stay. The rows that go are broadcast up to ``BROADCAST_IDS`` of them; beyond, a shuffle joins them.
    """
    row = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"))
    found = written(classes(docs.select(row.alias("_row"), F.col(f"`{text_col}`").alias("_text")), "_row", "_text").select("_row", "component_id"))
    go = found.filter(F.col("_row") != F.col("component_id")).select(F.col("_row").alias("_gone")).distinct()
    if go.count() <= BROADCAST_IDS:
        go = F.broadcast(go)
    rows = docs.select(F.struct("*").alias("whole"), row.alias("row"))  # so that no column's name can clash
    kept = rows.join(go, F.col("row").eqNullSafe(F.col("_gone")), "left_anti")
    if not found.filter(F.col("_row") == F.col("component_id")).groupBy("_row").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["row"])
    return kept.select("whole.*")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
