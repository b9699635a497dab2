"""Near-duplicate classes by the exact Jaccard similarity of word shingles: all links at a similarity or more.

Candidates come from prefixes. In any one order of all shingles, two sets of similarity s or more share a shingle among
the first n - ceil(s n) + 1 of each, so sets that meet at no such shingle needn't be compared, and none is missed. The
order is by hash, with shingles that a sample finds in many sets last, the commonest at the very end: the sample is a
hint that only saves work, any order gives the same classes.

Candidates are checked twice, and neither check loses a link. First by bitmaps of parities, some 30 times smaller than
the sets: two sets differ in at least as many shingles as their bitmaps differ in bits. Then those that are left by the
whole sets, which are made from the texts again, of these few texts alone.

Equal sets collapse to one. Sets that meet are first compared with the least of them alone; only where this leaves
several classes at a shingle are the members of different classes compared. A large family of near copies so costs its
size, not its square.

What is left at a shingle is compared without making pairs. Shingles that the same sets share, as those of one passage
mostly do, count once. Sets are split by the logarithm of their size, since those more than one step apart can't be
similar, and dealt by hash into blocks of ``BLOCK``; a task holds two blocks, compares their bitmaps as matrices and gives
out only pairs of different classes whose bitmaps allow the similarity, each at the first shingle where it meets. So rows grow with links; what grows with the square
of the unlike sets of like size at one frequent shingle is some nanoseconds a pair, and it is dealt to any number of tasks.

Cases: texts of fewer words than a shingle are one shingle; null and blank texts have the empty set and are all alike.
Repeated rows keep one row each in the result. A null id belongs to its class but names it only if all ids are null. An
empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, partitions, written
from .simhash import BROADCAST_IDS, _hashes, components

WIDTH, SIMILARITY = 5, 0.8
#: The hint's sample of texts, the least share of them that makes a shingle frequent, and how many frequent ones are kept.
SAMPLE, FREQUENT, KEPT = 20_000, 2e-4, 200_000
#: Sets in a block of those that are compared at a shingle.
BLOCK = 1024
#: Bits of a bitmap for each shingle of the set, at least.
SPREAD = 2


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted, different shingle hashes of a whole text."""
    return np.unique(np.array(_hashes(text, width), "<u8"))


def set_key(shingles: np.ndarray) -> int:
    """The hash of a set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def parities(shingles: np.ndarray) -> bytes:
    """A bitmap: bit k says whether an odd number of the set's shingles have k as their hash's lowest bits.

    Its size is a power of two. Two halves of a bitmap, one over the other by exclusive or, are that of half the size, so
    bitmaps of different sizes compare."""
    bits = max(64, 1 << (SPREAD * len(shingles) - 1).bit_length()) if len(shingles) else 64
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_be_similar(x: bytes, y: bytes, n: int, m: int, similarity: float) -> bool:
    """False only for sets of n and m shingles, with the bitmaps x and y, whose similarity is below."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):
        if len(a) > len(b):
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        else:
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    apart = int(np.unpackbits(a ^ b).sum())
    return apart <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-9


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def frequent(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """(hash, rank): the sorted hashes of shingles that many sampled texts have, and how common each is among them."""
    n = docs.count()
    text = F.col(f"`{text_col}`")
    sample = docs.select(text.alias("text")).filter(F.pmod(text_key(text), F.lit(-(-n // SAMPLE) or 1)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.record_batch([pa.array(shingle_set(t.as_py(), width).view(np.int64))], ["shingle"])

    least = max(4, math.ceil(FREQUENT * min(n, SAMPLE)))
    found = sample.mapInArrow(run, "shingle long").groupBy("shingle").count().filter(F.col("count") >= least)
    top = found.orderBy(F.col("count").desc(), "shingle").limit(KEPT).collect()  # KEPT bounds them
    known = np.array([r["shingle"] for r in top], np.int64)
    order = np.argsort(known)
    return np.stack((known[order], len(known) - order)) if len(known) else np.zeros((2, 0), np.int64)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """(id, text_key, set, n, bitmap, prefix): of each row's set its key, size, parities and first shingles, where
    frequent ones come last."""
    last = docs.sparkSession.sparkContext.broadcast(frequent(docs, text_col, width))
    rows = only(docs, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    rows = rows.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), text_key(F.col(f"`{text_col}`")).alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = last.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, keys, sizes, maps, prefixes = b.slice(at, 256), [], [], [], []
                for t in part.column(1):
                    s = shingle_set(t.as_py(), width)
                    h, n = s.view(np.int64), len(s)
                    spot = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                    common = known[spot] == h if len(known) else np.zeros(n, bool)
                    late = h[common][np.argsort(rank[spot[common]], kind="stable")] if len(known) else h[:0]
                    keys.append(set_key(s))
                    sizes.append(n)
                    maps.append(parities(s))
                    prefixes.append(np.concatenate((h[~common], late))[: n - math.ceil(similarity * n - 1e-9) + 1] if n else h)
                ends = np.cumsum([0, *map(len, prefixes)])
                first = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes)))
                cols = [part.column(0), part.column(2), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary()), first]
                yield pa.record_batch(cols, [id_col, "text_key", "set", "n", "bitmap", "prefix"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, text_key long, set long, n int, bitmap binary, prefix array<long>")


def _small(df: DataFrame) -> DataFrame:
    """``df``, written, and marked for broadcast up to ``BROADCAST_IDS`` rows."""
    df = written(df)
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def similar(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str, width: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have a Jaccard similarity of ``similarity`` or more. ``sets`` has a row for each
    set."""
    needed = _small(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct())
    known = written(sets.join(needed, "set", "left_semi").select("set", "text_key", "n", "bitmap"))
    side = lambda s, x: known.select(F.col("set").alias(s), F.col("n").alias(f"n{s}"), F.col("bitmap").alias(x))

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = zip(*(b.column(c).to_pylist() for c in ("x", "y", "na", "nb")))
            yield b.select(["a", "b"]).filter(pa.array([may_be_similar(*c, similarity) for c in cols], pa.bool_()))

    left = written(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(may, "a long, b long"))

    whole = left.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    keys = _small(known.join(whole, "set", "left_semi").groupBy("set").agg(F.min("text_key").alias("text_key")))
    texts = docs.select(F.col(f"`{text_col}`").alias("text"), text_key(F.col(f"`{text_col}`")).alias("text_key"))
    texts = texts.join(keys, "text_key").select("set", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a text that meet in one task are made once
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1)):
                if key not in seen:
                    seen.add(key)
                    s = shingle_set(t.as_py(), width)
                    if set_key(s) == key:  # a text of another set may share the text's hash
                        yield pa.record_batch([pa.array([key]), pa.array([s.tobytes()], pa.binary())], ["set", "data"])

    data = written(texts.mapInArrow(made, "set long, data binary").dropDuplicates(["set"]))
    one, two = data.toDF("a", "x"), data.toDF("b", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                met = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(met >= similarity * (len(x) + len(y) - met) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return left.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def met_in_block(sets: np.ndarray, sizes: np.ndarray, roots: np.ndarray, low: np.ndarray, block: np.ndarray, maps: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The places (i, j) of pairs of different roots whose bitmaps allow the similarity. ``low`` marks the sets of the lower
    size, one of which a pair has at least; a pair is of both blocks, if there are two."""
    length = np.array([len(m) for m in maps])
    table: dict[int, np.ndarray] = {}  # by length in bytes its bitmaps, and longer ones folded to it
    for size in np.unique(length):
        rows = np.zeros((len(maps), size // 8), np.uint64)
        for k, m in enumerate(maps):
            if len(m) >= size:
                rows[k] = np.bitwise_xor.reduce(np.frombuffer(m, np.uint64).reshape(-1, size // 8), axis=0)
        table[int(size)] = rows
    out = []
    two = block.min() != block.max()
    for size, rows in table.items():
        mine, longer = np.flatnonzero(length == size), np.flatnonzero(length >= size)
        step = max(1, (1 << 22) // (len(longer) * size))
        for at in range(0, len(mine), step):
            i, j = mine[at : at + step, None], longer[None, :]
            n = sizes[i] + sizes[j]
            fit = (roots[i] != roots[j]) & (low[i] | low[j]) & ((length[j] > size) | (i < j))
            fit &= np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - 1e-9
            if two:
                fit &= block[i] != block[j]
            x, y = np.nonzero(fit)
            if len(x):
                a, b = mine[at : at + step][x], longer[y]
                apart = np.bitwise_count(rows[a] ^ rows[b]).sum(1)
                ok = apart <= (1 - similarity) / (1 + similarity) * n[x, y] + 1e-9
                out.append((a[ok], b[ok]))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


def unlike(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: sets of different roots that share a shingle and that their bitmaps allow to be similar. ``members`` has
    (shingle, set, n, root)."""
    step = -math.log(similarity) * (1 + 1e-9)  # sizes whose ratio is the similarity are one step apart at most, rounding or not
    tasks = partitions(sets.sparkSession)
    rows = members.select("shingle", "set", "n", "root", F.floor(F.log("n") / step).cast("int").alias("class"))
    rows = rows.select("shingle", "set", "n", "root", F.explode(F.array(F.struct(F.col("class").alias("at"), F.lit(True).alias("low")), F.struct((F.col("class") - 1).alias("at"), F.lit(False).alias("low")))).alias("x"))
    rows = rows.select("shingle", "set", "n", "root", "x.at", "x.low")
    counts = rows.groupBy("shingle", "at").agg(F.count_if("low").alias("lower"), F.count("*").alias("many")).filter("lower > 0 AND many > 1")
    blocks = counts.select("shingle", "at", F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(blocks, ["shingle", "at"]).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    lists = members.groupBy("set").agg(F.collect_set("shingle").alias("open"))
    rows = rows.withColumn("pair", F.explode(pair)).join(sets.select("set", "bitmap").join(lists, "set"), "set")
    key = ["shingle", "at", "i", "j"]
    rows = rows.select("shingle", "at", "pair.i", "pair.j", "set", "n", "root", "low", "block", "bitmap", "open").repartition(tasks, *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            col = lambda c: whole.column(c).to_numpy()
            i, j = met_in_block(col("set"), col("n").astype(np.int64), col("root"), whole.column("low").to_numpy().astype(bool), col("block"), whole.column("bitmap").to_pylist(), similarity)
            met = [frozenset(x) for x in whole.column("open").to_pylist()] if len(i) else []
            here = whole.column("shingle")[0].as_py()
            first = np.array([min(met[x] & met[y]) == here for x, y in zip(i.tolist(), j.tolist())], bool)
            a, b = col("set")[i[first]], col("set")[j[first]]
            return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        last = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in key], 1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for x, y in zip(starts, starts[1:]):
                if last is not None and tuple(keys[x]) != last:
                    yield done()
                    held = []
                last = tuple(keys[x])
                held.append(batch.slice(x, y - x))
        if held:
            yield done()

    return rows.mapInArrow(run, "a long, b long")


def links(sets: DataFrame, docs: DataFrame, text_col: str, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), a < b: similar sets that join the same sets as all similar pairs. ``sets`` has a row for each set."""
    rows = sets.select(F.explode("prefix").alias("shingle"), "set", "n")
    heads = rows.groupBy("shingle").agg(F.min(F.struct("set", "n")).alias("r"), F.count("*").alias("many")).filter("many > 1").drop("many")
    met = written(rows.join(heads.hint("merge"), "shingle"))  # by the sets' file, a few MB where texts are copies, Spark would broadcast all that explode makes of it
    near = lambda x, y: F.least(x, y) >= F.lit(similarity) * F.greatest(x, y) - 1e-9
    star = met.filter((F.col("r.set") < F.col("set")) & near(F.col("r.n"), F.col("n"))).select(F.col("r.set").alias("a"), F.col("set").alias("b"))
    star = written(star.distinct())
    joined = written(similar(star, sets, docs, text_col, width, similarity))
    roots = written(components(joined))
    mine = met.select("shingle", "set", "n").join(roots.withColumnRenamed("node", "set"), "set", "left").select("shingle", "set", "n", F.coalesce("root", "set").alias("root"))
    mine = written(mine)
    met_by = [F.bit_xor(F.xxhash64("set")).alias("x"), F.bit_xor(F.xxhash64(F.col("set").bitwiseXOR(F.lit(-1)))).alias("y"), F.count("*").alias("many")]
    open_ = mine.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *met_by).filter("lo < hi AND many > 2")
    once = open_.groupBy("x", "y", "many").agg(F.min("shingle").alias("shingle")).select("shingle")  # of shingles that the same sets share, one
    rest = unlike(mine.join(once, "shingle"), sets, similarity)
    rest = written(rest.distinct().join(star, ["a", "b"], "left_anti"))
    return joined.union(written(similar(rest, sets, docs, text_col, width, similarity)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(id, set, component_id) for each row: component_id is the least id in the row's class."""
    found = written(shingle_sets(docs, id_col, text_col, width, similarity))
    sets = written(found.drop(id_col).dropDuplicates(["set"]))
    roots = written(components(links(sets, docs, text_col, width, similarity)))
    firsts = found.groupBy("set").agg(F.min(f"`{id_col}`").alias("first"))
    named = firsts.join(roots, firsts["set"] == roots["node"], "left").select("set", "first", F.coalesce("root", "set").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "root").select(F.col("set").alias("of"), "component_id")
    return found.join(classes, found["set"] == classes["of"]).select(F.col(f"`{id_col}`"), "set", "component_id")
