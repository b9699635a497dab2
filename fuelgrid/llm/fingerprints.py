"""Document fingerprints: canonical exact digests, grouped, with the bytes compared inside equal buckets.

A text's canonical form is its Unicode compatibility composition (NFKC), case-folded, composed again, with runs of
white space folded to one space and none at the ends. Its digest is 128 bits wide: two xxHash64 values of different
seeds. Rows of equal digests form a bucket, and :func:`collisions` compares the very bytes of a bucket's texts, so that
a fingerprint stands for one canonical text even where two texts share a digest. The likeness of two exact
fingerprints is 1 if they are equal, and 0 if not: an exact digest has nothing in between.

All is DataFrame functions. Texts travel in one shuffle by blocks of neighbouring ids (:func:`with_next`), and a bucket
of copies, however large, is reduced to its least and greatest text in each task before anything of it is shuffled.

Cases: a null text counts as empty. Null ids come first in the order of ids. Rows that repeat an id are ordered by
their texts. Equal rows have equal results. A single row is its own next. An empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, partitions, written

WHITE = r"(?U)\s+"
#: The buckets with two rows or more are broadcast up to this many (16 bytes each).
BROADCAST_BUCKETS = 500_000
_ICU = "com.ibm.icu.text.Normalizer"


def _composed(text: Column) -> Column:
    return F.reflect(F.lit(_ICU), F.lit("compose"), text, F.lit(True))


def canonical(text: Column) -> Column:
    """NFKC, case-folded, NFKC again, white space folded. Texts of ASCII alone are spared the normalizer."""
    text = F.coalesce(text, F.lit(""))
    # by way of capitals, as ß and ss are one; without a step between, the optimizer takes lower(upper(x)) for lower(x)
    folded = lambda c: F.lower(F.replace(F.upper(c), F.lit("ẞ"), F.lit("SS")))
    plain = F.octet_length(text) == F.length(text)
    return F.btrim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(_composed(folded(_composed(text)))), WHITE, " "))


def wide_hash(text: Column, bits: int = 64) -> list[Column]:
    """The two halves of a digest; ``bits`` under 64 narrows them, for tests of collisions."""
    keep = lambda h: h if bits == 64 else h.bitwiseAND(F.lit((1 << bits) - 1))
    return [keep(F.xxhash64(text)), keep(F.xxhash64(F.lit("second"), text))]


def digest(h1: Column, h2: Column) -> Column:
    """32 lowercase hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def with_next(docs: DataFrame, columns: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, columns, next_text, next_<column>) for each row; next is the row of the next id, after the last the first.

    Ids are cut into blocks at quantiles. A block's first row is sent to the block before it as well, so that one
    shuffle brings every row together with its next one and no task holds more than its block.
    """
    spark = docs.sparkSession
    rows = only(docs, id_col, text_col)
    n = 4 * partitions(spark)
    ids = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"))
    cuts = ids.agg(F.percentile_approx("id", F.lit([(k + 1) / n for k in range(n - 1)]), F.lit(10_000))).first()[0]
    cuts = sorted(set(cuts or []))
    step = max(1, round(len(cuts) ** 0.5))
    parts = [cuts[k : k + step] for k in range(0, len(cuts), step)]  # two short searches in place of one long one
    block = F.lit(0)
    if cuts:
        listed = lambda x: F.array(*[F.lit(c).cast("long") for c in x])
        below = lambda those: F.size(F.filter(those, lambda c: c <= F.col("id")))
        part = F.greatest(below(listed([p[0] for p in parts])) - 1, F.lit(0))
        block = F.coalesce(part * step + below(F.get(F.array(*[listed(p) for p in parts]), part)), F.lit(0))
    firsts = {r["block"]: (None if r["nulls"] else r["least"]) for r in ids.withColumn("block", block).groupBy("block").agg(F.min("id").alias("least"), F.count_if(F.col("id").isNull()).alias("nulls")).collect()}  # a row for each block
    filled = sorted(firsts)
    before = {b: filled[k - 1] for k, b in enumerate(filled)}
    size = (filled[-1] if filled else 0) + 1
    first = F.get(F.array(*[F.lit(firsts.get(b)).cast("long") for b in range(size)]), F.col("block"))
    home = F.struct(F.col("block").alias("block"), F.lit(0).alias("extra"))
    # extra: 1 for a block's successor; 2 where the order starts anew
    prior = F.struct(F.get(F.array(*[F.lit(before.get(b, 0)) for b in range(size)]), F.col("block")).alias("block"), F.when(F.col("block") == (filled[0] if filled else 0), 2).otherwise(1).alias("extra"))
    df = rows.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    df = df.withColumns(columns).withColumn("block", block)
    df = df.withColumn("at", F.explode(F.when(F.col("id").eqNullSafe(first), F.array(home, prior)).otherwise(F.array(home))))
    order = Window.partitionBy("at.block").orderBy("at.extra", F.col("id").asc_nulls_first(), "text")
    names = ["text", *columns]
    df = df.withColumns({f"next_{c}": F.lead(c).over(order) for c in names})
    return df.filter("at.extra = 0").select(F.col("key").alias(id_col), *names, *[f"next_{c}" for c in names])


def collisions(docs: DataFrame, text_col: str = "text", bits: int = 64) -> DataFrame:
    """(h1, h2, canon, nth): the canonical texts of the buckets that hold two or more different ones, numbered.

    Empty unless digests collide. Only buckets of two rows or more are compared, by their least and greatest text.
    """
    rows = only(docs, text_col).select(canonical(F.col(f"`{text_col}`")).alias("canon"))
    h1, h2 = wide_hash(F.col("canon"), bits)
    rows = rows.select("canon", h1.alias("h1"), h2.alias("h2"))
    shared = written(rows.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2"))
    compared = rows
    if shared.count() <= BROADCAST_BUCKETS:
        compared = rows.join(F.broadcast(shared), ["h1", "h2"], "left_semi")
    mixed = compared.groupBy("h1", "h2").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).filter("lo != hi")
    mixed = written(mixed.select("h1", "h2"))
    if mixed.isEmpty():
        return mixed.select("h1", "h2", F.lit("").alias("canon"), F.lit(0).alias("nth"))
    texts = rows.join(mixed, ["h1", "h2"], "left_semi").distinct()
    return written(texts.withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("canon")) - 1))


def named(df: DataFrame, clashes: DataFrame | None, canon: str, out: str, bits: int = 64) -> DataFrame:
    """``df`` with the fingerprint of the canonical text in column ``canon`` as column ``out``."""
    h1, h2 = wide_hash(F.col(canon), bits)
    if clashes is None:
        return df.withColumn(out, digest(h1, h2))
    c = clashes.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("canon").alias("_canon"), F.col("nth").alias("_nth"))
    met = df.join(c, (h1 == c["_h1"]) & (h2 == c["_h2"]) & (F.col(canon) == c["_canon"]), "left")
    tail = F.when(F.col("_nth") > 0, F.concat(F.lit("-"), F.col("_nth").cast("string"))).otherwise("")
    return met.withColumn(out, F.concat(digest(h1, h2), tail)).drop("_h1", "_h2", "_canon", "_nth")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(id, fingerprint, group_id, group_size): group_id is the least id of the rows with the same canonical text."""
    clashes = collisions(docs, text_col, bits)
    rows = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias(id_col), canonical(F.col(f"`{text_col}`")).alias("canon"))
    prints = written(named(rows, None if clashes.isEmpty() else clashes, "canon", "fingerprint", bits).select(id_col, "fingerprint"))
    groups = prints.groupBy("fingerprint").agg(F.min(id_col).alias("group_id"), F.count("*").alias("group_size"))
    return prints.join(groups, "fingerprint").select(id_col, "fingerprint", "group_id", "group_size")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """Each row's fingerprint beside those of its edited text (its last quarter replaced from the next row's start) and
    of the next row."""
    clashes = collisions(docs, text_col, bits)
    clashes = None if clashes.isEmpty() else clashes
    h1, h2 = wide_hash(canonical(F.col("text")), bits)
    df = with_next(docs, {"print": digest(h1, h2)} if clashes is None else {"canon": canonical(F.col("text"))}, id_col, text_col)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    changed = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    df = df.withColumns({"n_chars": n.cast("long"), "changed": changed})
    if clashes is None:
        df = df.withColumnsRenamed({"print": "fingerprint", "next_print": "next_fingerprint"})
    else:
        df = named(named(df, clashes, "canon", "fingerprint", bits), clashes, "next_canon", "next_fingerprint", bits)
    df = df.withColumns({"edited_sha256": F.sha2(F.col("changed").cast("binary"), 256), "changed": canonical(F.col("changed"))})
    df = named(df, clashes, "changed", "edited_fingerprint", bits)
    like = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return df.select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
