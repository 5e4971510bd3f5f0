"""Sharding by proportional stratified interleaving (law `rows`).

Rows of each source are put in a seeded order and get the fractional rank
(rank - 1 + u) / n, where u in [0, 1) is fixed by the source (so that many
small sources spread evenly).  Sorted by fractional rank, the sources
interleave in proportion everywhere; cutting that order into equal counts
makes every shard match the mixture within about one row a source.

No rank is taken in one task: ranks within a source are counted over slices of
the seeded hash, positions over slices of the fractional rank.  Both slice
keys are even by construction, a hot source included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table, written

SEED = 20240607
SHARDS = 40
ROWS_PER_SLICE = 50_000


def _unit(*cols: Column) -> Column:
    """Uniform in [0, 1) with 52 bits, from a 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 12) / F.lit(float(1 << 52))


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard, source.

    A null source is a source of its own; null text has size 16 and the checksum
    of no bytes; repeated rows tie on every sort key and are interchangeable; an
    empty table gives no rows.  Other columns are not read.  Shard counts differ
    by one at most, and fewer rows than shards leave the last shards empty.
    """
    slim = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        _unit(F.lit(seed), F.col(key)).alias("h"),
    )
    slim = written(slim, "shard-rows")
    total = slim.count()
    slices = max(1, -(-total // ROWS_PER_SLICE), int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    rows = slim.withColumn("b", F.floor(F.col("h") * slices).cast("int"))
    # offsets of every (source, slice): a table of counts, not of rows
    w = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    n = rows.groupBy("source", "b").agg(F.count("*").alias("c"))
    n = n.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy("source")))
    n = n.select(F.col("source").alias("s2"), F.col("b").alias("b2"), "before", "n")
    in_slice = Window.partitionBy("source", "b").orderBy("h", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("r", F.row_number().over(in_slice))
    rows = rows.join(n, rows.source.eqNullSafe(n.s2) & (rows.b == n.b2))
    frac = (F.col("before") + F.col("r") - 1 + _unit(F.lit(seed + 1), F.col("source"))) / F.col("n")
    rows = rows.select("doc_id", "source", "size", "text_crc32", "h", frac.alias("f"))
    rows = written(rows.withColumn("q", F.least(F.floor(F.col("f") * slices), F.lit(slices - 1)).cast("int")), "shard-ranks")
    # positions over all rows: fractional ranks fill each slice alike
    m = rows.groupBy("q").agg(F.count("*").alias("c")).withColumn("k", F.floor(F.col("q") / 4096))
    blocks = m.groupBy("k").agg(F.sum("c").alias("kc")).withColumn("k0", F.coalesce(F.sum("kc").over(Window.partitionBy(F.lit(0)).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    m = m.join(blocks, "k").withColumn("p0", F.col("k0") + F.coalesce(F.sum("c").over(Window.partitionBy("k").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = Window.partitionBy("q").orderBy("f", "source", "h", "doc_id", "text_crc32", "size")
    pos = rows.withColumn("r", F.row_number().over(order)).join(m.select("q", "p0"), "q").withColumn("pos", F.col("p0") + F.col("r") - 1)
    # shard s holds positions ceil(s*total/shards) .. ceil((s+1)*total/shards) - 1
    shard = F.expr(f"(pos * {shards}) div {max(total, 1)}")
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        pos.withColumn("shard", shard)
        .withColumn("slot", F.col("pos") - start)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text", **kw) -> str:
    """Write whole documents as one folder per shard, in slot order within files; returns the name of the folder column.

    The column is `shard`, or a longer name where docs has one of that name.  A null
    key is a key; rows that repeat key and text take its places one each; an empty
    table writes no shard.
    """
    col = fresh(docs.columns, "shard")
    place = assign_shards(docs, shards, key=key, text=text, **kw).select(F.col("doc_id").alias("_k"), F.col("text_crc32").alias("_c"), F.col("size").alias("_z"), F.col("shard").alias("_s"), F.col("slot").alias("_t"))
    turn = lambda k, c, z: F.row_number().over(Window.partitionBy(k, c, z).orderBy(F.lit(0)))
    place = place.withColumn("_n", turn("_k", "_c", "_z"))
    body = F.col(f"`{text}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("k"), F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("c"), (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 16).alias("z"))
    rows = rows.withColumn("n", turn("k", "c", "z"))
    out = rows.join(place, F.col("k").eqNullSafe(F.col("_k")) & (F.col("c") == F.col("_c")) & (F.col("z") == F.col("_z")) & (F.col("n") == F.col("_n")))
    out = out.repartition("_s", F.floor(F.col("_t") / ROWS_PER_SLICE)).sortWithinPartitions("_s", "_t")
    out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("_s").alias(col)).write.partitionBy(col).parquet(path)
    return col


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
