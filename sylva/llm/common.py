"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: U+0020 and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one task may take: a table of no more (they are counted) is iterated over without shuffles.
FEW = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where none is set, a temporary one in local mode and an error elsewhere."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="sylva-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared folder; lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/sylva-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Like checkpoint, as compressed Parquet: for wide or large tables, read more than once."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's own file system layer."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; without a source (a writer had no rows) the target is an empty folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = a.getFileSystem(conf)
    if not fs.exists(a):
        fs.mkdirs(b)
    elif not (fs.mkdirs(b.getParent()) and fs.rename(a, b)):
        raise OSError(f"cannot move {source}")


class Scratch:
    """Written tables that are removed together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, what: str) -> DataFrame:
        self.paths.append(new_path(self.spark, what))
        df.write.option("compression", "zstd").parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def close(self) -> None:
        for path in self.paths:
            drop_path(self.spark, path)


class Loop:
    """The table of an iteration, written anew at each turn; the one before it is removed.

    Plain files rather than checkpoint(): a checkpoint hands the constraints of its
    plan on, and these double with every turn.
    """

    def __init__(self, spark: SparkSession, what: str, one: bool = False):
        self.spark, self.what, self.path = spark, what, None
        self.one = one  # keep the table in one partition, for tables of FEW rows or so

    def turn(self, df: DataFrame) -> DataFrame:
        path, old = new_path(self.spark, self.what), self.path
        (df.coalesce(1) if self.one else df).write.parquet(path)
        if old:
            drop_path(self.spark, old)
        self.path = path
        out = self.spark.read.schema(df.schema).parquet(path)
        return out.coalesce(1) if self.one else out

    def close(self) -> None:
        if self.path:
            drop_path(self.spark, self.path)


def fresh(columns: list[str], name: str) -> str:
    """`name`, or a longer one that clashes with no column (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """docs but the rows whose key is in the one column of ids; columns of any name are safe."""
    gone = fresh(docs.columns, "_gone")
    ids = ids.toDF(gone)
    return docs.join(ids, F.col(f"`{key}`").eqNullSafe(F.col(gone)), "left_anti")


def crc_of_id(col: str = "doc_id") -> Column:
    """crc32 of the id written as decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def lower_az(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _stars(e: DataFrame, together=lambda d: d) -> bool:
    """Whether every node of the edges (u, v) with u > v is the least of its component or linked to nothing but that."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    seen = together(ends).groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("c"))
    return seen.where("ups > 1 or (ups = 1 and c > 1)").count() == 0


def components(edges: DataFrame, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (node, root), root the smallest
    node reachable.  Nodes without an edge do not appear.

    Alternating large-star and small-star steps (Kiveris et al. 2014).  Every step
    is a grouped minimum with map-side combine and a join; no group is collected.
    The minima are written first, so that the join deals both sides anew and a
    node with very many neighbours can be split among tasks.  It ends as soon as the
    edges are stars, which one grouped count tells.  At most `few` edges make one
    partition, so that the same steps need no exchange; no step makes more edges.
    """
    loop, large_loop, minima = (Loop(edges.sparkSession, f"stars-{k}") for k in ("edges", "large", "minima"))
    e = loop.turn(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    one = e.count() <= few
    together = (lambda d: d.coalesce(1)) if one else (lambda d: d)
    for each in (loop, large_loop, minima):
        each.one = one
    e = together(e)
    for _ in range(max_rounds):
        if _stars(e, together):
            break
        # large star: link each larger neighbour to the least of the neighbourhood
        sym = together(e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = minima.turn(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # no more rows than edges, so copies may stay until the end of the turn
        large = large_loop.turn(sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        # small star: link smaller neighbours and the node itself to the least
        low = minima.turn(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = loop.turn(together(small).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    else:
        raise RuntimeError("components did not settle")
    large_loop.close()
    minima.close()
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def named_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component_id) of nodes (id, least: the smallest document of the node, or null) under links (a, b) of ids.

    component_id is the smallest `least` reachable.  Where every node has a `least`
    of its own, that is the node's name in the components, so nothing is grouped by
    component; otherwise names are grouped by root and written, so that the join
    can split a large component among tasks.
    """
    n, own = nodes.agg(F.count("*"), F.count_distinct("least")).first()
    if n == own:
        side = lambda c: nodes.select(F.col("id").alias(c), F.col("least").alias(f"_{c}"))
        roots = components(links.join(side("a"), "a").join(side("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
        return nodes.join(roots, nodes["least"] == roots["node"], "left").select("id", F.coalesce("root", "least").alias("component_id"))
    roots = components(links)
    member = nodes.join(roots, nodes["id"] == roots["node"], "left").select("id", "least", "root")
    names = checkpoint(member.where("root is not null").groupBy("root").agg(F.min("least").alias("_name")))
    member = member.join(names, "root", "left")
    return member.select("id", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("_name")).alias("component_id"))
