"""Typed reads: a StructType bound to documents, and merge keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def read_fields(nodes: DataFrame, fields: T.StructType, pointer: str = "") -> DataFrame:
    """(doc_key, doc_ix, the fields): scalar members of the mapping at `pointer`, by name, one aggregate a document.

    Quoted scalars read as numbers and booleans too; YAML null and a missing key
    are null; a value that does not fit its type is null (try_cast).
    """
    at = nodes.where(F.col("pointer").isin([f"{pointer}/{f.name.replace('~', '~0').replace('/', '~1')}" for f in fields])) if len(fields) else nodes.limit(0)
    value = F.when(F.col("kind") == "null", F.lit(None)).when(F.col("kind").isin("seq", "map"), F.col("json")).otherwise(F.col("text"))
    out = []
    for f in fields:
        v = F.max(F.when(F.col("key") == f.name, value))
        out.append((v if isinstance(f.dataType, T.StringType) else v.try_cast(f.dataType) if isinstance(f.dataType, _PLAIN) else F.from_json(v, f.dataType)).alias(f.name))
    return at.groupBy("doc_key", "doc_ix").agg(*out)


def merged_members(nodes: DataFrame, pointer: str) -> DataFrame:
    """(doc_key, doc_ix, key, json): members of the mapping at `pointer` with its merge key applied.

    Explicit members beat merged ones, an earlier merge source beats a later one.
    """
    deep = nodes.where(F.col("pointer").startswith(pointer + "/") & F.col("key").isNotNull() & (F.col("key") != "<<"))
    rest = F.substring("pointer", len(pointer) + 1, 1 << 30)
    place = F.when(rest.rlike("^/[^/]+$"), F.lit(-1)).when(rest.rlike("^/<</[^/]+$") & ~rest.rlike("^/<</[0-9]+$"), F.lit(0)).when(rest.rlike("^/<</[0-9]+/[^/]+$"), F.regexp_extract(rest, "^/<</([0-9]+)/", 1).try_cast("int") + 1)
    got = deep.withColumn("place", place).where("place is not null")
    return got.groupBy("doc_key", "doc_ix", "key").agg(F.min_by("json", "place").alias("json"))
