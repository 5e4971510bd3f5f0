"""Reading and writing collections of document texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions in any case, at any depth.
YAML_FILES = "*.{[yY][aA][mM][lL],[yY][mM][lL]}"


def read_texts(spark: SparkSession, *paths: str, glob: str = YAML_FILES) -> DataFrame:
    """(path, text): whole files below the paths, line ends kept."""
    files = spark.read.text(list(paths), wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, *paths: str, glob: str = YAML_FILES) -> DataFrame:
    """(path, content, text): bytes as well, for texts that may not be UTF-8 (text is then null)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(list(paths))
    return files.select("path", "content", F.when(F.is_valid_utf8(F.decode("content", "UTF-8")), F.decode("content", "UTF-8")).alias("text"))


def write_texts(texts: DataFrame, path: str, key: str = "doc_key", text: str = "text") -> None:
    """Edited texts as Parquet, committed by Spark's own protocol: readers see all of them or none."""
    texts.select(F.col(key), F.col(text)).write.mode("overwrite").parquet(path)


def sections(matches: DataFrame, path: str = "doc_key", body: str = "json") -> DataFrame:
    """One section a file, in path order: (path, body) with its matches in nodelist order."""
    got = matches.groupBy(F.col(path).alias("path")).agg(F.array_sort(F.collect_list(F.struct("doc_ix", "rank", F.col(body).alias("body")))).alias("m"))
    return got.select("path", F.array_join(F.transform("m", lambda x: x["body"]), "\n").alias("body")).orderBy("path")


def json_line(value: Column) -> Column:
    return F.to_json(value)
