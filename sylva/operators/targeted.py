"""Edits and tests at the places a JSONPath query finds, each text by itself: no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import jsonpath
from . import command, edit


def edit_matches(texts: DataFrame, key: str, text: str, path: str, op: str, value: str | None = None, ix: int = 0) -> DataFrame:
    """(doc_key, n_targets, ok, text, error): remove, replace or rename-key at each match of `path`.

    One row a text, unmatched and unparsable ones too (unchanged; the latter with
    the error).  An entry that is reached by several aliases is edited once.
    """
    if op not in ("remove", "replace", "rename-key"):
        raise edit.EditError(f"{op!r} does not work on matches")
    jsonpath.parse(path)
    got = texts.select(F.col(key).alias("doc_key"), F.col(text).alias("_text"), command.executed(F.col(text), command=op, query=path, value=value, doc=ix).alias("_r"))
    missed = F.col("_r.error") == "no match"
    return got.select("doc_key", F.coalesce(F.size("_r.pointers"), F.lit(0)).alias("n_targets"), (F.col("_r.ok") | missed).alias("ok"), F.when(F.col("_r.ok"), F.col("_r.text")).otherwise(F.col("_text")).alias("text"), F.when(~missed, F.col("_r.error")).alias("error"))


def test_matches(texts: DataFrame, key: str, text: str, path: str, value: str) -> DataFrame:
    """(doc_key, n, equal): whether every match equals `value`; a text without matches, or one that does not parse, has no row."""
    got = texts.select(F.col(key).alias("doc_key"), command.executed(F.col(text), command="test", query=path, value=value).alias("_r"))
    return got.where("size(_r.pointers) > 0").select("doc_key", F.size("_r.pointers").cast("long").alias("n"), F.col("_r.ok").alias("equal"))
