"""Conformance tables: every case's category, and their histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.yaml import YamlError
from . import events


def category(text: str | None, want: str | None, invalid: bool | None) -> str:
    """passed, accepted (an invalid text that was read), refused (a valid one that was not) or differs (in its events)."""
    try:
        got = events.event_text(text or "")
    except (YamlError, RecursionError):
        return "passed" if invalid else "refused"
    return "accepted" if invalid else "passed" if want is None or got == want else "differs"


def conformance(cases: DataFrame, key: str, text: str, want: str, invalid: str) -> DataFrame:
    """(doc_key, category) of every case; `want` holds event notation or null."""
    run = F.udf(category, "string", useArrow=True)
    return cases.select(F.col(key).alias("doc_key"), run(F.col(text), F.col(want), F.col(invalid)).alias("category"))


def histogram(cases: DataFrame) -> DataFrame:
    return cases.groupBy("category").agg(F.count("*").alias("n"))
