"""Directories of document files on a path all executors share: listing, strict reading, atomic replacing."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ENDINGS = (".yaml", ".yml")


def listed(root: str) -> list[str]:
    """Relative paths of the document files below a folder, hidden ones too, in order; links are not followed."""
    out = []
    for at, _, names in os.walk(root):
        out += [os.path.relpath(os.path.join(at, n), root) for n in names if n.lower().endswith(ENDINGS) and not os.path.islink(os.path.join(at, n))]
    return sorted(out)


def read_listed(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(path, text, error): whole files as they are; one that is missing or not UTF-8 has an error instead of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 64) for b in batches for lo in range(0, b.num_rows, 64)):
            rows = []
            for p in batch.column(0).to_pylist():
                try:
                    with open(os.path.join(root, p), "rb") as f:
                        rows.append((p, f.read().decode("utf-8"), None))
                except (OSError, UnicodeDecodeError) as e:
                    rows.append((p, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["path", "text", "error"])

    n = max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(n).mapInArrow(run, "path string, text string, error string")


def replace_file(path: str, text: str) -> None:
    """Readers see the old file or the new one; permissions stay; a link is refused."""
    if os.path.islink(path):
        raise OSError(f"{path} is a link")
    mode = os.stat(path).st_mode & 0o7777
    fd, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".write-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(text.encode())
            f.flush()
            os.fsync(f.fileno())
        os.chmod(name, mode)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def replace_listed(texts: DataFrame, root: str, path: str = "path", text: str = "text") -> None:
    """Every row's file replaced where the row is; a task that runs twice writes the same bytes again."""

    def run(rows) -> None:
        for r in rows:
            replace_file(os.path.join(root, r[0]), r[1])

    texts.select(path, text).foreachPartition(run)
