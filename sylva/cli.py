"""Command line: get, query, test and edits on one file, standard input (-) or a folder of files.

    python -m sylva.cli query FOLDER --query '$..name'
    python -m sylva.cli replace FILE --pointer /a --value 1 --in-place

Exit codes: 0 done, 1 something failed or a test did not hold, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values
from .operators import command, edit
from .plans import jsonpath
from .sources import files

EDITS = command.EDITS


class Usage(Exception):
    pass


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sylva")
    p.add_argument("command", choices=["get", "query", "test", *EDITS])
    p.add_argument("target", nargs="?", default=".")
    for name in ("pointer", "query", "from", "value", "value-file", "patch", "patch-file", "output"):
        p.add_argument(f"--{name}")
    p.add_argument("--doc", type=int)
    p.add_argument("--in-place", action="store_true")
    return p


def _given(text: str | None, path: str | None, stdin) -> str | None:
    if text is not None and path is not None:
        raise Usage("give a text or a file, not both")
    if path == "-":
        return stdin.read()
    if path is not None:
        with open(path, encoding="utf-8", newline="") as f:
            return f.read()
    return text


def _ops(a: argparse.Namespace, stdin) -> list[dict]:
    if a.command == "patch":
        text = _given(a.patch, a.patch_file, stdin)
        if text is None:
            raise Usage("patch needs --patch or --patch-file")
        return edit.read_patch(text)
    o = {"op": a.command, "path": a.pointer}
    if a.command in ("add", "replace", "rename-key", "set"):
        o["value"] = _given(a.value, a.value_file, stdin)
        if o["value"] is None:
            raise Usage(f"{a.command} needs --value")
    if a.command in ("move", "copy"):
        o["from"] = getattr(a, "from")
        if o["from"] is None:
            raise Usage(f"{a.command} needs --from")
    if a.pointer is None and a.query is None:
        raise Usage("give --pointer or --query")
    return [o]


def _edit(a: argparse.Namespace, texts: DataFrame, ops: list[dict]) -> DataFrame:
    """(path, ok, text, error)"""
    value = ops[0].get("value") if a.query is not None else None
    r = command.executed(F.col("text"), command=a.command, query=a.query, value=value, ops=None if a.query is not None else ops, doc=a.doc)
    got = texts.where("error is null").withColumn("r", r).select("path", "r.ok", "r.text", "r.error")
    return got.unionByName(texts.where("error is not null").select("path", F.lit(False).alias("ok"), "text", "error"))


def _read(a: argparse.Namespace, texts: DataFrame, value: str | None) -> DataFrame:
    """(path, ok, text, error): what get, query or test finds in each text; null or empty text where nothing matches."""
    r = command.executed(F.col("text"), command=a.command, pointer=a.pointer, query=a.query, value=value, doc=a.doc)
    got = texts.where("error is null").withColumn("r", r).select("path", "r.ok", F.col("r.output").alias("text"), "r.error")
    return got.unionByName(texts.where("error is not null").select("path", F.lit(False).alias("ok"), F.lit(None).cast("string").alias("text"), "error"))


def run(args: list[str], stdin=sys.stdin, stdout=sys.stdout, stderr=sys.stderr, spark: SparkSession | None = None) -> int:
    try:
        a = _parser().parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        batch = os.path.isdir(a.target)
        ops = _ops(a, stdin) if a.command in EDITS else []
        value = _given(a.value, a.value_file, stdin) if a.command == "test" else None
        if a.command in ("get", "test") and a.pointer is None and a.query is None or a.command == "query" and a.query is None or a.command == "test" and value is None:
            raise Usage(f"{a.command} lacks an argument")
        if a.query is not None:
            jsonpath.parse(a.query)
            if a.command in EDITS and a.command not in ("remove", "replace", "rename-key", "set"):
                raise Usage(f"{a.command} takes no --query")
        if a.pointer is not None:
            edit.tokens(a.pointer)
        if value is not None:
            values.one(value)
        if a.output and (batch or os.path.exists(a.output) and a.target != "-" and os.path.samefile(a.output, a.target)):
            raise Usage("--output must be another file, and takes one target")
        if a.in_place and a.target == "-":
            raise Usage("standard input cannot be replaced")
    except (Usage, OSError, ValueError) as e:
        print(f"sylva: {e}", file=stderr)
        return 2
    spark = spark or SparkSession.builder.appName("sylva").getOrCreate()
    if a.target == "-":
        texts = spark.createDataFrame([("-", stdin.read(), None)], "path string, text string, error string")
    else:
        root = a.target if batch else os.path.dirname(a.target) or "."
        paths = files.listed(root) if batch else [os.path.basename(a.target)]
        if not paths:
            print("sylva: no files", file=stderr)
            return 1
        texts = files.read_listed(spark, os.path.abspath(root), paths)
    got = (_edit(a, texts, ops) if a.command in EDITS else _read(a, texts, value)).persist()
    if a.in_place and a.command in EDITS:
        files.replace_listed(got.where("ok"), os.path.abspath(root))
    done = failed = shown = 0
    for r in got.orderBy("path").toLocalIterator():
        done, failed = done + r.ok, failed + (not r.ok)
        if not r.ok:
            print(f"{r.path}: {r.error}", file=stderr)
        elif r.text and not a.in_place:
            body = r.text if r.text.endswith("\n") or a.command in EDITS else r.text + "\n"
            if a.output:
                with open(a.output, "w", encoding="utf-8", newline="") as f:
                    f.write(body)
            else:
                stdout.write((("\n" if shown else "") + f"==> {r.path} <==\n" if batch else "") + body)
            shown += 1
    if batch:
        print(f"{done} files done, {failed} failed", file=stderr)
    got.unpersist()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
