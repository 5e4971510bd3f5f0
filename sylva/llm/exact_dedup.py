"""Exact dedup through two-pass Bloom filtering, in DataFrame functions only.

Pass 1 counts blocked-Bloom cells (word, two-bit mask) of every text hash; a
cell met twice may hold a repeated hash.  Its shuffle carries one slim row (a
word number, a mask, a count) a distinct cell and no text; that is what knowing
repeated hashes costs, and the only thing that shuffles for rows that are unique.
The cells met twice are folded into a bit table of 64-bit words.  Pass 2 tests
every row: a miss proves the text unique and the row passes straight through; only
hits shuffle.  A fuller table means more hits, never a lost copy.

The table has a word for every four rows, MOST_WORDS at most: its size is checked,
so it is broadcast.  Beyond it the table fills up, and above MOST_ROWS rows the
cells met twice are not folded but joined (no broadcast, no false hit by a full
table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, checkpoint, table

#: 64-bit words of the bit table at most: 2^20 rows of 16 bytes, 16 MB.
MOST_WORDS = 1 << 20
#: Rows for which a table of MOST_WORDS still tells most unique rows apart.
MOST_ROWS = 1 << 26
#: Cells are counted over this many words, whatever the table's size: few cells meet by chance.
_SPREAD = 1 << 40


def table_words(rows: int, most: int = MOST_WORDS) -> int:
    """Words for about 16 bits a row, a power of two, `most` at most."""
    return min(most, 1 << max(6, (max(rows, 1) // 4).bit_length()))


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), BLANK, " ")


def _cells(df: DataFrame, words: int, col: str) -> DataFrame:
    """Word number and a mask of two of 64 bits, from a 64-bit hash of the column."""
    bit = lambda s: F.expr(f"shiftleft(1L, cast(shiftright(_h, {s}) & 63 as int))")
    return df.withColumn("_h", F.xxhash64(F.lit(5), col)).withColumn("_w", F.pmod("_h", F.lit(words))).withColumn("_m", bit(44).bitwiseOR(bit(53))).drop("_h")


def bits_of(keys: DataFrame, words: int, col: str) -> DataFrame:
    """The bit table (_w, _bits) of all keys, at most `words` rows."""
    return checkpoint(_cells(keys.select(col), words, col).groupBy("_w").agg(F.bit_or("_m").alias("_bits")))


def repeated_bits(hashed: DataFrame, words: int, col: str = "text_sha256") -> DataFrame:
    """Pass 1: the bit table (_w, _bits) of the cells met twice, at most `words` rows.

    Cells are counted over _SPREAD words; a word's number in the table is the
    remainder of that number, so `tested` finds it again.
    """
    twice = _cells(hashed.select(col), _SPREAD, col).groupBy("_w", "_m").agg(F.count("*").alias("n")).where("n > 1")
    return checkpoint(twice.groupBy(F.pmod("_w", F.lit(words)).alias("_w")).agg(F.bit_or("_m").alias("_bits")))


def tested(rows: DataFrame, bits: DataFrame, words: int, col: str = "text_sha256") -> DataFrame:
    """Pass 2: rows plus _maybe, which is false only if the table cannot hold the row's hash.  `words` bounds the broadcast."""
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_m")) == F.col("_m"), F.lit(False))
    return _cells(rows, words, col).join(F.broadcast(bits), "_w", "left").withColumn("_maybe", hit).drop("_w", "_m", "_bits")


class Repeats:
    """Which rows of a slim table may hold a repeated hash."""

    def __init__(self, slim: DataFrame, words: int | None = None, most_rows: int = MOST_ROWS, col: str = "text_sha256"):
        self.col, n = col, slim.count()
        self.words = words or table_words(n)
        if n <= most_rows:
            self.bits = repeated_bits(slim, self.words, col)
        else:
            self.bits = None
            self.cells = checkpoint(_cells(slim.select(col), _SPREAD, col).groupBy("_w", "_m").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_w").alias("_w2"), F.col("_m").alias("_m2")))

    def mark(self, rows: DataFrame) -> DataFrame:
        """rows plus _maybe."""
        if self.bits is not None:
            return tested(rows, self.bits, self.words, self.col)
        on = (F.col("_w") == F.col("_w2")) & (F.col("_m") == F.col("_m2"))
        return _cells(rows, _SPREAD, self.col).join(self.cells, on, "left").withColumn("_maybe", F.col("_w2").isNotNull()).drop("_w", "_m", "_w2", "_m2")


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """Every row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, so null and blank-free empty texts form one group.
    Rows that repeat a key within a group are all marked kept if the key is the
    smallest; a null key sorts after all others.  An empty table gives no rows.
    """
    slim = checkpoint(docs.select(F.col(f"`{key}`").alias("doc_id"), F.sha2(normalised(text).cast("binary"), 256).alias("text_sha256")))
    rows = Repeats(slim, words, most_rows).mark(slim)
    once = rows.where("not _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    hits = rows.where("_maybe").select("doc_id", "text_sha256")
    # written, so that the join below deals both sides anew and a hot group can be split
    groups = checkpoint(hits.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    many = hits.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return once.unionByName(many)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of docs that stay, with their own columns, one per distinct text.

    Rows with a possibly repeated hash shuffle by (hash, key), so no group of
    copies meets in one task.  Of rows with the same text and key the one stays
    whose other columns hash least (rows equal in all columns are interchangeable).
    Clashing column names are safe: helper columns live beside a struct of the row.
    """
    cols = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(f"`{key}`").alias("_key"), F.sha2(normalised(text).cast("binary"), 256).alias("text_sha256"))
    slim = checkpoint(whole.select("_key", "text_sha256"))
    repeats = Repeats(slim, words, most_rows)
    keep = repeats.mark(slim).where("_maybe").groupBy("text_sha256").agg(F.min("_key").alias("_keep")).withColumnRenamed("text_sha256", "_sha")
    rows = repeats.mark(whole)
    hits = rows.where("_maybe").join(keep, (F.col("text_sha256") == F.col("_sha")) & F.col("_key").eqNullSafe(F.col("_keep")))
    # ties are few: rows that repeat a document
    hits = hits.select("row", "text_sha256", "_key", F.xxhash64(F.to_json("row", {"ignoreNullFields": "false"})).alias("_tie"))
    hits = hits.groupBy("text_sha256", "_key").agg(F.min_by("row", "_tie").alias("row"))
    out = rows.where("not _maybe").select("row").unionByName(hits.select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in cols])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
