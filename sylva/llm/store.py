"""Content-addressed store of token ids.

Layout below one folder (all Parquet):

- chunks/    hash binary (SHA-256 of payload), n int, payload binary (ids,
             little-endian unsigned, `width` bytes each); one row per distinct chunk
- recipes/   one row per document in ascending doc_id order: doc_id, row
             (file part << 33 | place), n_tokens, sizes array<int>, hashes array<binary>
- manifest/  Merkle tree over the recipes: level, idx, hash; fan-out 1024, the
             one node of the highest level is the root

A rolling hash of the last 4 ids cuts streams, so equal passages give equal
chunks wherever they start.  Chunks whose hash cannot repeat (two-pass bit
table) go straight to the store; only the others shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_path, move_path, new_path, table
from .exact_dedup import Repeats
from .tok import encoder

END_ID = 2
WINDOW, MEAN, LEAST, MOST = 4, 1024, 256, 8192
FAN = 1024


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream: content-defined, LEAST to MOST ids each but the last."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    v = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(n, np.uint64)
    for _ in range(WINDOW):
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h[WINDOW - 1 :] += v[: n - WINDOW + 1] if _ == 0 else v[_ : n - WINDOW + 1 + _]
    ends, last = [], 0
    for e in (np.flatnonzero((h >> np.uint64(40)) & np.uint64(MEAN - 1) == 0) + 1).tolist():
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST and e >= WINDOW:
            ends.append(e)
            last = e
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return ends if last == n else [*ends, n]


def encoded(docs: DataFrame, tokenizer: str | None, end_id: int, width: int, key: str, text: str) -> DataFrame:
    end, kind = np.asarray([end_id], dtype="<u4").tobytes(), f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):  # small output batches: payloads are large
                part = batch.slice(lo, 256)
                n, sizes, hashes, payloads = [], [], [], []
                for raw in enc.many(part.column(1).to_pylist()):
                    ids = np.frombuffer(raw + end, "<u4")
                    if len(ids) and int(ids.max()) >= 1 << 8 * width:
                        raise ValueError(f"an id needs more than {width} bytes")
                    at = cuts(ids)
                    raw = ids.astype(kind).tobytes()
                    body = [raw[a * width : b * width] for a, b in zip([0, *at], at)]
                    n.append(len(ids))
                    sizes.append(np.diff([0, *at]).tolist())
                    hashes.append([hashlib.sha256(x).digest() for x in body])
                    payloads.append(body)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sizes, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.binary())), pa.array(payloads, pa.list_(pa.binary()))], ["doc_id", "n_tokens", "sizes", "hashes", "payloads"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, sizes array<int>, hashes array<binary>, payloads array<binary>")


def _tree(recipes: DataFrame, upper: bool = True, lowest: DataFrame | None = None) -> DataFrame:
    """Merkle nodes (level, part, idx, hash) over recipes in file order.  A leaf holds id, tokens, sizes and hashes.

    upper=False: level 1 alone, which is one node for FAN documents; with `lowest`,
    a written level 1, only the levels above it are made.
    """
    leaf = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n_tokens").cast("string"), F.concat_ws(",", F.transform(F.arrays_zip("sizes", "hashes"), lambda c: F.concat(c["sizes"].cast("string"), F.lit(":"), F.hex(c["hashes"]))))), 256)
    rows = recipes.select(F.shiftright("row", 33).alias("part"), "row", leaf.alias("hash"))
    node = rows.select(F.lit(0).alias("level"), "part", (F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).alias("idx"), "hash")
    up = lambda d, k: d.groupBy("part", F.expr(f"idx div {FAN}").alias("idx")).agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), "hash"))), lambda x: x["hash"])), 256).alias("hash")).select(F.lit(k).alias("level"), "part", "idx", "hash")
    one = up(node, 1)
    if not upper:
        return one.select("level", F.col("part").cast("long").alias("part"), F.col("idx").cast("long").alias("idx"), "hash")
    two = up(one if lowest is None else lowest, 2)  # one node a part up to 2^20 documents; then the parts themselves are nodes
    three = two.groupBy("part").agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"])), 256).alias("hash"))
    three = three.select(F.lit(3).alias("level"), F.lit(-1).cast("long").alias("part"), F.col("part").cast("long").alias("idx"), "hash")
    four, five = up(three, 4), None
    five = four.groupBy().agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"])), 256).alias("hash")).select(F.lit(5).alias("level"), F.lit(-1).cast("long").alias("part"), F.lit(0).cast("long").alias("idx"), "hash")
    c = ["level", "part", "idx", "hash"]
    out = (one if lowest is None else two).select(*c)
    for x in (two, three, four, five)[lowest is not None :]:
        out = out.unionByName(x.select(*c))
    return out.select("level", F.col("part").cast("long").alias("part"), F.col("idx").cast("long").alias("idx"), "hash")


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, width: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encode documents and write the store.

    Null text is empty and holds the end id alone; rows that repeat a key keep
    their own recipes, in any order among them; a null key comes first; an empty
    table gives empty files; other columns are not read.
    """
    spark = docs.sparkSession
    stage = new_path(spark, "ids")
    encoded(docs, tokenizer, end_id, width, key, text).write.option("compression", "zstd").parquet(stage)
    staged = spark.read.parquet(stage)
    flat = staged.select(F.explode(F.arrays_zip("hashes", "sizes")).alias("c")).select(F.col("c.hashes").alias("hash"))
    repeats = Repeats(flat, col="hash")
    full = staged.select(F.explode(F.arrays_zip("hashes", "sizes", "payloads")).alias("c")).select(F.col("c.hashes").alias("hash"), F.col("c.sizes").alias("n"), F.col("c.payloads").alias("payload"))
    # one pass over the payloads: chunks that cannot repeat are at their place, the others are few
    repeats.mark(full).write.partitionBy("_maybe").option("compression", "zstd").parquet(f"{stage}-dealt")
    dealt = spark.read.schema("hash binary, n int, payload binary, _maybe boolean").parquet(f"{stage}-dealt")
    dealt.where("_maybe").drop("_maybe").dropDuplicates(["hash"]).write.option("compression", "zstd").parquet(f"{path}/chunks/more")
    move_path(spark, f"{stage}-dealt/_maybe=false", f"{path}/chunks/once")
    drop_path(spark, f"{stage}-dealt")
    recipes = staged.select("doc_id", "n_tokens", "sizes", "hashes")
    recipes.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first()).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{path}/recipes")
    # every level is reduced by itself, so no task gathers the leaves
    recipes = spark.read.parquet(f"{path}/recipes")
    _tree(recipes, upper=False).write.parquet(f"{path}/manifest/low")
    _tree(recipes, lowest=spark.read.parquet(f"{path}/manifest/low")).write.parquet(f"{path}/manifest/high")
    drop_path(spark, stage)


def root(nodes: DataFrame) -> str | None:
    got = nodes.where("level = 5").select("hash").first()
    return got[0] if got else None


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("level int, part long, idx long, hash string").parquet(f"{path}/manifest/low", f"{path}/manifest/high")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("hash binary, n int, payload binary").parquet(f"{path}/chunks/once", f"{path}/chunks/more")


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """a * b modulo the CRC-32 polynomial (reflected)."""
    m, p = 1 << 31, 0
    while True:
        if a & m:
            p ^= b
            if not a & (m - 1):
                return p
        m >>= 1
        b = b >> 1 ^ _POLY if b & 1 else b >> 1


@lru_cache(maxsize=20_000)
def _shift(n: int) -> int:
    """x^(8n) modulo the polynomial: what appending n bytes does to a checksum."""
    p, sq, k = 1 << 31, 1 << 23, n
    while k:
        if k & 1:
            p = _times(sq, p)
        sq = _times(sq, sq)
        k >>= 1
    return p


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """crc32 of a concatenation from (crc32, bytes) of its parts."""
    crc = 0
    for c, n in parts:
        crc = (_times(_shift(n), crc) if crc else 0) ^ c
    return crc


def read_store(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Read and verify: doc_id, start, n_tokens, ids_crc32, in no order.

    Every payload is hashed again and compared with its address, the Merkle root
    is computed again from the recipes; either mismatch raises.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    if root(_tree(recipes)) != root(manifest(spark, path)):
        raise ValueError("the recipes differ from the manifest")
    kind = f"<u{width}"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = []
            for h, n, p in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if hashlib.sha256(p).digest() != h or len(p) != n * width:
                    raise ValueError(f"chunk {h.hex()} is damaged")
                crc.append(zlib.crc32(np.frombuffer(p, kind).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64())], ["hash", "crc"])

    sums = chunks(spark, path).select("hash", "n", "payload").mapInArrow(verify, "hash binary, crc long")
    need = recipes.select("row", F.posexplode(F.arrays_zip("hashes", "sizes")).alias("k", "c")).select("row", "k", F.col("c.hashes").alias("hash"), F.col("c.sizes").alias("n"))
    got = need.join(sums, "hash").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "crc", "n"))).alias("parts"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [joined_crc([(x["crc"], 4 * x["n"]) for x in p]) for p in batch.column(1).to_pylist()]
            n = [sum(x["n"] for x in p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), pa.array(n, pa.int64())], ["row", "ids_crc32", "n_read"])

    crcs = got.mapInArrow(fold, "row long, ids_crc32 long, n_read long")
    part = F.shiftright("row", 33)
    totals = recipes.groupBy(part.alias("part")).agg(F.sum("n_tokens").alias("t"))  # one row a file
    totals = totals.withColumn("base", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    inner = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.select("doc_id", "row", "n_tokens", part.alias("part")).withColumn("in_part", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    out = placed.join(totals, "part").join(crcs, "row", "left")
    whole = F.when(F.col("n_read") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document cannot be rebuilt")).cast("long"))
    return out.select("doc_id", (F.col("base") + F.col("in_part")).alias("start"), "n_tokens", whole.alias("ids_crc32"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rebuilt id streams: doc_id, payloads array<binary> in order."""
    need = spark.read.parquet(f"{path}/recipes").select("doc_id", "row", F.posexplode("hashes").alias("k", "hash"))
    got = need.join(chunks(spark, path), "hash")
    return got.groupBy("doc_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "payload"))), lambda x: x["payload"]).alias("payloads")).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "store")
    write_store(table(spark, sf_dir, "documents"), path)
    return read_store(spark, path)
