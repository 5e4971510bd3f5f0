"""SimHash near-duplicates with pivot distance tables.

Fingerprints: 64 bits over word shingles.  Two fingerprints link at DISTANCE or
fewer differing bits; components are transitive.

Copies of a fingerprint are merged first.  Distances to pivots alone cannot find
candidates: unrelated 64-bit fingerprints lie 32 +- 4 bits from any pivot, so a
cell of width 2d + 1 holds most of all rows (README).  Buckets therefore come from
exact block keys: with the 64 bits cut into m blocks, two fingerprints that differ
in at most d bits agree on some m - d blocks, so every linked pair shares one of
the C(m, d) keys.  m follows the number of fingerprints (more blocks, longer keys),
which changes the cost and not the result.  Inside every bucket the pivot table
decides: Hamming distances of all members to PIVOTS reference fingerprints are
taken once for the batch of buckets, a pair is discarded when any coordinate
differs by more than d (triangle inequality), and survivors are verified on the
fingerprints themselves.

A bucket emits a spanning set of its links, not all pairs.  Buckets larger than
CHUNK are cut into chunks; every pair of chunks is one group, so that no task
holds more than two chunks and no pair is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, named_components, table, without

SHINGLE, DISTANCE, SEED = 4, 4, 42
PIVOTS = 16
CHUNK = 8192
#: Buckets up to this size are decided many at a time.
SMALL = 24
PAIRS_AT_ONCE = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a whole text; no word: 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    norm = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - shingle + 1].tolist()
    h = np.fromiter([xxh64_intdigest(norm[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        part = h[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS, seed: int = 1) -> np.ndarray:
    """Reference fingerprints, spread at random and fixed."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pivot_table(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints to the reference fingerprints."""
    out = np.empty((len(x), len(refs)), np.int8)
    for k, r in enumerate(refs):
        out[:, k] = np.bitwise_count(x ^ r)
    return out


def small_links(x: np.ndarray, sizes: np.ndarray, distance: int, refs: np.ndarray) -> list[tuple[int, int]]:
    """All links within buckets of up to SMALL members, which lie one after the other in x."""
    table, starts, out = pivot_table(x, refs), np.r_[0, np.cumsum(sizes)[:-1]], []
    for s in np.unique(sizes[sizes > 1]).tolist():
        i, j = np.triu_indices(s, 1)
        at = starts[sizes == s]
        step = max(1, PAIRS_AT_ONCE // len(i))
        for lo in range(0, len(at), step):
            part = at[lo : lo + step, None]
            a, b = (part + i).ravel(), (part + j).ravel()
            near = np.ones(len(a), bool)
            for k in range(len(refs)):
                near &= np.abs(table[a, k] - table[b, k]) <= distance
            a, b = x[a[near]], x[b[near]]
            near = np.bitwise_count(a ^ b) <= distance
            out += list(zip(a[near].tolist(), b[near].tolist()))
    return out


def bucket_links(left: np.ndarray, right: np.ndarray | None, distance: int, refs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning set of the links within `left`, or between `left` and `right`.

    Every member is compared with those of other trees only: a member joins the
    first tree that holds a neighbour, and trees that meet are merged.
    """
    tl = pivot_table(left, refs)
    r, tr = (left, tl) if right is None else (right, pivot_table(right, refs))
    root = np.arange(len(left) + (0 if right is None else len(right)))
    off = 0 if right is None else len(left)
    label_r = root[off:]
    order = np.argsort(tr[:, 0], kind="stable")
    first = tr[order, 0]
    out = []
    for i in range(len(left)):
        lo, hi = np.searchsorted(first, tl[i, 0] - distance), np.searchsorted(first, tl[i, 0] + distance, "right")
        near = order[lo:hi]
        near = near[label_r[near] != root[i]]  # already in one tree
        if right is None:
            near = near[near > i]
        for c in range(1, refs.shape[0], 5):  # discard by coordinate differences, a few pivots at a time
            if not len(near):
                break
            near = near[(np.abs(tr[near, c : c + 5] - tl[i, c : c + 5]) <= distance).all(axis=1)]
        near = near[np.bitwise_count(r[near] ^ left[i]) <= distance]
        if len(near):
            labels, at = np.unique(label_r[near], return_index=True)
            out += [(int(left[i]), int(r[near[k]])) for k in at]
            root[np.isin(root, labels)] = root[i]
    return out


def blocks_for(n: int, distance: int) -> int:
    """Blocks m so that C(m, d) keys give few chance candidates a fingerprint."""
    for m in range(distance + 1, distance + 5):
        if log2(max(n, 2)) + log2(comb(m, distance)) - 64 * (m - distance) / m <= 3:
            return m
    return distance + 5


def links(fps: DataFrame, n: int, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), enough to span every component."""
    m = blocks_for(n, distance)
    edge = [64 * k // m for k in range(m + 1)]
    masks = []
    for keep in itertools.combinations(range(m), m - distance):
        v = sum(((1 << edge[k + 1]) - (1 << edge[k])) for k in keep)
        masks.append(v - (1 << 64) if v >> 63 else v)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(v)) for v in masks])).alias("t", "key"))
    sized = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    # chunks a bucket has; nearly always 1
    big = sized.where(F.col("n") > chunk).select("t", "key", F.ceil(F.col("n") / chunk).cast("int").alias("c"))
    keyed = keyed.join(big, ["t", "key"], "left").withColumn("c", F.coalesce("c", F.lit(1))).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    # chunk i takes part in pairs (i, j) for all j; a pair's lesser and greater chunk
    dealt = keyed.select("fp", "t", "key", "i", F.explode(F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("c") - 1))).alias("j"))
    groups = dealt.groupBy("t", "key", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q")).agg(F.collect_list(F.when(F.col("i") <= F.col("j"), F.col("fp"))).alias("x"), F.collect_list(F.when(F.col("i") > F.col("j"), F.col("fp"))).alias("y"))
    groups = groups.where("size(x) + size(y) > 1").select("p", "q", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()
        for batch in batches:
            same, x, y = batch.column(0).to_numpy() == batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            sizes = np.diff(x.offsets.to_numpy())
            small = same & (sizes <= SMALL)
            part = x.filter(pa.array(small))
            found = small_links(part.flatten().to_numpy().view(np.uint64), sizes[small], distance, refs)
            for k in np.flatnonzero(~small).tolist():
                a = x[k].values.to_numpy().view(np.uint64)
                found += bucket_links(a, None if same[k] else y[k].values.to_numpy().view(np.uint64), distance, refs)
            e = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], ["a", "b"])

    return groups.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document: doc_id, fingerprint (16 hex digits), component_id.

    Null and blank texts have fingerprint zero and link like any other; rows with
    equal text fall together; a null id takes part but is no component's name
    unless all its ids are null; an empty table gives no rows.
    """
    fp = checkpoint(fingerprints(docs, shingle, key, text))
    reps = checkpoint(fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = named_components(reps.withColumnRenamed("fp", "id"), links(reps.select("fp"), reps.count(), distance)).withColumnRenamed("id", "_fp")
    out = fp.join(named, fp["fp"] == named["_fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the row with the smallest id (a null id only if alone).

    Rows of dropped ids leave by an anti join on the slim list of ids; of rows
    that repeat the id that stays, all stay, since nothing tells them apart.
    """
    gone = near_duplicates(docs, shingle, distance, key, text).where("doc_id is distinct from component_id").select("doc_id")
    return without(docs, key, gone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
