"""Language-model scores from Brown class bigrams.

Words of a text are lower-cased (A-Z) and followed by one end token.  Learning
reads every training document whole:

1. Counts of all words (one shuffle of partial counts).  Texts are turned into ids
   once and written, with the words that have none: ids are for the words whose share
   of all tokens is at least COMMON (at most 1 / COMMON words, a proven bound).
2. Exchange clustering of the words whose share is at least EXCHANGED (so there are
   at most 1 / EXCHANGED of them), all other words being in classes by spelling (their
   last two bytes).  Every round counts the classes before and after each word of one
   share over the whole corpus, then moves each of these words to the class that
   raises the class-bigram likelihood most.  The words of a share are dealt to GROUPS
   groups by their rank, and each group moves its words one after the other, so the
   result does not depend on how many tasks there are.  A share whose moves did not
   raise the likelihood is taken back, and the next one goes on.  Whole sweeps are
   made until one raises it by less than TOLERANCE a token, SWEEPS at most.
3. All other words, also those met once, move from the class by spelling to the class
   that raises the likelihood most, by the same rule and by all their neighbours in the
   corpus.  They move at once, by the counts that step 2 ends with, so again the result
   does not depend on tasks.  No word keeps a class by spelling; these are for words
   never seen.
4. Classes replace the ids (words without one meet theirs in a join), and class
   transitions are counted over the whole corpus.

P(text) = product of P(class | class before) P(word | class).  Transitions are
smoothed towards class shares.  A pair that holds a word met once counts a second time
with this word as unseen, which gives the spelling classes, one unseen word each, their
transitions.  Given a class, all its words sum to 1.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc_of_id, table, written

CLASSES, SPELLED = 64, 32
EXCHANGED, COMMON = 1e-5, 1e-6
SWEEPS, TOLERANCE = 4, 2e-3  # TOLERANCE: natural log of the likelihood a token
SHARES = 2  # a sweep moves one share of the words after the other
GROUPS = 16
TAU = 10.0
HELD_OUT = 1  # remainder of crc32(id) mod 5
FLUSH_WORDS, MEMO_WORDS = 1_000_000, 400_000
RUN = 1 << 18  # ids of a run
PART = 1 << 20  # tokens that a task gathers by word
ONCE = 100  # more than there are classes


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def spelling(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SPELLED


class Ids(dict):
    """Word to id; an absent word gets -1 minus its spelling class."""

    def __init__(self, words: dict[bytes, int]):
        super().__init__(words)
        self.most = len(words) + MEMO_WORDS

    def __missing__(self, word: bytes) -> int:
        v = -1 - spelling(word)
        if len(self) < self.most:
            self[word] = v
        return v


def by_id(known: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """A table of `known` by ids from 0 and of `absent` by spelling class, for ids as Ids gives them (absent words end up at its end)."""
    return np.concatenate([known, absent[::-1]])


def _tasks(docs: DataFrame) -> DataFrame:
    """Few, long tasks: what a task emits is bounded by the vocabulary, so fewer tasks shuffle less."""
    many = docs.rdd.getNumPartitions()
    return docs.coalesce(max(1, min(many, 2 * docs.sparkSession.sparkContext.defaultParallelism)))


def word_counts(texts: DataFrame) -> DataFrame:
    """(w binary, n): counts of all tokens of column text; the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = list(seen.items())
            seen.clear()
            for a in range(0, len(items), 50_000):
                w, n = zip(*items[a : a + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(n, pa.int64())], ["w", "n"])

        for batch in batches:
            for t in batch.column(0):
                seen.update(tokens(t.as_py()))
                seen[b""] += 1
                if len(seen) > FLUSH_WORDS:
                    yield from out()
        yield from out()

    return _tasks(texts.select("text")).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def staged(docs: DataFrame, words: list[bytes], scratch: Scratch) -> DataFrame:
    """(doc_id, train, row, ids, rare) of (doc_id, train, text): int32 ids of the whole text and its end, as Ids gives them, and the words without an id, in order.

    The end has the id 0, the given words 1 and so on.
    """
    shared = docs.sparkSession.sparkContext.broadcast({w: k + 1 for k, w in enumerate(words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, row = Ids(shared.value).__getitem__, TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part, ids, rare = batch.slice(lo, 1000), [], []
                for t in part.column(2):
                    w = tokens(t.as_py())
                    i = np.zeros(len(w) + 1, np.int32)
                    i[:-1] = np.fromiter(map(get, w), np.int32, len(w))
                    ids.append(i.tobytes())
                    rare.append([w[k] for k in np.flatnonzero(i < 0).tolist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.arange(row, row + part.num_rows)), pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary()))], ["doc_id", "train", "row", "ids", "rare"])
                row += part.num_rows

    return scratch.written(docs.select("doc_id", "train", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, train boolean, row long, ids binary, rare array<binary>"), "class-ids")


def _runs(batches: Iterator[pa.RecordBatch], look: np.ndarray, end: int = 0) -> Iterator[np.ndarray]:
    """Runs of what `look` holds for the ids of the first column; each starts with the one before it (the first with that of the end), so that every pair of neighbours lies in one run."""
    for batch in batches:
        x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
        for a in range(0, len(x), RUN):
            yield look[np.r_[x[a - 1] if a else end, x[a : a + RUN]]].astype(np.int64)


def neighbours(runs: DataFrame, look: np.ndarray, share: np.ndarray, cls: np.ndarray, classes: int) -> DataFrame:
    """(id, part, after, before binary: int64 counts by class, twice): one row a task and id in `share`.

    Class c has the id -1 - c, with the counts of the next class in `after`.
    """
    spark = runs.sparkSession
    shared, rows = spark.sparkContext.broadcast((look, share, cls)), len(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, ids, c = shared.value
        place = np.full(len(c), -1, np.int64)
        place[ids] = np.arange(rows)
        after, before, twice, m = np.zeros(rows * classes, np.int64), np.zeros(rows * classes, np.int64), np.zeros(rows, np.int64), np.zeros(classes * classes, np.int64)
        for s in _runs(batches, look):
            x, y, cx, cy, at = s[:-1], s[1:], c[s[:-1]], c[s[1:]], place[s]
            m += np.bincount(cx * classes + cy, minlength=classes * classes)
            here = np.flatnonzero(at[:-1] >= 0)
            after += np.bincount(at[here] * classes + cy[here], minlength=rows * classes)
            twice += np.bincount(at[here][x[here] == y[here]], minlength=rows)
            here = np.flatnonzero(at[1:] >= 0)
            before += np.bincount(at[1:][here] * classes + cx[here], minlength=rows * classes)
        a, b, m = after.reshape(rows, classes), before.reshape(rows, classes), m.reshape(classes, classes)
        used = np.flatnonzero(a.sum(1) + b.sum(1))
        part = TaskContext.get().partitionId()
        nil = np.zeros(classes, np.int64).tobytes()
        some = np.flatnonzero(m.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(-1 - some, pa.int32()), pa.array(np.full(len(some), part, np.int32)), pa.array([x.tobytes() for x in m[some]], pa.binary()), pa.array([nil] * len(some), pa.binary()), pa.array(np.zeros(len(some), np.int64))], ["id", "part", "after", "before", "twice"])
        for lo in range(0, len(used), 2000):
            k = used[lo : lo + 2000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[k], pa.int32()), pa.array(np.full(len(k), part, np.int32)), pa.array([x.tobytes() for x in a[k]], pa.binary()), pa.array([x.tobytes() for x in b[k]], pa.binary()), pa.array(twice[k])], ["id", "part", "after", "before", "twice"])

    return _tasks(runs).mapInArrow(run, "id int, part int, after binary, before binary, twice long")


def _added(group: pa.Table) -> pa.Table:
    """Sums of the rows of every id."""
    order = np.argsort(group["id"].to_numpy(), kind="stable")
    ids, starts = np.unique(group["id"].to_numpy()[order], return_index=True)
    out = []
    for c in ("after", "before"):
        m = np.frombuffer(b"".join(group[c].to_pylist()), np.int64).reshape(group.num_rows, -1)
        s = np.add.reduceat(m[order], starts, axis=0) if len(ids) else m
        out.append(pa.array([x.tobytes() for x in s], pa.binary()))
    twice = np.add.reduceat(group["twice"].to_numpy()[order], starts) if len(ids) else np.zeros(0, np.int64)
    return pa.table({"id": pa.array(ids, pa.int32()), "part": pa.array(np.full(len(ids), group["part"][0].as_py() if group.num_rows else 0), pa.int32()), "after": out[0], "before": out[1], "twice": pa.array(twice)})


def summed(parts: DataFrame, rows: int, tasks: int) -> DataFrame:
    """One row an id.  Many tasks are added in two levels, so that a group stays small."""
    schema, shard = "id int, part int, after binary, before binary, twice long", F.pmod("id", F.lit(max(1, min(200, rows // 200))))
    if tasks > 64:
        parts = parts.groupBy(shard, F.pmod("part", F.lit(int(tasks**0.5)))).applyInArrow(_added, schema)
    return parts.groupBy(shard).applyInArrow(_added, schema)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(m: np.ndarray) -> float:
    """What the classes contribute to the log likelihood of the corpus."""
    m = m.astype(float)
    return float(_f(m).sum() - _f(m.sum(0)).sum() - _f(m.sum(1)).sum())


def best_class(a: int, s: np.ndarray, p: np.ndarray, twice: int, m: np.ndarray, movable: int) -> int:
    """Class of 0 .. movable-1 to which a word of class a is best moved (from another class a always).

    s, p: its counts by class of the next and the previous token; twice: of the
    word after itself; m: class bigram counts with the word where it is.
    """
    m = m.astype(float).copy()
    s, p = s.astype(float), p.astype(float)
    m[a] -= s
    m[:, a] -= p
    m[a, a] += twice
    s, p = s.copy(), p.copy()
    s[a] -= twice
    p[a] -= twice
    k = np.arange(movable)
    js, ip = np.flatnonzero(s), np.flatnonzero(p)
    gain = (_f(m[:movable, js] + s[js]) - _f(m[:movable, js])).sum(1) + (_f(m[ip][:, :movable] + p[ip][:, None]) - _f(m[ip][:, :movable])).sum(0)
    d = m[k, k]
    gain += _f(d + s[k] + p[k] + twice) + _f(d) - _f(d + s[k]) - _f(d + p[k])
    # totals of the classes without the word, but with what stands beside it
    r, c = (m.sum(1) + p)[:movable], (m.sum(0) + s)[:movable]
    gain -= _f(r + s.sum() + twice) - _f(r) + _f(c + p.sum() + twice) - _f(c)
    b = int(gain.argmax())
    return b if a >= movable or gain[b] > gain[a] + 1e-9 else a


def bigrams(runs: DataFrame, look: np.ndarray, classes: int, end: int = 0, movable: int = CLASSES) -> np.ndarray:
    """Class bigram counts over all runs (2 x classes x classes): of the classes that `look` gives, and of the pairs that hold a word met once, as they read if it were unseen."""
    shared = runs.sparkSession.sparkContext.broadcast(look)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(2 * classes * classes, np.int64)
        for s in _runs(batches, shared.value, end):
            c, once = s % ONCE, s // ONCE
            m += np.bincount(c[:-1] * classes + c[1:], minlength=len(m))
            u = np.where(once > 0, movable + once - 1, c)
            at = np.flatnonzero(once[:-1] + once[1:])
            m += np.bincount((classes + u[at]) * classes + u[at + 1], minlength=len(m))
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(m[at])], ["k", "n"])

    got = _tasks(runs).mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(2 * classes * classes, np.int64)
    for k, n in got:
        out[k] = n
    return out.reshape(2, classes, classes)


def exchange(texts: DataFrame, words: list[bytes], look: np.ndarray, sweeps: int = SWEEPS, movable: int = CLASSES, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Classes by id (0: end, 1..: words, then the spelling classes, where all other words are) and class bigram counts; `look` gives these ids for those of texts (ids)."""
    classes = movable + SPELLED + 1
    cls = np.array([classes - 1, *(zlib.crc32(w[-2:]) % movable for w in words), *range(movable, movable + SPELLED)], np.int64)
    scratch, runs = Scratch(texts.sparkSession), texts.select("ids")
    # words of one group and one share are dealt by their rank
    shares = [np.array([k for k in range(1, len(words) + 1) if k // GROUPS % SHARES == r], np.int64) for r in range(SHARES)]
    many, best, swept = _tasks(runs).rdd.getNumPartitions(), None, None

    def counted(share: np.ndarray) -> tuple[np.ndarray, DataFrame]:
        parts = neighbours(runs, look, share, cls, classes)
        vectors = scratch.written(summed(parts, len(share), many), "class-neighbours")
        m = np.zeros((classes, classes), np.int64)
        for i, row in vectors.where("id < 0").select("id", "after").collect():  # a row a class
            m[-1 - i] = np.frombuffer(row, np.int64)
        return m, vectors.where("id > 0")

    for k in range(sweeps * SHARES if words else 0):
        share = shares[k % SHARES]
        m, vectors = counted(share)
        if best is not None and likelihood(m) <= best[0]:
            # the last share's moves, made at once, did not help: from the classes before them this share goes on
            cls = best[1]
            m, vectors = counted(share)
        best = likelihood(m), cls
        if k % SHARES == 0:
            if swept is not None and best[0] - swept <= tolerance * max(1, m.sum()):
                break
            swept = best[0]
        now = cls

        def move(group: pa.Table) -> pa.Table:
            here, out = m.astype(float), []  # follows the moves of this group
            group = group.sort_by("id")
            ids, twice = group["id"].to_pylist(), group["twice"].to_pylist()
            for j, x, y, t in zip(ids, group["after"], group["before"], twice):
                s, p, old = np.frombuffer(x.as_py(), np.int64).astype(float), np.frombuffer(y.as_py(), np.int64).astype(float), int(now[j])
                out.append(best_class(old, s, p, t, here, movable))
                if out[-1] != old:
                    for a, sign in ((old, -1), (out[-1], 1)):
                        if sign > 0:
                            s[old] -= t
                            p[old] -= t
                        here[a] += sign * s
                        here[:, a] += sign * p
                        here[a, a] += t
            return pa.table({"id": pa.array(ids, pa.int32()), "c": pa.array(out, pa.int32())})

        cls = cls.copy()
        for i, c in vectors.drop("part").groupBy(F.pmod("id", F.lit(GROUPS))).applyInArrow(move, "id int, c int").collect():  # at most 1 / EXCHANGED rows
            cls[i] = c
    m = bigrams(runs, cls[look], classes)[0]
    if best is not None and likelihood(m) < best[0]:
        cls = best[1]
        m = bigrams(runs, cls[look], classes)[0]
    scratch.close()
    return cls, m


def inserted(word: np.ndarray, x: np.ndarray, y: np.ndarray, twice: np.ndarray, old: np.ndarray, m: np.ndarray, movable: int) -> np.ndarray:
    """What best_class gives for many words at once; old: their classes, all of them movable or more.

    word (0 .. len(old)-1, each of them met), x, y, twice: one entry an occurrence: the
    word, the classes of the previous and the next token, whether that is the word again.
    Of equally good classes it is the one of number old % movable, else the first.
    """
    m, classes = m.astype(float), len(m)
    n, out = np.bincount(word, minlength=len(old)), np.zeros((len(old), movable))

    def entries(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys, many = np.unique(word * classes + c, return_counts=True)
        return keys, keys // classes, keys % classes, many

    sides = []
    for c, rows in ((y, m[:movable].T), (x, m[:, :movable])):  # rows: by the class beside the word, then its own
        keys, w, c, k = entries(c)
        few = np.stack([_f(rows + t) - _f(rows) for t in range(9)])
        got = few[np.minimum(k, 8), c]
        more = np.flatnonzero(k > 8)
        got[more] = _f(rows[c[more]] + k[more, None]) - _f(rows[c[more]])
        out += np.add.reduceat(got, np.flatnonzero(np.diff(w, prepend=-1)), axis=0)
        own = np.zeros(len(old))  # times the word's old class is beside it
        own[w[c == old[w]]] = k[c == old[w]]
        sides.append((keys, w, c, k, own, rows))
    for (_, w, c, k, _, _), (_, _, _, _, own, rows) in (sides, sides[::-1]):  # where the word itself is in the counts beside it
        at = np.flatnonzero((c < movable) & (own[w] > 0))
        w, c, k = w[at], c[at], k[at]
        v, o = rows[old[w], c], own[w]
        out[w, c] += _f(v - k + o) - _f(v - k) - _f(v + o) + _f(v)
    both, i, j = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
    w, c, s, p = both // classes, both % classes, sides[0][3][i], sides[1][3][j]
    w, c, s, p = (a[c < movable] for a in (w, c, s, p))
    d = m[c, c]
    out[w, c] += _f(d + s + p) + _f(d) - _f(d + s) - _f(d + p)
    sizes, at = np.unique(n, return_inverse=True)
    for t in (m.sum(1)[:movable], m.sum(0)[:movable]):
        out -= (_f(t + sizes[:, None]) - _f(t))[at]
    best, own = out.argmax(1), old % movable
    line = np.arange(len(old))
    best = np.where(out[line, own] >= out[line, best] - 1e-9, own, best)
    for w in np.unique(word[twice]).tolist():
        at = word == w
        best[w] = best_class(int(old[w]), np.bincount(y[at], minlength=classes), np.bincount(x[at], minlength=classes), int(twice[at].sum()), m, movable)
    return best


def insert(texts: DataFrame, words: list[bytes], first: int, look: np.ndarray, m: np.ndarray, many: int, movable: int = CLASSES) -> DataFrame:
    """(w, n, c): counts and classes of all words of texts (ids, rare) after the `first` words, from their neighbours of all the corpus; `look`: classes by id, these words' by spelling.

    many: their tokens.  A word's occurrences are in one task, some PART tokens a task.
    """
    classes, spark = movable + SPELLED + 1, texts.sparkSession
    shared = spark.sparkContext.broadcast((pa.array([b"", *words], pa.binary()), look, m))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, look, _ = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                s = np.r_[0, np.frombuffer(b"".join(part.column(0).to_pylist()), np.int32)]
                c, rare = look[s].astype(np.int32), part.column(1).flatten()
                at = np.flatnonzero((s < 0) | (s > first))
                own = s[at]
                again = np.zeros(len(at), bool)
                j = np.flatnonzero((np.diff(at) == 1) & (own[1:] == own[:-1]))
                r = (np.cumsum(own < 0) - 1)[j]
                same = own[j] > 0
                k = np.flatnonzero(~same)
                same[k] = pc.equal(rare.take(pa.array(r[k])), rare.take(pa.array(r[k] + 1))).to_numpy(zero_copy_only=False)
                again[j] = same
                p = ((c[at - 1] * classes + c[at + 1]) * 2 + again).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rare, pa.array(p[own < 0])], ["w", "p"])
                yield pa.RecordBatch.from_arrays([named.take(pa.array(own[own > 0])), pa.array(p[own > 0])], ["w", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value[2]
        got = pa.Table.from_batches(batches, pa.schema([("w", pa.binary()), ("p", pa.int32())])).combine_chunks()
        if not got.num_rows:
            return
        names = got["w"].combine_chunks().dictionary_encode()
        word, p = names.indices.to_numpy().astype(np.int64), got["p"].to_numpy().astype(np.int64)
        order = np.argsort(word, kind="stable")
        word, p = word[order], p[order]
        n = np.bincount(word)
        old = np.array([movable + spelling(w) for w in names.dictionary.to_pylist()], np.int64)
        ends, c, lo = np.cumsum(n), np.zeros(len(n), np.int32), 0
        while lo < len(n):  # some 2^17 occurrences at a time
            a = ends[lo] - n[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, a + (1 << 17), "right")))
            k = slice(a, ends[hi - 1])
            c[lo:hi] = inserted(word[k] - lo, p[k] // 2 // classes, p[k] // 2 % classes, p[k] % 2 > 0, old[lo:hi], m, movable)
            lo = hi
        for lo in range(0, len(n), 50_000):
            k = slice(lo, lo + 50_000)
            yield pa.RecordBatch.from_arrays([names.dictionary[k], pa.array(n[k], pa.int64()), pa.array(c[k])], ["w", "n", "c"])

    parts = max(spark.sparkContext.defaultParallelism, -(-many // PART))
    return texts.select("ids", "rare").mapInArrow(met, "w binary, p int").repartition(parts, "w").mapInArrow(run, "w binary, n long, c int")


@dataclass
class ClassModel:
    """total, types, ends: tokens, distinct tokens and texts of training; moved, counts, cls: the words of a share of COMMON, their counts, and the class of 0 (end) and of these words; bigrams, once: class bigram counts, and those of the pairs that hold a word met once, read as unseen."""

    total: int
    types: int
    ends: int
    moved: list[bytes]
    counts: np.ndarray
    cls: np.ndarray
    bigrams: np.ndarray | None = None
    once: np.ndarray | None = None
    movable: int = CLASSES

    def settle(self, m: np.ndarray) -> None:
        self.bigrams, self.once = m
        m = m.sum(0).astype(float)
        k = slice(self.movable, self.movable + SPELLED)
        self.size = self.bigrams.sum(0).astype(float)  # tokens of each class
        self.size[k] = self.once.sum(0)[k]
        share = (self.size + 0.5) / (self.size.sum() + 0.5 * len(m))
        self.transition = np.log10((m + TAU * share) / (m.sum(1, keepdims=True) + TAU))
        # a spelling class is one unseen word
        self.unseen = np.zeros(SPELLED)

    @property
    def den(self) -> float:
        return self.total + 0.5 * (self.types + 1)

    def code(self) -> np.ndarray:
        """Class by id, of words met once with ONCE times their spelling class (from 1) beside it."""
        once = np.array([0, *(1 + spelling(w) if n == 1 else 0 for w, n in zip(self.moved, self.counts.tolist()))], np.int64)
        return by_id(self.cls + ONCE * once, np.arange(self.movable, self.movable + SPELLED))


def coded(ids: DataFrame, model: ClassModel, counts: DataFrame) -> DataFrame:
    """(ids binary, doc_id, train, n_tokens, n_known, base_score, own): int32 codes of the classes of whole texts and their ends; own: sum of log10 of the counts of the known words."""
    n = np.array([model.ends, *model.counts.tolist()], float)
    base = by_id(np.log10(n + 0.5), np.full(SPELLED, np.log10(0.5))) - np.log10(model.den)
    logs, known = by_id(np.log10(np.maximum(np.r_[1, n[1:]], 1)), np.zeros(SPELLED)), by_id(n > 0, np.zeros(SPELLED, bool))
    shared = ids.sparkSession.sparkContext.broadcast((model.code(), base, logs, known))
    rest = counts.where((F.length("w") > 0) & (F.col("n") < model.total * COMMON))
    once = F.when(F.col("n") == 1, ONCE * (1 + F.crc32(F.expr("substring(w, -2, 2)")) % SPELLED)).otherwise(0)
    rest = rest.select(F.xxhash64("w").alias("h"), "w", (F.col("c") + once).alias("code"), F.log10((F.col("n") + 0.5) / 0.5).alias("more_base"), F.log10("n").alias("more_own"))
    met = ids.select("row", F.posexplode("rare").alias("at", "w")).withColumn("h", F.xxhash64("w"))
    place = F.shiftleft(F.col("at").cast("long"), 16) + F.col("code")
    more = met.join(rest, ["h", "w"]).groupBy("row").agg(F.collect_list(place).alias("places"), F.sum("more_base").alias("more_base"), F.sum("more_own").alias("more_own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, base, logs, known = shared.value
        for batch in batches:
            out = []
            for x, places in zip(batch.column(0), batch.column(3)):
                i = np.frombuffer(x.as_py(), np.int32)
                c, k = code[i].astype(np.int32), 0
                if places.is_valid:
                    p = places.values.to_numpy()
                    c[np.flatnonzero(i < 0)[p >> 16]] = p & 0xFFFF
                    k = len(p)
                out.append((c.tobytes(), len(i), int(known[i].sum()) + k, float(base[i].sum()), float(logs[i].sum())))
            cols = list(zip(*out)) or [[]] * 5
            a, b = (np.nan_to_num(batch.column(k).to_numpy(zero_copy_only=False).astype(float)) for k in (4, 5))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), batch.column(1), batch.column(2), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(np.array(cols[3], float) + a), pa.array(np.array(cols[4], float) + b)], ["ids", "doc_id", "train", "n_tokens", "n_known", "base_score", "own"])

    both = ids.drop("rare").join(more, "row", "left").select("ids", "doc_id", "train", "places", "more_base", "more_own")
    return written(both.mapInArrow(run, f"ids binary, doc_id {ids.schema['doc_id'].dataType.simpleString()}, train boolean, n_tokens long, n_known long, base_score double, own double"), "class-codes")


def fitted(docs: DataFrame, sweeps: int, scratch: Scratch) -> tuple[ClassModel, DataFrame, DataFrame]:
    """The model from the rows of docs (doc_id, train, text) that are train, the counts and classes (w, n, c) of all its words, and the codes of all rows."""
    train = docs.where("train")
    seen = written(word_counts(train), "word-counts")
    total, types = seen.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    common = {bytes(w): n for w, n in seen.where((F.col("n") >= total * COMMON) & (F.length("w") > 0)).collect()}  # at most 1 / COMMON rows
    words = sorted(common, key=lambda w: (-common[w], w))
    first = sum(n >= total * EXCHANGED for n in common.values())
    ends = seen.where(F.length("w") == 0).agg(F.sum("n")).first()[0] or 0
    ids = staged(docs, words, scratch)
    learned, by_spelling = ids.where("train"), np.array([first + 1 + spelling(w) for w in words[first:]], np.int64)
    look = by_id(np.r_[np.arange(first + 1), by_spelling], np.arange(first + 1, first + 1 + SPELLED))
    cls, m = exchange(learned, words[:first], look, sweeps)
    many = total - ends - sum(common[w] for w in words[:first])
    others = written(insert(learned, words, first, cls[look], m, many), "class-words")
    classes = dict(zip(words, cls[1 : first + 1].tolist()))
    classes |= {bytes(w): c for w, c in others.where(F.col("n") >= total * COMMON).select("w", "c").collect()}  # at most 1 / COMMON rows
    model = ClassModel(total, types, ends, words, np.array([common[w] for w in words], np.int64), np.array([cls[0], *(classes[w] for w in words)], np.int64))
    counts = seen.where((F.col("n") >= total * COMMON) | (F.length("w") == 0)).select("w", "n", F.lit(None).cast("int").alias("c"))
    counts = counts.unionByName(others.where(F.col("n") < total * COMMON))
    codes = coded(ids, model, counts)
    size = model.movable + SPELLED + 1
    model.settle(bigrams(codes.where("train").select("ids"), np.arange(ONCE * (SPELLED + 1)), size, size - 1))
    return model, counts, codes


def learn(train: DataFrame, sweeps: int = SWEEPS) -> tuple[ClassModel, DataFrame]:
    """The model from column text of train, and the full counts (w, n, c); c, the class, is null for the words of model.moved and the end."""
    scratch = Scratch(train.sparkSession)
    model, counts, _ = fitted(train.select(F.lit(None).cast("long").alias("doc_id"), F.lit(True).alias("train"), "text"), sweeps, scratch)
    scratch.close()
    return model, counts


def scored(codes: DataFrame, model: ClassModel) -> DataFrame:
    """Every row of the codes: doc_id, train, n_tokens, n_known, base_score, score."""
    size = np.log10(np.maximum(model.size, 1))
    size[model.movable : model.movable + SPELLED] = 0
    # the end is the only word of its class
    size[-1] = 0
    shared = codes.sparkSession.sparkContext.broadcast((model.transition, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition, size = shared.value
        end = len(size) - 1
        for batch in batches:
            out = np.empty(batch.num_rows)
            for k, x in enumerate(batch.column(0)):
                c = np.frombuffer(x.as_py(), np.int32) % ONCE
                out[k] = transition[np.r_[end, c[:-1]], c].sum() - size[c].sum()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(1, 6)), pa.array(out + batch.column(6).to_numpy())], ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    return codes.select("ids", "doc_id", "train", "n_tokens", "n_known", "base_score", "own").mapInArrow(run, f"doc_id {codes.schema['doc_id'].dataType.simpleString()}, train boolean, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, model: ClassModel, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row: doc_id, n_tokens, n_known, base_score, score."""
    scratch = Scratch(docs.sparkSession)
    ids = staged(docs.select(F.col(f"`{key}`").alias("doc_id"), F.lit(False).alias("train"), F.col(f"`{text}`").alias("text")), model.moved, scratch)
    codes = coded(ids, model, counts)
    scratch.close()
    return scored(codes, model).drop("train")


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", sweeps: int = SWEEPS) -> DataFrame:
    """Every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text is empty and scores its end token alone; a null id counts as
    training; rows that repeat a document are learned and scored each; texts of any
    length are read whole; words of equal count rank by their bytes; without
    training rows all words are unseen; an empty table gives no rows.
    """
    slim = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    held = F.coalesce(crc_of_id() % 5 == HELD_OUT, F.lit(False))
    scratch = Scratch(docs.sparkSession)
    model, _, codes = fitted(slim.withColumn("train", ~held), sweeps, scratch)
    scratch.close()
    return scored(codes, model).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
