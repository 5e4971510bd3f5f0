"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

Lines (split at U+000A, white space normalised) are equal or linked when one word
inserted, deleted or replaced turns one into the other; lines of fewer than
`least_words` words only match exact copies, so a link means a word similarity of
0.8 or more.  Classes are transitive; the earliest line of a class, by (document,
line number), stays.

Each line's variants are its words with any one left out.  A variant's key comes
from running sums of hashes of (word, place), so a line costs time in proportion
to its length, however long.  Two lines link only by the same variant with the
same word place left out (replacement), or when one line is the other's variant
(insertion), so each group of equal keys is linked to one member and no pairs
within a group are formed; that loses no class.

Before variants are made, lines without a possible partner leave.  One edit in n
words leaves the first or the last q words alone for any q of n / 2 or less; q is
taken from 2, 3, 4, 6, 8, 12, 16, ..., so nearly all lines of n and n + 1 words
have the same q and two keys (those at a step have the keys of both).  Keys met in
one distinct line only cannot have a partner; they are found by an exact count.

The text of lines is never stored for all lines: the documents are read once to
count lines by hash, and again for the lines that are repeated or may have a
partner.  Those are picked by a bit table of checked size (MOST_KEYS hashes, 2^20
words at most); above that bound by a join instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK, checkpoint, components, drop_path, fresh, new_path, table
from .exact_dedup import bits_of, table_words, tested

LEAST_WORDS = 5
MOST_KEYS = 1 << 24  # hashes in a bit table that is broadcast
_MASK = (1 << 31) - 1


def split_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, line, norm): every line that is not blank, numbered from 0."""
    # most lines are normal already, and finding that out is cheaper than rebuilding them
    norm = F.when(F.col("raw").rlike(r"[\x09-\x0D]|\x20\x20|^\x20|\x20$"), F.trim(F.regexp_replace("raw", BLANK, " "))).otherwise(F.col("raw"))
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n")).alias("line", "raw"))
    return rows.select("doc_id", "line", norm.alias("norm")).where("norm <> ''")


def _hashed(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"h1": F.xxhash64("norm"), "h2": F.xxhash64(F.lit(1), "norm")})


def _step(n: Column) -> Column:
    """The largest of 1, 2, 3, 4, 6, 8, 12, 16, ... that is n / 2 or less."""
    half = F.floor(n / 2).cast("long")
    power = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(half)) - 1)
    more = F.floor(power * 3 / 2).cast("long")
    return F.when((power > 1) & (half >= more), more).otherwise(power).cast("int")


def _with_keys(lines: DataFrame, least_words: int) -> DataFrame:
    """lines plus k0 .. k3: keys of first and last words that a partner shares; null where there is none."""
    w, n = F.col("_w"), F.col("_n")
    rows = lines.withColumn("_w", F.split("norm", " ")).withColumn("_n", F.size("_w"))
    rows = rows.withColumns({"_q": _step(n), "_p": _step(n - 1)})
    first = lambda q: F.xxhash64(F.lit(0), F.slice(w, F.lit(1), q))
    last = lambda q: F.xxhash64(F.lit(1), F.slice(w, n - q + 1, q))
    long, both = n >= least_words, (n >= least_words) & (F.col("_p") != F.col("_q"))
    keys = {"k0": F.when(long, first(F.col("_q"))), "k1": F.when(long, last(F.col("_q"))), "k2": F.when(both, first(F.col("_p"))), "k3": F.when(both, last(F.col("_p")))}
    return rows.withColumns(keys).drop("_w", "_n", "_q", "_p")


def _variants(lines: DataFrame) -> DataFrame:
    """(key, place, lid): whole lines with place -1, and every one-word deletion; from (lid, norm)."""
    words = lines.repartition("lid").select("lid", F.posexplode(F.split("norm", " ")).alias("j", "w"))
    here, back = F.xxhash64("w", "j"), F.xxhash64("w", F.col("j") - 1)
    low = lambda h: h.bitwiseAND(F.lit(_MASK))
    high = lambda h: F.shiftrightunsigned(h, 31).bitwiseAND(F.lit(_MASK))
    words = words.select("lid", "j", low(here).alias("a1"), high(here).alias("a2"), low(back).alias("b1"), high(back).alias("b2"))
    upto = Window.partitionBy("lid").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    # sums before place j as they are, sums after it as if moved one place to the front
    down = Window.partitionBy("lid").orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = words.select("lid", "j", *[(F.sum(a).over(upto) - F.col(a) + F.sum(b).over(down) - F.col(b)).alias(f"v{k}") for k, (a, b) in enumerate((("a1", "b1"), ("a2", "b2")))], *[F.sum(a).over(upto).alias(f"t{k}") for k, a in enumerate(("a1", "a2"))], F.lead("j").over(Window.partitionBy("lid").orderBy("j")).alias("next"))
    one = F.struct(F.xxhash64("v0", "v1").alias("key"), F.col("j").alias("place"))
    whole = F.struct(F.xxhash64("t0", "t1").alias("key"), F.lit(-1).alias("place"))
    return run.select("lid", F.explode(F.when(F.col("next").isNull(), F.array(one, whole)).otherwise(F.array(one))).alias("v")).select("v.key", "v.place", "lid")


def _within_one(a: str, b: str) -> str:
    """SQL: word arrays a and b differ by one word inserted, deleted or replaced, or not at all."""
    first = f"array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false)"
    tail = lambda x, i: f"slice({x}, cast({i} as int), greatest(size({x}) - cast({i} as int) + 1, 0))"
    return (
        f"case when {first} = 0 then true"
        f" when size({a}) = size({b}) then {tail(a, first + ' + 1')} = {tail(b, first + ' + 1')}"
        f" when size({a}) = size({b}) + 1 then {tail(a, first + ' + 1')} = {tail(b, first)}"
        f" when size({b}) = size({a}) + 1 then {tail(a, first)} = {tail(b, first + ' + 1')}"
        " else false end"
    )


class _Tables:
    """Written tables of one run, removed when they are no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = new_path(self.spark, f"lines-{name}")
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            drop_path(self.spark, self.paths.pop(name))


def _links(texts: DataFrame, tables: _Tables) -> DataFrame:
    """Links (a, b) between lines (lid, norm), enough to span every class."""
    variants = tables.write(_variants(texts), "variants")
    # the counts are written, so that the joins deal both sides anew and a hot key can be split
    groups = checkpoint(variants.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("place") < 0, F.col("lid"))).alias("whole")).where("n > 1").select("key", "whole"))
    met = tables.write(variants.join(groups, "key"), "met")
    inserted = met.where("whole is not null and whole <> lid").select(F.col("whole").alias("a"), F.col("lid").alias("b"))
    same = met.where("place >= 0").select("key", "place", "lid")
    least = checkpoint(same.groupBy("key", "place").agg(F.min("lid").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"))
    replaced = same.join(least, ["key", "place"]).where("a <> lid").select("a", F.col("lid").alias("b"))
    pairs = inserted.unionByName(replaced).distinct()
    side = lambda c, into: texts.select(F.col("lid").alias(c), F.split("norm", " ").alias(into))
    return pairs.join(side("a", "wa"), "a").join(side("b", "wb"), "b").where(F.expr(_within_one("wa", "wb"))).select("a", "b")


def gone_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, most_keys: int = MOST_KEYS) -> DataFrame:
    """The lines that go: doc_id, line, and the line that stays in their place (keep_doc, keep_line).

    A null id comes before all others.  Of rows that repeat an id, equal places hold
    one line if their texts are equal there, and otherwise each its own.
    """
    spark = docs.sparkSession
    tables = _Tables(spark)
    lines = _hashed(split_lines(docs, key, text))
    counted = _with_keys(lines, least_words).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)])
    distinct = tables.write(counted.withColumn("lid", F.monotonically_increasing_id()), "distinct")
    keyed = distinct.where("k0 is not null").select("lid", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key")).where("key is not null")
    twice = checkpoint(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    maybe = keyed.join(twice, "key", "left_semi").select(F.col("lid").alias("_lid")).distinct().withColumn("near", F.lit(True))
    wanted = distinct.drop("k0", "k1", "k2", "k3").join(maybe, F.col("lid") == F.col("_lid"), "left").withColumn("near", F.coalesce("near", F.lit(False))).drop("_lid")
    wanted = tables.write(wanted.where("near or n > 1"), "wanted")
    tables.drop("distinct")
    many = wanted.count()
    if many <= most_keys:
        words = table_words(many)
        some = tested(lines, bits_of(wanted.select("h1"), words, "h1"), words, "h1").where("_maybe").drop("_maybe")
    else:
        some = lines.join(wanted.select("h1", "h2"), ["h1", "h2"], "left_semi")
    some = tables.write(some, "some")
    near = wanted.where("near").select("lid", F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("first.doc_id").alias("_d"), F.col("first.line").alias("_l"))
    texts = some.join(near, (some["h1"] == near["_h1"]) & (some["h2"] == near["_h2"]) & some["doc_id"].eqNullSafe(near["_d"]) & (some["line"] == near["_l"])).select("lid", "norm").dropDuplicates(["lid"])
    texts = tables.write(texts, "texts")
    roots = components(_links(texts, tables))
    tables.drop("variants", "met", "texts")
    named = wanted.select("lid", "h1", "h2", "first", "n").join(roots, F.col("lid") == F.col("node"), "left")
    firsts = checkpoint(named.where("root is not null").groupBy("root").agg(F.min("first").alias("keep")).withColumnRenamed("root", "_root"))
    named = named.join(firsts, F.col("root") == F.col("_root"), "left").select("h1", "h2", "first", "n", F.coalesce("keep", "first").alias("keep"))
    named = named.where("n > 1 or keep.doc_id is distinct from first.doc_id or keep.line <> first.line")
    out = "doc_id", "line", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line").alias("keep_line")
    once = named.where("n = 1").select("first.doc_id", "first.line", "keep").select(*out)
    repeated = some.select("doc_id", "line", "h1", "h2").join(named.where("n > 1").select("h1", "h2", "keep"), ["h1", "h2"]).select(*out)
    return once.unionByName(repeated).where("doc_id is distinct from keep_doc or line <> keep_line")


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, most_keys: int = MOST_KEYS) -> DataFrame:
    """Every row: doc_id, n_lines (not blank), n_dropped, dropped (numbers of the lines that go, ascending).

    Null and blank texts have no lines; blank lines are never dropped; rows that
    repeat an id lose the same line numbers each; an empty table gives no rows.
    """
    gone = gone_lines(docs, key, text, least_words, most_keys)
    per = gone.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_set("line")).alias("dropped"))
    # a match begins at a line's first character that is not blank and takes the rest of the line
    ids = docs.select(F.col(f"`{key}`").alias("doc_id"), F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(r"[^\x09-\x0D\x20][^\n]*")).cast("long").alias("n_lines"))
    out = ids.join(per, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<int>")
    return out.select("doc_id", "n_lines", F.size(F.coalesce("dropped", none)).cast("long").alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """docs without the lines that go; other columns, of any name, as they are.

    A text of which all lines go is empty; null texts stay null; rows that repeat an
    id lose the same line numbers each; an empty table gives no rows.
    """
    name, gone_id = fresh(docs.columns, "_gone"), fresh(docs.columns, "_gone_id")
    gone = dropped_lines(docs, key, text, **kw).where("n_dropped > 0").select(F.col("doc_id").alias(gone_id), F.col("dropped").alias(name)).dropDuplicates([gone_id])
    out = docs.join(gone, F.col(f"`{key}`").eqNullSafe(F.col(gone_id)), "left")
    kept = F.array_join(F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda x, i: ~F.array_contains(F.col(name), i)), "\n")
    new = F.when(F.col(name).isNotNull(), kept).otherwise(F.col(f"`{text}`")).alias(text)
    return out.select(*[new if c == text else F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_lines(table(spark, sf_dir, "documents"))
