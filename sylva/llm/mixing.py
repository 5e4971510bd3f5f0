"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Tokens are summed per cell (source, lang, topic); raking scales the cells until
their margins meet the targets, with a cell's weight never above its tokens
(documents are sampled, not repeated).  A document stays with the probability
weight / tokens of its cell, decided by a hash of its id.

Targets are weights a value of each dimension (`targets`), or the table's own
margins flattened.  Rounds go on until no weight moves by more than TOLERANCE;
`margins` reports wanted and reached tokens of every value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK, FEW, Loop, checkpoint, table, without

SEED = 7
#: Share of all tokens to keep, exponent that flattens the margins where no targets are given.
KEEP, FLATTEN = 0.8, 0.85
#: Raking rounds at most, and the largest relative move of a weight that ends them.
ROUNDS, TOLERANCE = 40, 1e-3
#: Rounds between two looks at the moves.
TURN = 4
DIMS = ("source", "lang", "topic")


def length_topic(tokens: Column) -> Column:
    """The tables carry no topic: the decimal order of a document's length stands for it."""
    return F.when(tokens < 100, "short").when(tokens < 1000, "medium").otherwise("long")


def weighted_targets(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, dims: tuple[str, ...] = DIMS, keep: float | None = KEEP, flatten: float = FLATTEN) -> dict[str, DataFrame]:
    """Target tokens (value, target) of every value of every dimension.

    A dimension in `targets` has the given weights, scaled to sum to 1 over the
    values that occur (a value not named has weight 0 and leaves); the others have
    their margins raised to `flatten`.  All sum to `keep` of all tokens; keep=None is
    the largest share at which no value needs more tokens than it has.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    out, most = {}, 1.0
    for d in dims:
        m = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("t"))
        if targets and d in targets:
            given = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in targets[d].items()], "_v string, _p double")  # as many rows as the caller names
            m = m.join(given, F.col("value") == F.col("_v"), "left").withColumn("p", F.coalesce("_p", F.lit(0.0)))
        else:
            m = m.withColumn("p", F.pow("t", F.lit(flatten)))
        m = checkpoint(m.select("value", "t", "p"))
        s = m.agg(F.sum("p")).first()[0] or 1.0
        room = m.where("p > 0").agg(F.min(F.col("t") * F.lit(float(s)) / (F.col("p") * F.lit(float(max(total, 1)))))).first()[0]
        most = min(most, 1.0 if room is None else room)
        out[d] = m.select("value", (F.col("p") / F.lit(float(s))).alias("share"))
    share = most if keep is None else keep
    return {d: m.select("value", (F.col("share") * F.lit(float(share * total))).alias("target")) for d, m in out.items()}


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE, few: int = FEW) -> DataFrame:
    """cells (dims, tokens) plus weight.  Margins with no room left under the cells' tokens end below target; see `margins`.

    At most `few` cells are raked in one partition, where the margins need no
    exchange; more are dealt by each dimension in turn.  TURN rounds go by between two looks.
    """
    one = cells.count() <= few
    loop, step = Loop(cells.sparkSession, "rake", one), TURN
    w = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d, target in targets.items():
        w = w.join(target.select(F.col("value").alias("_v"), F.col("target").alias(f"_target_{d}")), F.col(d) == F.col("_v"), "left").drop("_v")
    w = loop.turn(w.withColumn("_old", F.col("weight")))
    for done in range(0, rounds, step):
        for _ in range(min(step, rounds - done)):
            w = w.withColumn("_old", F.col("weight"))
            for d in targets:
                m = F.sum("weight").over(Window.partitionBy(d))
                to = F.col("weight") * F.when(m > 0, F.col(f"_target_{d}") / m).otherwise(0.0)
                w = w.withColumn("weight", F.least(to, F.col("tokens").cast("double")))
        w = loop.turn(w)  # each turn reads the one before it
        moved = w.agg(F.max(F.abs(F.col("weight") - F.col("_old")) / F.greatest(F.col("_old"), F.lit(1e-9)))).first()[0]
        if moved is None or moved <= tolerance:
            break
    return w.select(*cells.columns, "weight")


def margins(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(dim, value, tokens, target, reached): what every value has, should have and has after raking."""
    out = None
    for d, target in targets.items():
        m = raked.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens"), F.sum("weight").alias("reached"))
        m = m.join(target, "value").select(F.lit(d).alias("dim"), "value", "tokens", "target", "reached")
        out = m if out is None else out.unionByName(m)
    return out


def cells_of(docs: DataFrame, key: str, text: str, source: str, lang: str, topic: str | None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, dims, tokens) of every row, and the tokens of every cell."""
    # words are one more than the gaps between them
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), BLANK, " "))
    tokens = (F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")
    named = (("source", source), ("lang", lang), *((("topic", topic),) if topic else ()))
    slim = checkpoint(docs.select(F.col(f"`{key}`").alias("doc_id"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in named], tokens.alias("tokens")))
    if topic is None:
        slim = slim.withColumn("topic", length_topic(F.col("tokens")))
    return slim, checkpoint(slim.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    topic: str | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    keep: float | None = KEEP,
    flatten: float = FLATTEN,
    rounds: int = ROUNDS,
    seed: int = SEED,
) -> DataFrame:
    """Every document: doc_id, source, lang, topic, tokens, probability, kept.

    `targets` gives weights by dimension ("source", "lang", "topic") and value.
    Tokens are white-space words; a null text has none, and a document without
    tokens counts as one, so that it follows its cell.  Null source, language or
    topic is a value of its own, shown as the empty string.  Rows that repeat an
    id share its decision.  An empty table gives no rows.
    """
    slim, cells = cells_of(docs, key, text, source, lang, topic)
    raked = rake(cells, weighted_targets(cells, targets, DIMS, keep, flatten), rounds)
    p = raked.select(*[F.col(d).alias(f"_{d}") for d in DIMS], F.least(F.col("weight") / F.col("tokens"), F.lit(1.0)).alias("probability"))
    # cells are few beside documents, but not bounded: Catalyst picks the join by their size
    out = slim.join(p, [slim[d] == p[f"_{d}"] for d in DIMS]).drop(*[f"_{d}" for d in DIMS])
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))
    return out.select("doc_id", *DIMS, "tokens", "probability", (u < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, key: str = "doc_id", **kw) -> DataFrame:
    """The rows of docs that the calibrated draw keeps, with their own columns, of any name.

    An id that a draw in any of its rows drops goes with all of its rows.
    """
    return without(docs, key, mix(docs, key=key, **kw).where("not kept").select("doc_id").distinct())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
