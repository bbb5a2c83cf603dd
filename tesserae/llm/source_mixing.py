"""Mixing sources by temperature: weights from token shares to a power, met by bisection, spent in block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tesserae.llm.common import cut, split_join, table, whole_text, words

#: How much the mixture's entropy may lie above the token shares' own: this part of the way to the uniform mixture.
FLATTEN = 0.5
#: No document is used more often than this on average over its source.
MOST_EPOCHS = 4.0
#: Exponents tried at once, and how often the bracket is narrowed to one of the gaps between them.
TRIED, ROUNDS = 33, 6
#: Documents in a block of the permutation, about.
BLOCK = 1000
#: Sources up to this many are broadcast.
FEW = 200_000
SEED = 10


def _weigh(shares: DataFrame, exponents: list[float]) -> list:
    """For each exponent: entropy of the normalised weights, and the largest weight over share. One pass over the sources."""
    tried = shares.withColumn("a", F.explode(F.array(*(F.lit(float(a)) for a in exponents))))
    power = F.exp(F.col("a") * F.log("share"))
    sums = tried.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.col("a") * F.log("share")).alias("e"), F.max(power / F.col("share")).alias("m"))
    return sums.select("a", (F.log("z") - F.col("e") / F.col("z")).alias("entropy"), (F.col("m") / F.col("z")).alias("most")).orderBy("a").collect()


def solve_exponent(shares: DataFrame, flatten: float = FLATTEN, most_epochs: float = MOST_EPOCHS, budget_ratio: float = 1.0) -> float:
    """The least exponent in [0, 1] that keeps within both targets; `shares` has a positive double column share.

    Entropy falls and the worst repetition falls as the exponent grows, so both targets hold from some exponent on; the
    bracket around it is cut into TRIED - 1 parts at a time. If even 1 repeats too much the budget itself is too large
    for the corpus, and 1 is returned.
    """
    ends = _weigh(shares, [0.0, 1.0])
    if not ends:
        return 1.0
    target = ends[1].entropy + flatten * (ends[0].entropy - ends[1].entropy)
    fits = lambda x: x.entropy <= target + 1e-12 and x.most * budget_ratio <= most_epochs + 1e-12
    if fits(ends[0]):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        rows = _weigh(shares, [lo + (hi - lo) * i / (TRIED - 1) for i in range(TRIED)])
        first = next((i for i, x in enumerate(rows) if fits(x)), len(rows) - 1)
        lo, hi = rows[max(0, first - 1)].a, rows[first].a
        if hi <= lo:
            break
    return hi


def mixture(df: DataFrame, source: str = "source", tokens: str = "n_tokens", flatten: float = FLATTEN, most_epochs: float = MOST_EPOCHS, budget: int | None = None) -> DataFrame:
    """(source, docs, tokens, share, weight, budget) for each source that has tokens. Null is a source like any other.

    budget, in tokens, defaults to all tokens there are. Documents are summed per source before any shuffle.
    """
    sums = df.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("docs"), F.sum(F.col(tokens).cast("bigint")).alias("tokens")).where("tokens > 0")
    sums = cut(sums)
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    spend = total if budget is None else budget
    shares = sums.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    a = solve_exponent(shares, flatten, most_epochs, spend / max(total, 1))
    z = (shares.agg(F.sum(F.exp(F.lit(a) * F.log("share")))).first()[0] or 1.0)
    weighed = shares.withColumn("weight", F.exp(F.lit(a) * F.log("share")) / F.lit(z))
    return weighed.withColumn("budget", F.round(F.col("weight") * F.lit(float(spend))).cast("bigint")).withColumn("exponent", F.lit(a))


def realise(df: DataFrame, mixed: DataFrame, source: str = "source", tokens: str = "n_tokens", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """All rows of `df` with mix_copies (how often the mixture uses it), mix_weight and mix_place (its first place).

    A source is laid out in a random order of blocks, and randomly inside each block; its budget is spent along that
    order, whole passes first, then the part that still fits: the document at which the budget runs out is used if at
    least half of it fits. Sources without tokens have no weight: copies 0. Rows with equal source, key and tokens are one
    unit of the order and have equal copies. Only these three columns are laid out, so texts travel once, to the copies.
    Blocks are counted per source: no window holds more than a block or the list of a source's blocks. Null sources are
    one source, null keys and token counts are values like others (a null count is 0). Columns of `df` named like the
    three that are added are replaced; any other names are kept as they are.
    """
    # a row for each source: broadcast where they are few, as sources are
    few = mixed.count() <= FEW
    own = mixed.select(F.col("source").alias("mix_source"), F.col("docs").alias("mix_docs"), F.col("tokens").alias("mix_tokens"), F.col("weight").alias("mix_weight"), F.col("budget").alias("mix_budget"))
    added = ("mix_copies", "mix_weight", "mix_place")
    own_key = F.col(source).alias("u_source"), F.col(key).alias("u_key"), F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)).alias("u_size")
    total = df.count()
    units = df.select(*own_key).groupBy("u_source", "u_key", "u_size").agg(F.count("*").alias("times"))
    units = units.join(F.broadcast(own) if few else own, F.col("u_source").eqNullSafe(F.col("mix_source")), "left").withColumn("held", F.col("u_size") * F.col("times"))
    units = units.withColumn("mix_order", F.xxhash64(F.lit(seed), "u_key", "u_source"))
    blocks = F.coalesce(F.greatest(F.lit(1), F.ceil(F.col("mix_docs") / BLOCK)), F.lit(1)).cast("bigint")
    units = units.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "mix_order"), blocks))
    sums = units.groupBy(F.col("u_source").alias("s"), F.col("block").alias("b")).agg(F.sum("held").alias("all"))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("all").over(before), F.lit(0)))
    units = units.join(sums, F.col("u_source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    inside = Window.partitionBy("u_source", "block").orderBy("mix_order", "u_key", "u_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = units.withColumn("end", F.col("ahead") + F.sum("held").over(inside))
    passes = F.floor(F.col("mix_budget") / F.col("mix_tokens"))
    left = F.col("mix_budget") - passes * F.col("mix_tokens")
    fits = (2 * F.col("end") - F.col("held") <= 2 * left) & (left > 0)
    copies = F.when(F.col("mix_tokens").isNull(), 0).otherwise(passes + fits.cast("bigint")).cast("bigint")
    place = F.when(F.col("mix_tokens").isNotNull(), F.col("end") - F.col("held"))
    units = units.select("u_source", "u_key", "u_size", "times", copies.alias("mix_copies"), "mix_weight", place.alias("mix_place"))
    # all of a row in one column, so that no name of it can clash
    rows = df.drop(*added).select(F.struct("*").alias("row"), *own_key)
    back = split_join(rows, cut(units), ["u_source", "u_key", "u_size"], "times", total)
    return back.select("row.*", *added)


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", flatten: float = FLATTEN, most_epochs: float = MOST_EPOCHS, budget: int | None = None) -> DataFrame:
    """All rows of `df` with mix_n_tokens (words of the text), mix_copies, mix_weight and mix_place. An empty table: no rows."""
    counted = df.withColumn("mix_n_tokens", F.size(words(whole_text(text))).cast("bigint"))
    return realise(counted, mixture(counted, source, "mix_n_tokens", flatten, most_epochs, budget), source, "mix_n_tokens", key)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(words(whole_text("text"))).cast("bigint").alias("n_tokens"))
    docs = cut(docs)
    out = realise(docs, mixture(docs))
    return out.select("doc_id", "source", "n_tokens", F.round("mix_weight", 9).alias("weight"), F.col("mix_copies").alias("copies"), F.col("mix_place").alias("place"))
