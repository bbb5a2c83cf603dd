"""Exact medians of groups of any size: brackets that narrow by counting, none of a large group gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.operators.checkpoints import cut

#: A group, or what is left of one, of this many values at most is sorted in one task.
GATHERED = 100_000
#: Larger groups, at most: their brackets are broadcast. With more rows in all, GATHERED grows.
BROADCAST = 100_000
#: Parts that a bracket is taken apart into in each round, about equal by a sketch and counted exactly.
PARTS = 64


def medians(df: DataFrame, group: str, value: str, out: str = "median", gathered: int = GATHERED) -> DataFrame:
    """(group, out): the exact median of each group's values, the mean of the middle two if they are even in number.

    Nulls don't count, a group of nulls alone has no row, a null group is one; NaN is above all numbers. A large group takes
    two aggregates for each factor of PARTS by which it exceeds `gathered`; values that come often have parts of their own.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    sizes = cut(rows.groupBy("g").agg(F.count("*").alias("n")))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    gathered = max(gathered, (total or 0) // BROADCAST)
    if (most or 0) <= gathered:
        return rows.groupBy(F.col("g").alias(group)).agg(F.median("v").alias(out))
    # the middle places, what lies before the bracket, and its ends, both in it
    middle = (F.floor((F.col("n") - 1) / 2).alias("a"), F.floor(F.col("n") / 2).alias("b"), F.lit(0).cast("bigint").alias("left"), F.lit(float("-inf")).alias("lo"), F.lit(float("nan")).alias("hi"))
    large = cut(sizes.where(F.col("n") > gathered).select(F.col("g").alias("k"), *middle))
    same = F.col("g").eqNullSafe(F.col("k"))

    def inside(state: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(state), same).where("v >= lo and v <= hi")

    state, found = large, [rows.join(F.broadcast(large), same, "left_anti").groupBy("g").agg(F.median("v").alias("m"))]
    while not state.isEmpty():
        cuts = inside(state).groupBy("g").agg(F.percentile_approx("v", [k / PARTS for k in range(PARTS + 1)], 16 * PARTS).alias("cuts"))
        cuts = cut(state.join(cuts, same).drop("g"))
        # odd parts lie between two cuts, even ones hold a cut's own value
        part = F.size(F.filter("cuts", lambda c: c <= F.col("v"))) + F.size(F.filter("cuts", lambda c: c < F.col("v")))
        parts = inside(cuts).groupBy("k", "a", "b", "left", part.alias("part")).agg(F.count("*").alias("size"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.coalesce(F.sum("size").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("left")
        parts = parts.withColumn("before", before)
        holds = {x: (F.col(x) >= F.col("before")) & (F.col(x) < F.col("before") + F.col("size")) for x in "ab"}
        pick = [F.max(F.when(holds["a"], F.col(c))).alias(n) for c, n in (("part", "part_a"), ("least", "lo"), ("most", "hi"), ("size", "size"), ("before", "left"))]
        next_ = parts.groupBy("k", "a", "b").agg(*pick, F.max(F.when(holds["b"], F.col("part"))).alias("part_b"), F.max(F.when(holds["b"], F.col("least"))).alias("up"))
        apart = F.col("part_a") != F.col("part_b")
        next_ = cut(next_.withColumn("m", F.when(apart, (F.col("hi") + F.col("up")) / 2).when(F.col("lo") == F.col("hi"), F.col("lo"))))
        found.append(next_.where("m is not null").select(F.col("k").alias("g"), "m"))
        bracket = ("k", "a", "b", "left", "lo", "hi")
        small = next_.where((F.col("size") <= gathered) & F.col("m").isNull()).select(*bracket)
        values = inside(small).groupBy("g", "a", "b", "left").agg(F.sort_array(F.collect_list("v")).alias("s"))
        at = [F.get("s", (F.col(x) - F.col("left")).cast("int")) for x in "ab"]
        found.append(values.select("g", ((at[0] + at[1]) / 2).alias("m")))
        state = next_.where((F.col("size") > gathered) & F.col("m").isNull()).select(*bracket)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select(F.col("g").alias(group), F.col("m").alias(out))
