"""Registry entries taken apart again: what an entry's parts compose to must be the entry, by id and by coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.identity import compose_column
from tesserae.operators import text as X
from tesserae.operators.checkpoints import cut

PLACE = [f"m{d}" for d in range(4)]


def _composed(entries: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries as their parts make them, and the edges of all parts' texts."""
    pieces = entries.select("key", F.posexplode("parts").alias("ordinal", "part"))
    texts = cut(pieces.select("part").distinct())
    links = cut(X.edges(texts, "part"))
    roots = X.text_ids(texts, "part", "part").withColumnRenamed("id", "node").drop("tier")
    known = roots.join(X.placed(links, points), "node")
    found = pieces.join(known, "part", "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ordinal", "node", "tier", *PLACE))).alias("of"))
    # one part is the entry; of several, the level above them at their mean; a part that is no text leaves the entry without an id
    whole = (F.size("of") > 0) & ~F.exists("of", lambda x: x["node"].isNull())

    def middle(name: str):
        total = F.aggregate("of", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x[name]).cast("decimal(38,0)"))
        return F.when(whole, F.call_function("div", total, F.size("of").cast("decimal(10,0)")).cast("bigint")).alias(name)

    tier = F.when(F.size("of") == 1, F.get("of", F.lit(0))["tier"]).otherwise(F.least(F.lit(255), F.array_max(F.transform("of", lambda x: x["tier"])) + 1))
    nodes = F.transform("of", lambda x: x["node"])
    return cut(found.select("key", compose_column(F.when(whole, nodes)).alias("id"), F.when(whole, tier).cast("int").alias("tier"), *map(middle, PLACE), nodes.alias("nodes"))), links


def composed(entries: DataFrame, points: DataFrame) -> DataFrame:
    """(key, id, tier, m0..m3): entries (key, parts array<string>) as their parts in order make them.

    `points` (letter, m0..m3) has where codepoints lie. Null or empty parts, and no parts, give nulls; other columns are not read. A key is one
    entry; the parts of one entry, a handful in a registry, meet in one row.
    """
    return _composed(entries, points)[0].drop("nodes")


def decomposed(entries: DataFrame, points: DataFrame) -> DataFrame:
    """(key, ordinal, child, run): the constituents of those entries (key, id, m0..m3, parts) whose parts make their id and coordinates.

    An entry of several parts has these as its constituents, one of one part those of its text, a lone codepoint itself. Entries with
    another id or place, or with nulls there, are refused: they have no rows. Two entries under one key must both be what their parts make together,
    so keys have to be unique.
    """
    made, links = _composed(entries, points)
    claim = entries.select("key", F.col("id").alias("said"), *(F.col(n).alias(f"said_{n}") for n in PLACE))
    same = [F.col("id") == F.col("said"), *(F.col(n) == F.col(f"said_{n}") for n in PLACE)]
    true = made.join(claim, "key")
    for test in same:
        true = true.where(test)
    several = true.where(F.size("nodes") > 1).select("key", F.posexplode("nodes").alias("ordinal", "child")).withColumn("run", F.lit(1))
    one = true.where(F.size("nodes") == 1).join(links, F.col("id") == F.col("parent"))
    return several.unionByName(one.select("key", "ordinal", F.coalesce("child", "parent").alias("child"), "run"))
