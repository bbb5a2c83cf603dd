"""Registry manifests as tables, and published sets of tables that are refused whole when they aren't what was published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import registry

#: Which lists belong to which branch; all others are core. (Fixed values.)
BRANCHES = {"wnframe": "wordnet", "lexfile": "wordnet", "wnsentence": "wordnet", "wordnet-pos": "wordnet", "ili": "wordnet", "vnrole": "frames", "vaframe": "frames"}


class Stale(ValueError):
    """The published tables don't match their fingerprint, or were built on others than these."""


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated manifest: comment lines skipped, columns named by its first line, nothing quoted."""
    return spark.read.option("sep", "\t").option("comment", "#").option("header", True).option("quote", "").csv(path)


def slots(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(list, slot, id, status, key, identifier): the identifier is the key where the manifest has no column of its own."""
    rows = manifest(spark, path)
    shown = F.coalesce(F.col("identifier"), F.col("key")) if "identifier" in rows.columns else F.col("key")
    return rows.select(F.lit(name).alias("list"), F.col("slot").cast("int").alias("slot"), F.unhex("id").alias("id"), "status", "key", shown.alias("identifier"))


def branch(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of the lists of these branches (core, wordnet, frames)."""
    own = F.create_map(*(F.lit(x) for kv in BRANCHES.items() for x in kv))
    return rows.where(F.coalesce(F.element_at(own, F.col("list")), F.lit("core")).isin(wanted))


def fingerprint(rows: DataFrame) -> str:
    """A digest of the rows as a set with repeats: row hashes of 128 bits summed, so order and partitions don't matter."""
    whole = F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns))), {"ignoreNullFields": "false"})
    halves = [F.sum(F.xxhash64(F.lit(k), whole).cast("decimal(38,0)")).cast("string") for k in (1, 2)]
    n, *sums = rows.agg(F.count("*"), *halves).first()
    return f"{n}:{sums[0]}:{sums[1]}"


def publish(tables: dict[str, DataFrame], path: str, depends: str = "") -> str:
    """Write tables and then, last, the row of fingerprints that makes them readable. Tables with faults are not written.

    A table with columns slot and id must have each slot once, without gaps, and each id once.
    """
    spark = next(iter(tables.values())).sparkSession
    prints = {}
    for name, rows in tables.items():
        if {"slot", "id"} <= set(rows.columns) and registry.faults(rows).limit(1).count():
            raise Stale(f"{name} has faults")
        rows.write.parquet(f"{path}/{name}")
        prints[name] = fingerprint(spark.read.parquet(f"{path}/{name}"))
    listed = [(name, p, depends) for name, p in sorted(prints.items())]
    spark.createDataFrame(listed, "name string, fingerprint string, depends string").coalesce(1).write.parquet(f"{path}/_published")
    return ";".join(f"{n}={p}" for n, p, _ in listed)


def opened(spark: SparkSession, path: str, depends: str = "") -> dict[str, DataFrame]:
    """The published tables, all of them or Stale."""
    out = {}
    for r in spark.read.parquet(f"{path}/_published").collect():  # one row for each table
        rows = spark.read.parquet(f"{path}/{r.name}")
        if r.depends != depends or fingerprint(rows) != r.fingerprint:
            raise Stale(r.name)
        out[r.name] = rows
    return out


def pair(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (a, b, ...) with the c of a pair section, null where there is none."""
    return rows.join(pairs, ["a", "b"], "left")


def write_shards(table: DataFrame, path: str) -> None:
    """The codepoint table by shard: a branch then reads only its own folders."""
    table.write.partitionBy("shard").parquet(path)


def field_layout(spark: SparkSession, path: str) -> DataFrame:
    """(name, say, bit, width): the layout of a property record, from its manifest."""
    return manifest(spark, path).select("name", "say", F.col("bit").cast("int").alias("bit"), F.col("width").cast("int").alias("width"))
