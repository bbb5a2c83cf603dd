"""What the corpus operators share: reading tables, checkpoints in the shared folder, and word rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.checkpoints import cut, shared_folder

__all__ = ["cut", "shared_folder", "stored", "split_join", "table", "whole_text", "ascii_lower", "words", "fold_of"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: White space of the word rule, written for a Java character class.
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """As cut(), but as a Parquet table in the shared checkpoint folder: smaller where columns repeat or compress well."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_join(left: DataFrame, right: DataFrame, keys: list[str], times: str, total: int, hot: int = 256) -> DataFrame:
    """left joined to right, which has one row for each key, with how many rows of left have the key in `times`; `total` is their sum.

    Keys of more than max(hot, total / 100,000) rows are 100,000 at most: they are broadcast, so that their rows stay
    where they are. The others are shuffled, none of them being large. Null keys match each other. `right` is read more
    than once, so it should be stored.
    """
    bound = max(hot, total // 100_000)
    own = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    if own.where(F.col(times) > bound).isEmpty():
        return left.join(own, match).drop(*(f"_on_{k}" for k in keys))
    large, rest = F.broadcast(own.where(F.col(times) > bound)), own.where(F.col(times) <= bound)
    small = left.join(F.broadcast(large.select(*(f"_on_{k}" for k in keys))), match, "left_anti").join(rest, match)
    return small.unionByName(left.join(large, match)).drop(*(f"_on_{k}" for k in keys))


def whole_text(text: Column | str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column, outside: str = SPACES) -> Column:
    """Words as an array: the maximal runs without the characters of `outside`."""
    parts = F.split(text, f"[{outside}]+", -1)
    return F.filter(parts, lambda w: w != "")


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % folds
