"""Registries: lists of slots, banks of bits, crosswalks and keys, as small tables that joins read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Banks: list, width in bits, offset, and whether slots are flags or one number (slot + 1). (Fixed values.)
BANKS = (("kind", 8, 0, True), ("upos", 5, 8, False), ("lexfile", 6, 13, False), ("deprel", 6, 19, False), ("vnrole", 6, 25, False), ("wnframe", 6, 31, False))


def bank(name: str) -> tuple[str, int, int, bool]:
    return next(b for b in BANKS if b[0] == name)


def field(name: str) -> int:
    _, width, offset, _ = bank(name)
    return ((1 << width) - 1) << offset


def encoded(name: str, slot: Column) -> Column:
    """The bits of a slot, null if the bank can't hold it."""
    _, width, offset, flags = bank(name)
    slot = slot.cast("int")
    if flags:
        return F.when((slot >= 0) & (slot < width), F.call_function("shiftleft", F.lit(1).cast("bigint"), slot + offset))
    return F.when((slot >= 0) & (slot + 1 < (1 << width)), F.shiftleft((slot + 1).cast("bigint"), offset))


def put(mask: Column, name: str, slot: Column) -> Column:
    bits = encoded(name, slot)
    kept = mask if bank(name)[3] else mask.bitwiseAND(F.lit(~field(name)))
    return kept.bitwiseOR(bits)


def has(mask: Column, name: str, slot: Column) -> Column:
    bits = encoded(name, slot)
    here = mask.bitwiseAND(bits) != 0 if bank(name)[3] else mask.bitwiseAND(F.lit(field(name))) == bits
    return F.coalesce(here, F.lit(False))


def get(mask: Column, name: str, count: int) -> Column:
    """The slot of a list of `count` slots; -1 for none or an unknown one, -2 for several flags."""
    _, width, offset, flags = bank(name)
    value = F.shiftright(mask.bitwiseAND(F.lit(field(name))), offset)
    if not flags:
        return F.when((value == 0) | (value > count), -1).otherwise(value - 1).cast("bigint")
    known = (1 << count) - 1
    slots = reduce(lambda rest, s: F.when(value == (1 << s), s).otherwise(rest), range(width), F.lit(-2))
    return F.when((value == 0) | (value.bitwiseAND(F.lit(~known)) != 0), -1).otherwise(slots).cast("bigint")


def clear(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(F.lit(~field(name)))


def merged(masks: DataFrame, key: str, mask: str) -> DataFrame:
    """(key, mask): all masks of a key together; null where two numbers of one bank differ or unknown bits are set."""
    known = sum(field(b[0]) for b in BANKS)
    values = [F.countDistinct(F.when(F.col(mask).bitwiseAND(F.lit(field(b[0]))) != 0, F.col(mask).bitwiseAND(F.lit(field(b[0]))))).alias("n_" + b[0]) for b in BANKS if not b[3]]
    sums = masks.groupBy(key).agg(F.bit_or(mask).alias("all"), *values)
    fine = reduce(lambda a, b: a & b, [F.col("n_" + b[0]) <= 1 for b in BANKS if not b[3]])
    return sums.select(key, F.when(fine & (F.col("all").bitwiseAND(F.lit(~known)) == 0), F.col("all")).alias("mask"))


def lookup(rows: DataFrame, slots: DataFrame, on: list[str]) -> DataFrame:
    """Rows with the live slot they name, null columns where there is none: retired slots can't be seen."""
    return rows.join(slots.where("status = 'live'").drop("status"), on, "left")


def crosswalk(rows: DataFrame, links: DataFrame, from_list: str, to_list: str) -> DataFrame:
    """Rows (slot, ...) with each slot of `to_list` that theirs is mapped to, null for none."""
    some = links.where((F.col("from_list") == from_list) & (F.col("to_list") == to_list)).select(F.col("from_slot").alias("slot"), "to_slot")
    return rows.join(some, "slot", "left")


def resolve(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows (namespace, key, ...) with targets, sorted, and target, null unless there is exactly one."""
    found = keys.groupBy("namespace", "key").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    out = rows.join(found, ["namespace", "key"], "left")
    return out.withColumn("target", F.when(F.size("targets") == 1, F.get("targets", F.lit(0))))


def identifier(parts: Column) -> Column:
    """How an entry is shown: its one part, or all in brackets."""
    return F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]")))


def faults(entries: DataFrame) -> DataFrame:
    """What forbids publishing a section of (slot, id): repeated slots, gaps, repeated ids. No rows: it may be published."""
    slots = entries.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("slot").alias("fault"), F.col("slot").cast("string").alias("what"))
    ids = entries.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("id").alias("fault"), F.col("id").cast("string").alias("what"))
    span = entries.agg(F.count("*").alias("n"), F.max("slot").alias("top")).where("n > 0 and top <> n - 1").select(F.lit("gap").alias("fault"), F.col("top").cast("string").alias("what"))
    return slots.union(ids).union(span)
