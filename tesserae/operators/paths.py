"""Run-length sequences: rows (seq, ord, id) become runs, and runs answer questions without being written out where possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def positions(rows: DataFrame) -> DataFrame:
    """(seq, pos, id): places from 0."""
    return rows.select("seq", (F.row_number().over(Window.partitionBy("seq").orderBy("ord")) - 1).cast("bigint").alias("pos"), "id")


def runs(rows: DataFrame) -> DataFrame:
    """(seq, vertex, start, id, run): maximal runs of equal neighbours, from rows in `ord` order."""
    w = Window.partitionBy("seq").orderBy("ord")
    fresh = ~F.col("id").eqNullSafe(F.lag("id").over(w)) | (F.row_number().over(w) == 1)
    marked = rows.select("seq", "ord", "id", (F.row_number().over(w) - 1).alias("pos"), fresh.cast("int").alias("fresh"))
    numbered = marked.withColumn("vertex", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("seq", "vertex").agg(F.min("pos").cast("bigint").alias("start"), F.first("id").alias("id"), F.count("*").alias("run"))


def paths(run_rows: DataFrame) -> DataFrame:
    """(seq, path): the runs of a sequence as an array of (id, run), in order."""
    gathered = F.array_sort(F.collect_list(F.struct("vertex", "id", "run")))
    return run_rows.groupBy("seq").agg(F.transform(gathered, lambda x: F.struct(x["id"].alias("id"), x["run"].alias("run"))).alias("path"))


def length(path: Column) -> Column:
    return F.aggregate(path, F.lit(0).cast("bigint"), lambda a, x: a + x["run"])


def keys(path: Column) -> Column:
    """Distinct ids, sorted: the keys of an inverted index."""
    return F.array_sort(F.array_distinct(F.transform(path, lambda x: x["id"])))


def holds(path: Column, ids: list, every: bool) -> Column:
    """Whether all, or any, of the ids stand in the path; of no ids, all do and none does."""
    own = F.transform(path, lambda x: x["id"])
    each = [F.array_contains(own, i) for i in ids]
    out = F.lit(every)
    for e in each:
        out = out & e if every else out | e
    return out


def times(run_rows: DataFrame, ids: list) -> DataFrame:
    """(seq, id, times): how often each given id stands in each sequence, zeros included."""
    wanted = F.explode(F.array(*(F.lit(i) for i in ids))).alias("id")
    asked = run_rows.select("seq").distinct().select("seq", wanted)
    found = run_rows.where(F.col("id").isin(ids)).groupBy("seq", "id").agg(F.sum("run").alias("times"))
    return asked.join(found, ["seq", "id"], "left").select("seq", "id", F.coalesce("times", F.lit(0)).cast("bigint").alias("times"))


def expand(path: Column, cap: int | None = None) -> Column:
    """The ids written out, at most `cap` of them."""
    out = F.flatten(F.transform(path, lambda x: F.array_repeat(x["id"], x["run"].cast("int"))))
    return out if cap is None else F.slice(out, 1, cap)


def expand_rows(run_rows: DataFrame) -> DataFrame:
    """(seq, pos, id): runs as rows, one for each repetition."""
    at = F.explode(F.sequence("start", F.col("start") + F.col("run") - 1))
    return run_rows.select("seq", at.alias("pos"), "id")


def middle_any(path: Column, ids: list) -> Column:
    """Whether one of the ids stands strictly between the first and the last place."""
    n = length(path)
    whole = F.aggregate(
        path,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("hit")),
        lambda a, x: F.struct((a["at"] + x["run"]).alias("at"), (a["hit"] | ((a["at"] + x["run"] > 1) & (a["at"] <= n - 2) & x["id"].isin(ids))).alias("hit")),
    )
    return (n >= 3) & whole["hit"]


def other_end(part: Column, at: Column) -> Column:
    """Index of a tuple's other end: the last if `at` is the first part, 0 if it is the last, -1 if neither or both."""
    first, last = F.get(part, F.lit(0)) == at, F.get(part, F.size(part) - 1) == at
    return F.when((F.size(part) < 2) | (first == last), -1).when(first, F.size(part) - 1).otherwise(0)


def middle_of_tuple(part: Column, ids: list) -> Column:
    """Whether one of the ids is a part that is neither first nor last."""
    return (F.size(part) > 2) & F.exists(F.slice(part, 2, F.greatest(F.size(part) - 2, F.lit(0))), lambda x: x.isin(ids))


def neighbours(rows: DataFrame, phrase: list, before: bool = False) -> DataFrame:
    """(seq, pos, id): what follows, or precedes, each occurrence of the phrase; occurrences may overlap."""
    w = Window.partitionBy("seq").orderBy("pos")
    matches, n = F.lit(True), len(phrase)
    for k, item in enumerate(phrase):
        matches = matches & (F.lead("id", k).over(w) == item if k else F.col("id") == item)
    beside = F.lag("id", 1).over(w) if before else F.lead("id", n).over(w)
    return rows.select("seq", "pos", matches.alias("hit"), beside.alias("beside")).where("hit and beside is not null").select("seq", "pos", F.col("beside").alias("id"))


def run_pairs(run_rows: DataFrame, low: int, high: int) -> DataFrame:
    """(a, b, gap, times): how often b stands `gap` places after a, for low <= gap <= high, over all sequences.

    Works on runs: two runs of a sequence meet at a gap in as many places as the shifted intervals overlap. A pair is
    only looked for where it can be: among the runs that begin at most `high` behind a run's end, found by bucket.
    """
    if low < 1 or low > high:
        raise ValueError("gaps must be from 1 on, in order")
    size = max(high, 1)
    end = F.col("start") + F.col("run")
    left = run_rows.select("seq", F.col("start").alias("s"), end.alias("e"), F.col("id").alias("a"))
    right = run_rows.select("seq", F.col("start").alias("t"), end.alias("f"), F.col("id").alias("b"))
    # a run and what is behind it: itself, or runs that begin within [end, end + high - 1]
    ahead = left.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("e") / size), F.floor((F.col("e") + high - 1) / size))))
    apart = ahead.join(right.withColumn("bucket", F.floor(F.col("t") / size)), ["seq", "bucket"]).where((F.col("t") >= F.col("e")) & (F.col("t") < F.col("e") + high))
    same = left.select("seq", "s", "e", "a", F.col("s").alias("t"), F.col("e").alias("f"), F.col("a").alias("b"))
    pairs = apart.select("s", "e", "a", "t", "f", "b").union(same.select("s", "e", "a", "t", "f", "b"))
    gaps = pairs.withColumn("gap", F.explode(F.sequence(F.lit(low), F.lit(high))))
    meet = F.least(F.col("e"), F.col("f") - F.col("gap")) - F.greatest(F.col("s"), F.col("t") - F.col("gap"))
    return gaps.withColumn("m", meet).where("m > 0").groupBy("a", "b", "gap").agg(F.sum("m").alias("times"))


def enrich(left: DataFrame, right: DataFrame) -> DataFrame:
    """(seq, pos, id, said) of two annotated sequences (seq, pos, id, said) written out; sequences that conflict are absent.

    They agree if they have the same ids at the same places and no place has two different non-zero annotations; zero
    stands for no annotation and is filled in from the other side.
    """
    both = left.select("seq", "pos", F.col("id").alias("id_a"), F.col("said").alias("said_a")).join(right.select("seq", "pos", F.col("id").alias("id_b"), F.col("said").alias("said_b")), ["seq", "pos"], "full")
    wrong = F.col("id_a").isNull() | F.col("id_b").isNull() | (F.col("id_a") != F.col("id_b")) | ((F.col("said_a") != 0) & (F.col("said_b") != 0) & (F.col("said_a") != F.col("said_b")))
    bad = both.groupBy("seq").agg(F.max(F.coalesce(wrong, F.lit(True)).cast("int")).alias("bad")).where("bad = 0").select("seq")
    said = F.when(F.col("said_a") == 0, F.col("said_b")).otherwise(F.col("said_a"))
    return both.join(bad, "seq", "left_semi").select("seq", "pos", F.col("id_a").alias("id"), said.alias("said"))
