"""Numbers for rows in a total order, without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.operators.checkpoints import cut


def numbered(df: DataFrame, order: list[str], out: str = "n") -> DataFrame:
    """All rows with `out`: their place, from 0, in the order of these columns; ties are numbered in any order.

    Rows are dealt to ranges and sorted there; a row's number is its place in its range plus the sizes of the ranges
    before it. Only those sizes, a row for each partition, are summed in one place.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = placed.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_row")).drop("_part", "_row", "_at", "_start")
