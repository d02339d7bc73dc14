"""Dense ordinals without sending a whole group, or all rows, to one task.

row_number over an unpartitioned window sorts all rows in one task, and a hot stream does the same to its own. Here rows are
dealt by ranges of their whole order, group first, sorted within their partition and written; their places there are dense, so an ordinal is the
place within the partition plus the rows of the group in the partitions before. Only those counts, one row for each group and
partition, are summed up in a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import folder

#: Rows of a partition; up to so many rows, one window does.
ROWS_A_TASK = 200_000


def numbered(df: DataFrame, order: list[str], group: list[str] = (), name: str = "rn", start: int = 1) -> DataFrame:
    """df with dense ordinals within each group by the order columns, which must be unique within it."""
    group = list(group)
    # The size is needed before the plan is chosen: one pass without columns.
    rows = df.select(F.lit(1)).count()
    if rows <= ROWS_A_TASK:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long") + (start - 1))
    spark, path = df.sparkSession, folder(df.sparkSession)
    by = [*group, *order]
    dealt = df.repartitionByRange(-(-rows // ROWS_A_TASK), *by).sortWithinPartitions(*by)
    # The upper bits are the partition, the lower ones the place of the row in it.
    placed = dealt.withColumn("_id", F.monotonically_increasing_id())
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    shifts = counts.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_p"), shift)
    same = F.col("_part") == F.col("_p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return placed.join(shifts, same).select(*df.columns, (F.col("_place") + F.col("_shift") + start).alias(name))
