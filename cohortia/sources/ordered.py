"""Tables stored in a total order, with row positions, without a global window.

Rows are range partitioned and sorted inside each partition. The position
inside a partition is written with the row; the rows of all earlier partitions
are found from one count per partition, so a row number needs neither a single
task nor the driver. Writing the table fixes the partition borders, which a
recomputed plan could draw differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART, POSITION = "part_no", "position"
_POSITION_BITS = 33  # layout of monotonically_increasing_id


def write_ordered(df: DataFrame, order: list[str], path: str) -> None:
    quoted = [f"`{name}`" for name in order]
    row = F.monotonically_increasing_id()
    (
        df.repartitionByRange(*quoted).sortWithinPartitions(*quoted)
        .withColumn("row_id", row)
        .withColumn(PART, F.shiftright("row_id", _POSITION_BITS).cast("int"))
        .withColumn(POSITION, F.col("row_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("row_id")
        .write.parquet(path)
    )


def part_starts(rows: DataFrame) -> DataFrame:
    """Rows before each partition; as many rows as the table has partitions."""
    counts = rows.groupBy(PART).agg(F.count("*").alias("n"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(PART, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))


def with_row_numbers(rows: DataFrame, name: str = "row_no") -> DataFrame:
    """Row numbers from 0 in stored order."""
    numbered = rows.join(F.broadcast(part_starts(rows)), PART)  # one row per stored partition
    return numbered.withColumn(name, F.col("rows_before") + F.col(POSITION)).drop(
        "rows_before", PART, POSITION)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
