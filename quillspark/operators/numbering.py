"""Consecutive numbers over a whole table, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.folders import scratch

PLACE = (1 << 33) - 1


def numbered(df: DataFrame, order: list[Column | str], name: str = "number", pieces: int | None = None) -> DataFrame:
    """df with ``name``: 1, 2, 3... in the given order, as row_number() over one window would give it.

    Rows are dealt by ranges of the order, sorted in each range and written with their place in it; a range's first number
    is the sum of the counts of those before it. Only these counts, one for each range, reach the driver. df is read twice
    (ranges are found from a sample). Rows the same in all of ``order`` share a range and are numbered in any order: give
    a key that tells rows apart. An empty table stays empty; a column called ``name`` is replaced."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "numbered")
    keys = [F.col(k) if isinstance(k, str) else k for k in order]
    dealt = df.drop(name).repartitionByRange(pieces, *keys) if pieces else df.drop(name).repartitionByRange(*keys)
    placed = dealt.sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    placed.write.option("compression", "zstd").parquet(path)
    held = spark.read.schema(placed.schema).parquet(path)
    counts = held.groupBy(F.shiftright("_place", 33).alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()
    firsts, upto = [], 0
    for r in sorted(counts, key=lambda r: r["range"]):
        firsts.append((r["range"], upto + 1))
        upto += r["n"]
    first = spark.createDataFrame(firsts, "_range long, _first long")
    # One row for each range.
    joined = held.join(F.broadcast(first), F.shiftright("_place", 33) == F.col("_range"))
    return joined.withColumn(name, F.col("_first") + F.col("_place").bitwiseAND(F.lit(PLACE))).drop("_place", "_range", "_first")
