"""Row numbers over an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seqspark.shared import stored


def numbered(df: DataFrame, order: str, source: str | tuple[str, ...] | None = None, name: str = "_n") -> DataFrame:
    """``df`` with ``name``: 1, 2, .. in the order of ``order``, for each ``source`` (one or more columns) if given.

    Rows are ranged over partitions by source and order, so a large source is many tasks.  The table with each row's partition is written
    once, since a second evaluation may draw other borders.  A partition's rows are counted on from the counts of those before it.  Only a partition's
    first source can have rows in an earlier one, so one number for each partition is broadcast at most.
    """
    own = [source] if isinstance(source, str) else list(source or ())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(parts, *own, order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part", *own).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_part").alias("_of"), *(F.col(c).alias(f"_source{i}") for i, c in enumerate(own)), F.sum("_rows").over(earlier).alias("_before")).where("_before > 0")
    ranked = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part", *own).orderBy(order)))
    same = F.col("_part") == F.col("_of")
    for i, c in enumerate(own):
        same &= F.col(c).eqNullSafe(F.col(f"_source{i}"))
    rows = ranked.join(F.broadcast(starts), same, "left").withColumn(name, F.col("_rank") + F.coalesce("_before", F.lit(0)))
    return rows.drop("_part", "_of", "_before", "_rank", *(f"_source{i}" for i in range(len(own))))
