"""Order over a whole table without one task that sees it: range partitions, counts of each, offsets added.

A table is divided by ranges of its order and written; from then on a row's place is its place in its own range and what the
ranges before it hold. Only one row for each range meets in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in ranges of the order, with _range: the number of a row's range. Rows of one order value are in one range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))


def _before(parts: DataFrame, what: str, name: str) -> DataFrame:
    """_range and the sum of `what` over the ranges before it; one row for each range."""
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_range", F.coalesce(F.sum(what).over(w), F.lit(0)).alias(name))


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its rows numbered from 1 by an order over the whole table."""
    rows = _ranged(df, order)
    starts = _before(rows.groupBy("_range").agg(F.count("*").alias("_n")), "_n", "_start")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, (F.col("_own") + F.col("_start")).cast("long")).drop("_own", "_start", "_range")


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the sum of `value` over all rows up to each one, and `{name}_of`: the sum over all."""
    rows = _ranged(df, order)
    parts = rows.groupBy("_range").agg(F.sum(value).alias("_n"))
    starts = _before(parts, "_n", "_start").crossJoin(F.broadcast(parts.agg(F.sum("_n").alias(f"{name}_of"))))  # one row
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, F.col("_own") + F.col("_start")).drop("_own", "_start", "_range")


def numbered_within(df: DataFrame, keys: list[str], part: Column, order: list[Column], name: str, size: str | None = None) -> DataFrame:
    """df with its rows numbered from 0 within keys, where keys may have any number of rows.

    `part` cuts a key's rows into pieces that follow each other in the order; a piece is the most that one window sees.
    With `size` the number of the key's rows is added.
    """
    rows = df.withColumn("_part", part)
    pieces = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_count"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.withColumn("_start", F.coalesce(F.sum("_count").over(w), F.lit(0)))
    if size is not None:
        starts = starts.withColumn(size, F.sum("_count").over(Window.partitionBy(*keys)))
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    out = rows.withColumn("_own", own).join(starts.drop("_count"), [*keys, "_part"])
    return out.withColumn(name, F.col("_own") + F.col("_start")).drop("_own", "_start", "_part")


def ring_neighbours(df: DataFrame, order: str, values: list[str]) -> DataFrame:
    """df with left_* and right_* of each value: the rows before and after in a ring, the last row's right one being the first row.

    Each range hands its two edge rows to the ranges beside it; nothing else crosses ranges.
    """
    rows = _ranged(df, [F.col(order)])
    held = F.struct(*values)
    edge = rows.groupBy("_range").agg(F.min_by(held, order).alias("first"), F.max_by(held, order).alias("last"))  # empty ranges have none
    w = Window.orderBy("_range")
    whole = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beside = edge.select("_range", F.coalesce(F.lag("last").over(w), F.last("last").over(whole)).alias("_l"), F.coalesce(F.lead("first").over(w), F.first("first").over(whole)).alias("_r"))
    own = Window.partitionBy("_range").orderBy(order)
    out = rows.withColumns({"_lag": F.lag(held).over(own), "_lead": F.lead(held).over(own)}).join(F.broadcast(beside), "_range")
    out = out.withColumns({"_l": F.coalesce("_lag", "_l"), "_r": F.coalesce("_lead", "_r")})
    for v in values:
        out = out.withColumns({f"left_{v}": F.col("_l")[v], f"right_{v}": F.col("_r")[v]})
    return out.drop("_lag", "_lead", "_l", "_r", "_range")
