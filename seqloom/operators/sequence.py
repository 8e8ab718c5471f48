"""Ordered rows: neighbours, islands, sessions, n-grams. Every window has a partition; nothing orders a whole table at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def along(stream: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*stream).orderBy(*order)


def pairs(df: DataFrame, stream: list[str], order: list[str], symbol: str) -> DataFrame:
    """Each symbol with the next one of its stream, as `to`; a stream's last symbol has no pair."""
    return df.withColumn("to", F.lead(symbol).over(along(stream, order))).filter(F.col("to").isNotNull()).withColumnRenamed(symbol, "from")


def islands(df: DataFrame, stream: list[str], order: list[str], keys: list[str], name: str = "seg") -> DataFrame:
    """Numbers, from 0, the maximal runs of equal keys."""
    w = along(stream, order)
    new = F.lit(False)
    for k in keys:
        new = new | ~F.col(k).eqNullSafe(F.lag(k).over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn("_new", (new & ~first).cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sessions(df: DataFrame, stream: list[str], at: str, gap: float, ties: list[str], name: str = "cluster") -> DataFrame:
    """Numbers, from 0, the runs of rows of which each starts at most `gap` after the one before."""
    w = along(stream, [at, *ties])
    far = (F.col(at) - F.lag(at).over(w) > F.lit(gap)).cast("int")
    return df.withColumn("_far", F.coalesce(far, F.lit(0))).withColumn(name, F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_far")


def run_lengths(df: DataFrame, stream: list[str], order: list[str], symbol: str) -> DataFrame:
    """stream, seg, symbol, start (first order value), length of every run."""
    runs = islands(df, stream, order, [symbol])
    return runs.groupBy(*stream, "seg", symbol).agg(F.min(order[0]).alias("start"), F.count("*").alias("length"))


def ngrams(df: DataFrame, stream: list[str], order: list[str], symbol: str, n: int) -> DataFrame:
    """stream, ngram: the joined symbols of each n rows in a row."""
    w = along(stream, order)
    cols = [F.lead(symbol, k).over(w) for k in range(n)]
    whole = df.select(*stream, F.array(*cols).alias("g"), cols[-1].alias("_last")).filter(F.col("_last").isNotNull())
    return whole.select(*stream, F.array_join("g", ">").alias("ngram"))


def sliding(df: DataFrame, at: str, window: int, step: int, name: str = "win") -> DataFrame:
    """One row for each window [name * step, name * step + window) that holds the row; at counts from 0."""
    first = F.greatest(F.lit(0), F.floor((F.col(at) - window) / step) + 1)
    return df.withColumn(name, F.explode(F.sequence(first.cast("long"), F.floor(F.col(at) / step).cast("long"))))


def rank_within(df: DataFrame, stream: list[str], by: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each stream by an order, numbered."""
    w = Window.partitionBy(*stream).orderBy(*by)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
