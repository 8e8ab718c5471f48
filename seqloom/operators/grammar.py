"""Transition grammars: edges of symbol streams, what they predict, and how one stream's grammar fits another's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stats import safe_ratio


def split_point(n: str, share: float) -> Column:
    """Symbols of a stream of n that train: the share rounded down, at least 4 and at most n - 2."""
    return F.least(F.greatest(F.floor(F.col(n) * share), F.lit(4)), F.col(n) - 2).cast("long")


def edges(pairs: DataFrame, stream: list[str], at: str | None = None) -> DataFrame:
    """stream, from, to, count (and first, the smallest `at`)."""
    aggs = [F.count("*").alias("count")] + ([F.min(at).alias("first")] if at else [])
    return pairs.groupBy(*stream, "from", "to").agg(*aggs)


def coupling(train: DataFrame, test: DataFrame) -> DataFrame:
    """row, col, test_transitions, hits, kgram_accuracy, out_of_grammar, surprise_rate.

    train(stream, from, to) are the edges of each grammar; test(stream, from, to, count) the test pairs of each stream,
    counted before the join, so that it meets distinct pairs and not occurrences. Every row meets every column, a matrix
    of streams; a pair of them without a common edge has no hit.
    """
    cols = train.select(F.col("stream").alias("col")).distinct()
    known = train.select(F.col("stream").alias("col"), "from", "to").distinct()
    hits = test.withColumnRenamed("stream", "row").join(known, ["from", "to"]).groupBy("row", "col").agg(F.sum("count").alias("hits"))
    return coupling_cells(test, cols, hits)


def coupling_cells(test: DataFrame, cols: DataFrame, hits: DataFrame) -> DataFrame:
    """coupling's rows from test(stream, count), the columns cols(col) and hits(row, col, hits) of cells that have any."""
    rows = test.groupBy(F.col("stream").alias("row")).agg(F.sum("count").alias("test_transitions"))
    out = rows.crossJoin(cols).join(hits, ["row", "col"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    oog = F.col("test_transitions") - F.col("hits")
    return out.select("row", "col", "test_transitions", "hits", safe_ratio(F.col("hits"), F.col("test_transitions")).alias("kgram_accuracy"), oog.alias("out_of_grammar"), safe_ratio(oog, F.col("test_transitions")).alias("surprise_rate"))


def baseline(train_symbols: DataFrame, test: DataFrame) -> DataFrame:
    """stream, baseline_symbol, baseline_accuracy: how often the most frequent training symbol comes next in the test pairs."""
    w = Window.partitionBy("stream").orderBy(F.col("count").desc(), F.col("symbol"))
    best = train_symbols.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("stream", F.col("symbol").alias("baseline_symbol"))
    got = test.join(best, "stream").groupBy("stream", "baseline_symbol").agg(F.sum(F.when(F.col("to") == F.col("baseline_symbol"), F.col("count")).otherwise(0)).alias("_hit"), F.sum("count").alias("_n"))
    return got.select("stream", "baseline_symbol", safe_ratio(F.col("_hit"), F.col("_n")).alias("baseline_accuracy"))


def successors(edge_counts: DataFrame, stream: list[str]) -> DataFrame:
    """stream, from, to, count: the most frequent successor of each state, the one that came first of equal ones."""
    w = Window.partitionBy(*stream, "from").orderBy(F.col("count").desc(), F.col("first"), F.col("to"))
    return edge_counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
