"""Mixing sources to target weights with hash-threshold histograms (DataFrame operations only).

Every source gets a target number of words. A document is taken whole as often as its source's target covers the
source whole, and once more if its hash lies under the source's threshold. The threshold comes from histograms: words
by source and hash bucket give the one bucket in which the budget ends; only that bucket is cut finer, until it holds
one hash value, and a filter by the threshold then takes the documents. No documents are sorted.

The hash is the first 60 bits of the md5 of the key, so that a rerun or another engine takes the same documents.

Defined results: a null text has size 0; a null source is a source, last in order; rows with equal keys and source share
a hash and are taken together; sources without words have target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Bits of a hash, and bits by which each round of histograms cuts the boundary bucket finer.
BITS, STEP = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def hash60(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target for the distinct sources of sizes(source, source_size).

    Targets share `share` of all words by weight; none is above `most` times its source, and what that cuts off goes to
    the others by weight until none is above. With sources in the order of source_size * most / weight the capped ones
    come first, so running sums give each source's level in one pass: it is capped if its cap is below the level at
    which it and all after it would be filled.

    The windows see one row per source, which the aggregation below them has made.
    """
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    s = sizes.withColumn("w", weight).withColumn("cap", cap).withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("w_left", F.sum("w").over(everything) - F.col("w_before"))
    s = s.withColumn("capped", F.col("cap") * F.col("w_left") <= F.col("w") * (F.col("total") - F.col("cap_before")))
    s = s.withColumn("cap_sum", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0)))
    s = s.withColumn("w_sum", F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * (F.col("total") - F.col("cap_sum")) / F.col("w_sum"))
    return s.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, times, below: documents are taken `times` times, those with a hash under `below` once more.

    Each round sums the words of the boundary bucket by the next STEP bits of the hash. The last bucket holds one hash
    value; it is taken if that brings the source's words at least as near to the target as leaving it.
    """
    open_ = targets.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    open_ = open_.withColumn("left", F.col("target") - F.col("times") * F.col("source_size")).withColumn("at", F.lit(0).cast("long"))
    hist = Window.partitionBy("source").orderBy("bucket")
    for shift in range(BITS - STEP, -1, -STEP):
        inside = rows.join(open_.select(F.col("source").alias("s"), "at"), F.col("source").eqNullSafe(F.col("s"))).filter(F.shiftright("hash", shift + STEP) == F.shiftright("at", shift + STEP))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = sums.withColumn("upto", F.sum("words").over(hist)).withColumn("upto_last", F.sum("words").over(Window.partitionBy("source")))
        run = run.join(open_.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
        full = (F.col("upto") <= F.col("left")) if shift else (F.col("upto") - F.col("left") <= F.col("left") - (F.col("upto") - F.col("words")))
        step = run.groupBy("source").agg(F.max(F.when(full, F.col("bucket"))).alias("whole"), F.sum(F.when(full, F.col("words"))).alias("spent"), F.min(F.when(~full, F.col("bucket"))).alias("edge"), F.max("bucket").alias("end"))
        step = step.withColumnRenamed("source", "s")
        open_ = open_.join(step, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "times", (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left"),
            F.coalesce(F.shiftleft("edge", shift), F.shiftleft(F.col("end") + 1, shift), "at").alias("at"),
        )
        open_ = cut(open_, "mix-level")
    return open_.select("source", "source_size", "target", "times", F.col("at").alias("below"))


def _times(most: float, size: Column, digest: Column) -> Column:
    """How often a document is taken. One without words costs nothing and would come with any threshold, so `most` bounds it."""
    times = F.col("times") + (digest < F.col("below")).cast("long")
    return F.when(size == 0, F.least(times, F.floor(F.lit(most)).cast("long"))).otherwise(times)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of docs: key, source, size, source_size, target, taken (words, repeats counted) and times."""
    rows = cut(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), _size(text).alias("size"), hash60(F.col(key)).alias("hash")), "mix")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = thresholds(rows, source_targets(sizes, weights, share, most)).withColumnRenamed("source", "s")
    times = _times(most, F.col("size"), F.col("hash"))
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    return out.select(F.col("key").alias(key), "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def _size(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with all its columns. The texts aren't shuffled."""
    docs = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), _size(text).alias("size"), hash60(F.col(key)).alias("hash"))
    rows = cut(docs.drop("row"), "mix")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = thresholds(rows, source_targets(sizes, weights, share, most)).select(F.col("source").alias("s"), "times", "below")
    out = docs.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("row", _times(most, F.col("size"), F.col("hash")).cast("int").alias("n")).filter("n > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
