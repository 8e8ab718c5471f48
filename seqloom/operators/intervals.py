"""Half-open intervals: overlap joins, of crowded groups by bins of several levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def overlap_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


#: A bin of one level is 2 ** STEP bins of the one below.
STEP = 3

#: Intervals of both sides together, up to which a group is one bin.
WHOLE = 2048


def _level(first: Column, last: Column, levels: int) -> Column:
    """The highest level whose bins are no wider than the bins first..last of level 0."""
    return sum((F.when(last - first + 1 >= 2 ** (STEP * k), 1).otherwise(0) for k in range(1, levels + 1)), F.lit(0))


def _cover(first: Column, last: Column, levels: int) -> Column:
    """(level, bin) of the bins of one level that hold the bins first..last of level 0: at most 2 ** STEP + 1, however long that is."""
    level = _level(first, last, levels)
    of = lambda at: F.call_function("shiftright", at, level * STEP)
    return F.transform(F.sequence(of(first), of(last)), lambda x: F.struct(level.alias("level"), x.alias("bin")))


def _chain(at: Column, levels: list[int]) -> Column:
    """(level, bin) of the bin of each level that holds bin `at` of level 0."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(at, STEP * k).alias("bin")) for k in levels or [0]])


def _binned(a: DataFrame, b: DataFrame, group: list[str], width: int) -> DataFrame:
    """Pairs of a and b that overlap, each once, by bins of several levels.

    Of two intervals that overlap the later start lies in the other interval. So starts of one side meet covers of the
    other, and the other way round with starts that are later. A cover is of the level that fits the interval's length, and
    a start is in one bin of each level that the other side has, so that it lies in just one bin of a cover, which makes each
    pair once. A cover's bins reach less than an interval's length beyond it on either side. A crowded bin splits like any
    skewed equi-join. Both sides are shuffled: Spark sizes a table of bins like the intervals they came from, and would
    broadcast many times that.
    """
    at = lambda c: F.floor(F.col(c) / width).cast("long")
    last = lambda c: F.floor((F.col(c) - 1) / width).cast("long")
    most = 62 // STEP
    used = lambda df, x, y: df.agg(F.sort_array(F.collect_set(_level(at(x), last(y), most))).alias("n"))
    in_a, in_b = (r["n"] for r in used(a, "start", "end").withColumn("_side", F.lit(0)).unionByName(used(b, "r_start", "r_end").withColumn("_side", F.lit(1))).orderBy("_side").collect())
    flat = lambda df, bins: df.withColumn("_b", F.explode(bins)).select("*", F.col("_b.level").alias("_level"), F.col("_b.bin").alias("_bin")).drop("_b")
    key = [*group, "_level", "_bin"]
    cover_a, cover_b = flat(a, _cover(at("start"), last("end"), max(in_a, default=0))), flat(b, _cover(at("r_start"), last("r_end"), max(in_b, default=0)))
    start_a, start_b = flat(a, _chain(at("start"), in_b)), flat(b, _chain(at("r_start"), in_a))
    within = lambda x, lo, hi, after: (F.col(x) > F.col(lo) if after else F.col(x) >= F.col(lo)) & (F.col(x) < F.col(hi))
    one = cover_a.join(start_b.hint("merge"), key).filter(within("r_start", "start", "end", False))
    two = start_a.join(cover_b.hint("merge"), key).filter(within("start", "r_start", "r_end", True))
    return one.unionByName(two).drop("_level", "_bin")


def overlaps(left: DataFrame, right: DataFrame, group: list[str], width: int) -> DataFrame:
    """Pairs of left(group, start, end, *) and right(group, r_start, r_end, *) that overlap, with `overlap`, each pair once.

    Groups of at most WHOLE intervals meet whole: an interval moves once, and less than WHOLE others are held against it.
    Groups of more are listed, a row each, and their intervals meet by bins, the lowest `width` wide.
    """
    a, b = left.filter(F.col("end") > F.col("start")), right.filter(F.col("r_end") > F.col("r_start"))
    sizes = a.select(*group).unionByName(b.select(*group)).dropna().groupBy(*group).agg(F.count("*").alias("_n"))
    crowded = checkpointed(sizes.filter(F.col("_n") > WHOLE).select(*group))
    some = not crowded.isEmpty()
    few_a, few_b = (df.join(crowded, group, "left_anti") if some else df for df in (a, b))
    pairs = few_a.join(few_b.hint("merge"), group).filter((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")))
    if some:
        pairs = pairs.unionByName(_binned(a.join(crowded, group, "left_semi"), b.join(crowded, group, "left_semi"), group, width))
    return pairs.withColumn("overlap", overlap_length(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, tolerance: int | None = None) -> DataFrame:
    """left with the right side's latest value at or before each row, by key: one union and one running window, no join."""
    from pyspark.sql.window import Window

    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(*keys, at, F.struct(F.col(at).alias("at"), F.col(value).alias("v")).alias("_r")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_l", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    near = F.lit(True) if tolerance is None else F.col(at) - F.col("_l")["at"] <= tolerance
    return out.withColumn(f"asof_{value}", F.when(near, F.col("_l")["v"])).drop("_side", "_r", "_l")
