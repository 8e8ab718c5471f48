"""Statistics of counts: entropies, masses, information, null-model scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def entropy(counts: DataFrame, groups: list[str], count: str = "count", base: float | None = 2.0) -> DataFrame:
    """groups, entropy of the counts in bits (base None: nats), total, kinds."""
    total = F.sum(count).over(Window.partitionBy(*groups))
    p = F.col(count) / total
    log = F.log2(p) if base == 2.0 else F.ln(p)
    return counts.select(*groups, F.col(count), (-p * log).alias("_h")).groupBy(*groups).agg(F.sum("_h").alias("entropy"), F.sum(count).alias("total"), F.count("*").alias("kinds"))


def top_mass(counts: DataFrame, groups: list[str], tops: list[int], key: str, count: str = "count") -> DataFrame:
    """groups and, for each n of tops, the share of the n most frequent kinds."""
    w = Window.partitionBy(*groups).orderBy(F.col(count).desc(), F.col(key))
    ranked = counts.withColumn("_r", F.row_number().over(w))
    return ranked.groupBy(*groups).agg(*[(F.sum(F.when(F.col("_r") <= n, F.col(count)).otherwise(0)) / F.sum(count)).alias(f"top{n}_mass") for n in tops])


def mode_of(counts: DataFrame, groups: list[str], value: str, count: str = "count") -> DataFrame:
    """groups, value, count: the most frequent value, the smallest of equal ones."""
    w = Window.partitionBy(*groups).orderBy(F.col(count).desc(), F.col(value))
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*groups, value, count)


def mutual_information(counts: DataFrame, groups: list[str], left: list[str], right: list[str], count: str = "count") -> DataFrame:
    """groups, mi: bits that left tells about right."""
    over = lambda *c: F.sum(count).over(Window.partitionBy(*groups, *c))
    n, a, b = over(), over(*left), over(*right)
    c = F.col(count)
    term = c / n * F.log2(c * n / (a * b))
    return counts.select(*groups, term.alias("_t")).groupBy(*groups).agg(F.sum("_t").alias("mi"))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def null_scores(replicates: DataFrame, observed: DataFrame, key: str = "metric", low: tuple[str, ...] = ()) -> DataFrame:
    """key, observed, null_mean, null_sd (population), z, p of replicates(key, value) against observed(key, value).

    p counts the replicates that reach the observation, each side with one more; keys in low reach it from above, by a
    value as low. Without spread z is infinite above the null's one value, else 0.
    """
    extreme = F.when(F.col(key).isin(*low), F.col("value") <= F.col("observed")).otherwise(F.col("value") >= F.col("observed"))
    both = replicates.join(observed.select(key, F.col("value").alias("observed")), key)
    out = both.groupBy(key, "observed").agg(F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_sd"), F.sum(extreme.cast("int")).alias("_ge"), F.count("*").alias("iterations"))
    d = F.col("observed") - F.col("null_mean")
    z = F.when(F.col("null_sd") > 0, d / F.col("null_sd")).when(d <= 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    return out.select(key, "observed", "null_mean", "null_sd", z.alias("z"), ((F.col("_ge") + 1) / (F.col("iterations") + 1)).alias("p"), "iterations")
