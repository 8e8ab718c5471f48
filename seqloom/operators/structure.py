"""Hits, clusters, templates and state automata of ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sequence import along, sessions


def clusters(hits: DataFrame, stream: str, at: str, gap: float, ties: list[str], motif: str = "symbol", strand: str = "strand", unit: int = 1) -> DataFrame:
    """stream, cluster, start, end, span, n_hits, n_motifs, strand_set, template of runs of hits at most `gap` apart.

    The template is the ordered list of (offset in units, motif, strand), as text.
    """
    c = sessions(hits, [stream], at, gap, ties)
    c = c.withColumn("_start", F.min(at).over(Window.partitionBy(stream, "cluster")))
    part = F.struct(F.floor((F.col(at) - F.col("_start")) / unit).alias("o"), F.col(motif).alias("m"), F.col(strand).alias("s"))
    g = c.groupBy(stream, "cluster").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n_hits"), F.count_distinct(motif).alias("n_motifs"), F.array_join(F.sort_array(F.collect_set(strand)), "").alias("strand_set"), F.sort_array(F.collect_list(part)).alias("_t"))
    text = F.array_join(F.transform("_t", lambda p: F.concat_ws(":", p["o"].cast("string"), p["m"], p["s"])), "|")
    return g.select(stream, "cluster", "start", "end", (F.col("end") - F.col("start")).alias("span"), "n_hits", "n_motifs", "strand_set", text.alias("template"))


def templates(cl: DataFrame) -> DataFrame:
    """template, count, n_hits, n_motifs, strand_set, sha12, template_rank by frequency; equal ones in text order.

    Templates are ranked by range partitions, however many there are.
    """
    from .ranks import ranked

    g = cl.groupBy("template").agg(F.count("*").alias("count"), F.max("n_hits").alias("n_hits"), F.max("n_motifs").alias("n_motifs"), F.max("strand_set").alias("strand_set"))
    out = ranked(g.withColumn("sha12", F.left(F.sha2("template", 256), F.lit(12))), [F.col("count").desc(), F.col("template")], "template_rank")
    return out.withColumn("template_rank", F.col("template_rank").cast("int"))


def nearest_family(delta: Column, centers: list[int], tolerance: int) -> Column:
    """The signed name of the nearest center within the tolerance, else `other`; the first of equally near ones."""
    near = F.array_min(F.array(*[F.struct(F.abs(delta - c).alias("d"), F.lit(k).alias("k"), F.lit(f"{c:+d}").alias("name")) for k, c in enumerate(centers)]))
    return F.when(delta.isNull(), F.lit(None)).when(near["d"] <= tolerance, near["name"]).otherwise(F.lit("other"))


def phase_slot(at: Column, period: int, slots: int) -> Column:
    return F.least(F.lit(slots - 1), F.floor(F.pmod(at, F.lit(period)) / F.lit(float(period)) * slots)).cast("int")


def transitions(df: DataFrame, stream: str, at: str, ties: list[str], state: str, family: Column | None = None) -> DataFrame:
    """stream, from, delta, family, to: each row's state with the next one of its stream."""
    w = along([stream], [at, *ties])
    out = df.select(stream, F.col(state).alias("from"), (F.lead(at).over(w) - F.col(at)).alias("delta"), F.lead(state).over(w).alias("to")).filter(F.col("to").isNotNull())
    return out.withColumn("family", family if family is not None else F.lit("any"))


def conditional_rates(tr: DataFrame) -> DataFrame:
    """from, family, to, count and its share of the state, of state and family, and of the family, all over occurrences."""
    c = tr.groupBy("from", "family", "to").count()
    over = lambda *k: F.sum("count").over(Window.partitionBy(*k))
    n = F.col("count")
    return c.select("from", "family", "to", "count", (n / over("from")).alias("rate_from"), (n / over("from", "family")).alias("rate_from_family"), (n / over("family")).alias("share_of_family"))


def determinism(tr: DataFrame, keys: list[str]) -> DataFrame:
    """One row: weighted and mean top-1 share and mean entropy of `to` given keys."""
    c = tr.groupBy(*keys, "to").count()
    p = F.col("count") / F.sum("count").over(Window.partitionBy(*keys))
    g = c.select(*keys, "count", (-p * F.log2(p)).alias("_h")).groupBy(*keys).agg(F.max("count").alias("top"), F.sum("count").alias("n"), F.sum("_h").alias("h"))
    return g.agg((F.sum("top") / F.sum("n")).alias("weighted_top1"), F.avg(F.col("top") / F.col("n")).alias("mean_top1"), F.avg("h").alias("mean_entropy"), F.count("*").alias("groups"))


def gcd_of(values: Column) -> Column:
    """The greatest common divisor of an array of BIGINT, by Euclid's steps in nested folds."""

    def one(a: Column, b: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(92))  # enough for any two 64-bit numbers
        start = F.struct(F.abs(a).alias("x"), F.abs(b).alias("y"))
        end = F.aggregate(steps, start, lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.pmod(s["x"], F.when(s["y"] == 0, F.lit(1).cast("long")).otherwise(s["y"])).alias("y"))))
        return end["x"]

    return F.aggregate(values, F.lit(0).cast("long"), one)


