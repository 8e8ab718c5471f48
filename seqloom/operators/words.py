"""From a field to words, rules and steps: runs of one operator, their neighbours, and a plan made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import along, islands

# Effect classes, actions, and the bits of word, rule and step flags.
EFFECTS = ["unknown", "stable_attractor", "envelope_form", "phase_offset", "compression_gate", "cascade_band", "null_membrane_jump", "raw_dom_mismatch_zone", "transition_bridge"]
ACTIONS = ["hold", "transition", "membrane_cross", "compression_gate", "cascade", "stabilize"]
NULL_NEAR, MISMATCH, HIGH_LOCK, NARROW, HIGH_SCORE = (1 << k for k in range(5))
RAW_CHANGE, DOM_CHANGE, EFFECT_CHANGE, CROSSES_ZERO, NULL_TO_COMPRESSION, COMPRESSION_TO_NULL, LOCK_BRIDGE, SCORE_RISE, SCORE_FALL, REWIRE = (1 << k for k in range(10))
CAUSAL = NULL_TO_COMPRESSION | COMPRESSION_TO_NULL | CROSSES_ZERO | REWIRE
CHANGES = RAW_CHANGE | DOM_CHANGE | EFFECT_CHANGE


def effect_id(name: str) -> int:
    """By name, whatever its case, with - or blanks for _."""
    return EFFECTS.index(name.strip().lower().replace("-", "_").replace(" ", "_"))


def bits(flags: dict[int, Column]) -> Column:
    out = F.lit(0)
    for bit, on in flags.items():
        out = out.bitwiseOR(F.when(on, F.lit(bit)).otherwise(F.lit(0)))
    return out


def regions(field: DataFrame, stream: list[str], order: str, keys: tuple[str, ...] = ("raw", "dom")) -> DataFrame:
    """field with `seg`, the number of its row's maximal run of equal keys."""
    return islands(field, stream, [order], list(keys))


def words(field: DataFrame, stream: list[str], order: str, dx: float) -> DataFrame:
    """One row for each region: its span and the statistics of lock, score and the five operators; then effect and flags."""
    f = regions(field, stream, order)
    five = range(1, 6)
    w = f.groupBy(*stream, "seg").agg(
        F.min(order).alias("i0"), F.max(order).alias("i1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("raw").alias("raw"), F.min("dom").alias("dom"), F.count("*").alias("sample_count"),
        *[g(c).alias(f"{n}_{m}") for n, c in (("lock", "lock"), ("score", "dom_score")) for m, g in (("min", F.min), ("max", F.max), ("mean", F.avg))], F.avg("ek").alias("ek_mean"), F.avg("ak").alias("ak_mean"),
        F.array(*[F.avg(f"k{j}") for j in five]).alias("k_mean"), F.array(*[F.max(F.abs(f"k{j}")) for j in five]).alias("k_absmax"), F.array(*[F.avg(f"s{j}") for j in five]).alias("s_mean"), F.array(*[F.max(F.abs(f"s{j}")) for j in five]).alias("s_absmax"),
    )
    w = w.withColumn("width", F.col("x1") - F.col("x0"))
    eps = max(4 * dx, 1e-12)
    zero = (F.abs("x0") <= eps) | (F.abs("x1") <= eps) | ((F.col("x0") <= 0) & (F.col("x1") >= 0))
    narrow = (F.col("sample_count") <= 3) | (F.abs("width") <= 3 * dx)
    dom, raw = F.col("dom"), F.col("raw")
    jump = zero & ((F.col("k_absmax")[0] > 1e6) | (F.col("score_max") > 10) | (raw == 1) | dom.isin(1, 4))
    rules = [
        ("null_membrane_jump", jump), ("transition_bridge", narrow), ("compression_gate", (dom == 4) | (F.col("s_absmax")[3] >= 1)), ("cascade_band", (dom == 5) | (F.col("s_absmax")[4] >= 1)),
        ("stable_attractor", ((dom == 1) | (raw == 1)) & (F.col("lock_mean") >= 0.99)), ("envelope_form", dom == 2), ("phase_offset", dom == 3), ("raw_dom_mismatch_zone", raw != dom),
    ]
    effect = F.lit(0)
    for name, on in reversed(rules):
        effect = F.when(on, F.lit(effect_id(name))).otherwise(effect)
    flags = bits({NULL_NEAR: zero, MISMATCH: raw != dom, HIGH_LOCK: F.col("lock_mean") >= 0.99, NARROW: narrow, HIGH_SCORE: F.col("score_max") >= 10})
    return w.withColumns({"effect": effect, "flags": flags})


def rules(w: DataFrame, stream: list[str]) -> DataFrame:
    """Each word with the next one of its stream: what changes, where, and how strongly."""
    names = ["x0", "x1", "raw", "dom", "effect", "lock_mean", "score_mean"]
    ahead = along(stream, ["seg"])
    r = w.select(*stream, F.col("seg").alias("sequence_index"), *[F.col(c).alias(f"from_{c}") for c in names], *[F.lead(c).over(ahead).alias(f"to_{c}") for c in names]).filter("to_raw IS NOT NULL")
    a, b = (lambda c: F.col(f"from_{c}")), (lambda c: F.col(f"to_{c}"))
    null, gate = effect_id("null_membrane_jump"), effect_id("compression_gate")
    r = r.withColumn("flags", bits({
        RAW_CHANGE: a("raw") != b("raw"), DOM_CHANGE: a("dom") != b("dom"), EFFECT_CHANGE: a("effect") != b("effect"), CROSSES_ZERO: ((a("x0") <= 0) & (b("x1") >= 0)) | ((a("x1") < 0) & (b("x0") > 0)),
        NULL_TO_COMPRESSION: (a("effect") == null) & (b("effect") == gate), COMPRESSION_TO_NULL: (a("effect") == gate) & (b("effect") == null), LOCK_BRIDGE: (a("lock_mean") >= 0.99) & (b("lock_mean") >= 0.99),
        SCORE_RISE: b("score_mean") > a("score_mean"), SCORE_FALL: b("score_mean") < a("score_mean"), REWIRE: (a("raw") != a("dom")) != (b("raw") != b("dom")),
    }))
    weights = [(RAW_CHANGE, 0.5), (DOM_CHANGE, 0.75), (EFFECT_CHANGE, 1.0), (CROSSES_ZERO, 2.0), (NULL_TO_COMPRESSION, 1.5), (COMPRESSION_TO_NULL, 1.5), (REWIRE, 0.5)]
    s = F.abs(b("lock_mean") - a("lock_mean")) + F.log1p(F.abs(b("score_mean") - a("score_mean")))
    for bit, weight in weights:
        s = s + F.when(has("flags", bit), F.lit(weight)).otherwise(F.lit(0.0))
    return r.withColumns({"boundary_x": (a("x1") + b("x0")) * 0.5, "gap_x": b("x0") - a("x1"), "delta_lock": b("lock_mean") - a("lock_mean"), "delta_score": b("score_mean") - a("score_mean"), "strength": s})


def has(flags: str, mask: int) -> Column:
    """Is any bit of the mask set?"""
    return F.col(flags).bitwiseAND(F.lit(mask)) != 0


def steps(r: DataFrame) -> DataFrame:
    """Executable steps of rules: action, drive, gain, bias, duration."""
    to = F.col("to_effect")
    action = F.when(has("flags", CROSSES_ZERO), 2).when(to == 4, 3).when(to == 5, 4).when(to == 1, 5).when(has("flags", CHANGES), 1).otherwise(0)
    return r.withColumns({
        "action": action, "causal": has("flags", CAUSAL), "x_start": F.col("from_x0"), "x_end": F.col("to_x1"), "drive_x": F.col("boundary_x"), "gain": F.log1p(F.abs("strength")),
        "bias": (F.col("from_lock_mean") + F.col("to_lock_mean")) * 0.5, "duration": F.abs(F.col("to_x1") - F.col("from_x0")),
    })


def sample_path(s: DataFrame, samples: int, mode: str) -> DataFrame:
    """`samples` points x of each step, j from 0: straight from start to end, by its boundary, or pulled by its drive."""
    u = F.col("j") / float(max(1, samples - 1))
    a, b, m = F.col("x_start"), F.col("x_end"), F.col("boundary_x")
    if mode == "linear":
        x = a + (b - a) * u
    elif mode == "boundary":
        x = F.when(u <= 0.5, a + (m - a) * u * 2).otherwise(m + (b - m) * (u - 0.5) * 2)
    elif mode == "drive":
        x = F.col("drive_x") + F.tanh((u * 2 - 1) * F.greatest(F.lit(0.0), F.col("gain"))) * F.abs(b - a) * 0.5
        x = F.least(F.greatest(x, F.least(a, b)), F.greatest(a, b))
    else:
        raise ValueError(mode)
    return s.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("x", x)
