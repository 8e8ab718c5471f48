"""The five-operator numeric field: energy, attractor, lock and the strongest operator of a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .u64 import hash64, lit64

# Fixed values of the field.
A, B, C, D0, E0 = 0.579366, 1.93491, -0.431022, -3.01298, -0.0388623
EPS, EXP_LIMIT, HARD = 1e-12, 60.0, 1e100
SCALES = (1.70, 0.45, 0.006, 0.035, 0.55)
OFFSET_3 = 0.985
VARIANT_SALT = 0x4B444E415F564152
COARSE_SALT = 0x4B444E415F4B4558


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def log_abs(x: Column) -> Column:
    return F.ln(F.abs(x) + F.lit(EPS))


def exp_clamp(x: Column) -> Column:
    return F.exp(clamp(x, -EXP_LIMIT, EXP_LIMIT))


def safe_div(n: Column, d: Column) -> Column:
    """n / d with |d| at least EPS; the sign of a zero counts."""
    minus = (d < 0) | ((d == 0) & (d.cast("string") == "-0.0"))
    return n / (F.when(minus, F.lit(-1.0)).otherwise(F.lit(1.0)) * F.greatest(F.abs(d), F.lit(EPS)))


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(HARD)), x).otherwise(F.lit(0.0))


def first_argmax(values: list[Column]) -> Column:
    """1 for the first of the largest."""
    best = F.greatest(*values)
    out = F.lit(len(values))
    for k in range(len(values) - 1, 0, -1):
        out = F.when(values[k - 1] == best, F.lit(k)).otherwise(out)
    return out.cast("int")


def with_field(df: DataFrame, x: str = "x") -> DataFrame:
    """df with k1..k5, ek, ak, lock, raw, dom, s1..s5, dom_score of column x (DOUBLE)."""
    v = F.col(x)
    d = F.lit(D0) - F.tanh(F.lit(D0))
    exp_e = exp_clamp(F.lit(E0))
    wave = log_abs(v * F.cos(F.cos(exp_clamp(v))))
    df = df.withColumns({
        "k1": finite_or_zero(F.sin(exp_clamp(log_abs(F.lit(A)))) * safe_div(F.tanh(F.lit(B)), exp_clamp(safe_div(F.lit(A) - (v + F.tanh(v)), v)))),
        "k2": finite_or_zero(log_abs(exp_clamp(F.tanh(F.cos(v))) * v)),
        "k3": finite_or_zero(F.cos(F.lit(-C) * safe_div(F.cos(F.sin(safe_div(v * v, v))), d))),
        "k4": finite_or_zero(F.tanh(safe_div(F.sin(F.cos(v * exp_e)), exp_clamp(exp_clamp(v))) * wave)),
        "k5": finite_or_zero(F.tanh(safe_div((v + v * F.tanh(v)) * wave, d)) * exp_e),
    })
    k = [F.col(f"k{j}") for j in range(1, 6)]
    df = df.withColumns({"ek": F.sqrt(sum((c * c for c in k[1:]), k[0] * k[0])), "ak": sum((c * F.lit(float(j)) for j, c in enumerate(k[1:], 2)), k[0] * F.lit(1.0)) / F.lit(5.0)})
    s = [F.abs(c - F.lit(OFFSET_3) if j == 2 else c) / F.lit(SCALES[j]) for j, c in enumerate(k)]
    df = df.withColumns({"lock": F.tanh(F.col("ek") + F.abs("ak")), "raw": first_argmax([F.abs(c) for c in k]), **{f"s{j}": c for j, c in enumerate(s, 1)}})
    s = [F.col(f"s{j}") for j in range(1, 6)]
    return df.withColumns({"dom": first_argmax(s), "dom_score": F.greatest(*s)})


def raw_bin(x: Column, bins: int) -> Column:
    """Equal-width bin of [-1, 1]."""
    return F.least(F.floor(clamp((x + 1) * F.lit(0.5), 0.0, 1.0) * bins), F.lit(max(2, bins) - 1)).cast("int")


def variant_id(raw: Column, dom: Column, lock: Column, score: Column, k: list[Column]) -> Column:
    """Chained hash of quantised field values, as a BIGINT bit pattern."""
    q = lambda x: F.floor(x).cast("long")
    h = lit64(VARIANT_SALT).bitwiseXOR(raw.cast("long")).bitwiseXOR(F.shiftleft(dom.cast("long"), 8))
    h = hash64(h.bitwiseXOR(q(lock * 4096.0)))
    h = hash64(h.bitwiseXOR(F.shiftleft(q(F.log1p(F.abs(score)) * 2048.0), 1)))
    for j, c in enumerate(k):
        h = hash64(h.bitwiseXOR(q(F.tanh(c) * 32767.0)).bitwiseXOR(lit64(j << 56)))
    return h


def coarse_variant(raw: Column, dom: Column, lock: Column, score: Column, k: list[Column]) -> Column:
    """XOR of the hashes of coarsely quantised field values; 1 in place of 0."""
    q = lambda x: hash64(F.floor(x).cast("long"))
    h = lit64(COARSE_SALT).bitwiseXOR(hash64(raw.cast("long") + 0x11)).bitwiseXOR(hash64(F.shiftleft(dom.cast("long"), 8) + 0x22))
    parts = [lock * 32.0, F.log1p(F.abs(score)) * 16.0, F.log1p(F.abs(k[0])) * 8.0, k[1] * 16.0, k[2] * 16.0, k[3] * 24.0, k[4] * 16.0]
    for x in parts:
        h = h.bitwiseXOR(q(x))
    return F.when(h == 0, F.lit(1).cast("long")).otherwise(h)


# operators' numbers and effects' codes by name and short name.
EFFECTS = {
    "unknown": 0, "stable_attractor": 1, "attractor": 1, "envelope_form": 2, "envelope": 2, "phase_offset": 3, "phase": 3, "compression_gate": 4, "compression": 4,
    "cascade_band": 5, "cascade": 5, "null_membrane_jump": 6, "null": 6, "membrane": 6, "raw_dom_mismatch_zone": 7, "mismatch": 7, "transition_bridge": 8, "transition": 8,
}


def effect_code(name: Column) -> Column:
    """An effect's code from its name, short name or digit, in any case; null for anything else."""
    names = F.create_map(*[F.lit(x) for pair in EFFECTS.items() for x in pair])
    return F.coalesce(F.when(name.rlike("^[0-8]$"), name.try_cast("int")), F.try_element_at(names, F.lower(name)))


def operator_number(name: Column) -> Column:
    """1 to 5 from `K1` to `K5` in either case, or the digit alone; null for anything else."""
    return F.when(name.rlike("^[Kk]?[1-5]$"), F.right(name, F.lit(1)).cast("int"))


def project(symbol: Column, x_min: float, x_max: float, source_min: float | None = None, source_max: float | None = None) -> Column:
    """A symbol's place in [x_min, x_max]: by its hash, or in proportion to [source_min, source_max]."""
    from .u64 import unit

    if source_min is None or source_max is None:
        u = unit(hash64(symbol))
    else:
        u = clamp((symbol.cast("double") - F.lit(float(source_min))) / F.lit(float(source_max - source_min)), 0.0, 1.0)
    return F.lit(x_min) + u * F.lit(x_max - x_min)
