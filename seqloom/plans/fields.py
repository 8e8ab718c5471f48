"""The numeric field on a grid of each nation: evaluation, words, rules, steps and their selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.field import A, B, C, D0, E0, EPS, HARD, OFFSET_3, SCALES, raw_bin, with_field
from ..operators import words as W
from .catalog import query, t

N, DX = 401, 0.02


def grid(spark: SparkSession, d: str) -> DataFrame:
    """stream (nation), i, x: 401 points 0.02 apart; none at zero."""
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N - 1).cast("long")))
    return t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("stream"), i.alias("i")).withColumn("x", F.lit(-4.013) + F.col("stream") * F.lit(0.04) + F.col("i") * F.lit(DX))


GRID = f"grid AS (SELECT n_nationkey::BIGINT AS stream, i, -4.013::DOUBLE + n_nationkey * 0.04::DOUBLE + i * {DX}::DOUBLE AS x FROM nation, (SELECT unnest(range({N})) AS i))"


def _n(x: float) -> str:
    return f"({x!r})::DOUBLE"


def _exp(x: str) -> str:
    return f"exp(least(greatest({x}, -60::DOUBLE), 60::DOUBLE))"


def _log(x: str) -> str:
    return f"ln(abs({x}) + {_n(EPS)})"


def _div(a: str, b: str) -> str:
    return f"(({a}) / (CASE WHEN ({b}) < 0 THEN -1::DOUBLE ELSE 1::DOUBLE END * greatest(abs({b}), {_n(EPS)})))"


def _fin(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) AND abs({x}) < {_n(HARD)} THEN {x} ELSE 0 END)"


def _argmax(cols: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {c} = greatest({', '.join(cols)}) THEN {k}" for k, c in enumerate(cols, 1)) + " END"


_D, _E = f"({_n(D0)} - tanh({_n(D0)}))", _exp(_n(E0))
_WAVE = _log(f"x * cos(cos({_exp('x')}))")
FIELD = f"""{GRID}, f1 AS (SELECT *, {_fin(f"sin({_exp(_log(_n(A)))}) * {_div(f'tanh({_n(B)})', _exp(_div(f'{_n(A)} - (x + tanh(x))', 'x')))}")} AS k1,
  {_fin(_log(f"{_exp('tanh(cos(x))')} * x"))} AS k2, {_fin(f"cos({_n(-C)} * {_div(f'cos(sin({_div("x * x", "x")}))', _D)})")} AS k3,
  {_fin(f"tanh({_div(f'sin(cos(x * {_E}))', _exp(_exp('x')))} * {_WAVE})")} AS k4, {_fin(f"tanh({_div(f'(x + x * tanh(x)) * {_WAVE}', _D)}) * {_E}")} AS k5 FROM grid),
f2 AS (SELECT *, sqrt(k1 * k1 + k2 * k2 + k3 * k3 + k4 * k4 + k5 * k5) AS ek, (k1 + k2 * 2 + k3 * 3 + k4 * 4 + k5 * 5) / 5 AS ak,
  {', '.join(f"abs(k{j}{f' - {_n(OFFSET_3)}' if j == 3 else ''}) / {_n(SCALES[j - 1])} AS s{j}" for j in range(1, 6))} FROM f1),
field AS (SELECT *, tanh(ek + abs(ak)) AS lock, {_argmax([f'abs(k{j})' for j in range(1, 6)])} AS raw, {_argmax([f's{j}' for j in range(1, 6)])} AS dom, greatest(s1, s2, s3, s4, s5) AS dom_score FROM f2)"""


def field(spark: SparkSession, d: str) -> DataFrame:
    return with_field(grid(spark, d))


@query("s1_grid_scan", f"WITH {GRID} SELECT stream, i, round(x, 9) AS x FROM grid")
def s1(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, d).withColumn("x", F.round("x", 9))


_SHOWN = ["k2", "k3", "k4", "k5", "lock"]


@query("p1_field_eval", f"""WITH {FIELD} SELECT stream, i, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _SHOWN)}, round(ln(1 + abs(k1)), 6) AS k1_log, round(ln(1 + dom_score), 6) AS score_log, raw, dom FROM field""")
def p1(spark: SparkSession, d: str) -> DataFrame:
    f = field(spark, d)
    return f.select("stream", "i", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in _SHOWN], F.round(F.ln(F.abs("k1") + 1), 6).alias("k1_log"), F.round(F.ln(F.col("dom_score") + 1), 6).alias("score_log"), "raw", "dom")


@query("p6_raw_bins", f"WITH {GRID} SELECT least(floor(least(greatest((x + 1) * 0.5::DOUBLE, 0), 1) * 16), 15)::INT AS bin, count(*) AS count FROM grid GROUP BY 1")
def p6(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, d).groupBy(raw_bin(F.col("x"), 16).alias("bin")).count()


@query("a9_field_stats", f"""WITH {FIELD}, u AS (UNPIVOT (SELECT k2, k3, k4, k5, lock FROM field) ON k2, k3, k4, k5, lock INTO NAME name VALUE v)
SELECT name, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max, round(max(abs(v)), 6) AS maxabs, count(*) FILTER (NOT isfinite(v)) AS nonfinite FROM u GROUP BY 1""")
def a9(spark: SparkSession, d: str) -> DataFrame:
    u = field(spark, d).unpivot([], _SHOWN, "name", "v")
    r = lambda c: F.round(c, 6) + F.lit(0.0)
    return u.groupBy("name").agg(r(F.min("v")).alias("min"), r(F.max("v")).alias("max"), F.round(F.max(F.abs("v")), 6).alias("maxabs"), F.sum((F.isnan("v") | (F.abs("v") == float("inf"))).cast("int")).alias("nonfinite"))


WORDS = f"""{FIELD}, ch AS (SELECT *, CASE WHEN i > 0 AND (raw <> lag(raw) OVER w OR dom <> lag(dom) OVER w) THEN 1 ELSE 0 END AS new FROM field WINDOW w AS (PARTITION BY stream ORDER BY i)),
sg AS (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS seg FROM ch),
w0 AS (SELECT stream, seg, min(i) AS i0, max(i) AS i1, min(x) AS x0, max(x) AS x1, min(raw) AS raw, min(dom) AS dom, count(*) AS sample_count, min(lock) AS lock_min, max(lock) AS lock_max, avg(lock) AS lock_mean,
  max(dom_score) AS score_max, avg(dom_score) AS score_mean, avg(k2) AS k2_mean, max(abs(k1)) AS k1m, max(abs(s4)) AS s4m, max(abs(s5)) AS s5m, avg(ek) AS ek_mean FROM sg GROUP BY ALL),
w1 AS (SELECT *, x1 - x0 AS width, (abs(x0) <= {4 * DX} OR abs(x1) <= {4 * DX} OR (x0 <= 0 AND x1 >= 0)) AS zero, (sample_count <= 3 OR abs(x1 - x0) <= {3 * DX}::DOUBLE) AS narrow FROM w0),
words AS (SELECT *, CASE WHEN zero AND (k1m > 1e6 OR score_max > 10 OR raw = 1 OR dom IN (1, 4)) THEN 6 WHEN narrow THEN 8 WHEN dom = 4 OR s4m >= 1 THEN 4 WHEN dom = 5 OR s5m >= 1 THEN 5
  WHEN (dom = 1 OR raw = 1) AND lock_mean >= 0.99 THEN 1 WHEN dom = 2 THEN 2 WHEN dom = 3 THEN 3 WHEN raw <> dom THEN 7 ELSE 0 END AS effect,
  (zero::INT + 2 * (raw <> dom)::INT + 4 * (lock_mean >= 0.99)::INT + 8 * narrow::INT + 16 * (score_max >= 10)::INT) AS flags FROM w1)"""


def word_table(spark: SparkSession, d: str) -> DataFrame:
    return W.words(field(spark, d), ["stream"], "i", DX)


@query("w2_regions", f"WITH {WORDS} SELECT stream, seg, i0, i1, raw, dom, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM words")
def w2(spark: SparkSession, d: str) -> DataFrame:
    r = W.regions(field(spark, d), ["stream"], "i").groupBy("stream", "seg").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("raw").alias("raw"), F.min("dom").alias("dom"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    return r.withColumns({c: F.round(c, 6) for c in ("x0", "x1")})


@query("a7_words", f"""WITH {WORDS} SELECT stream, seg, sample_count, effect, flags, round(lock_min, 6) AS lock_min, round(lock_max, 6) AS lock_max, round(lock_mean, 6) AS lock_mean, round(ln(1 + score_max), 6) AS score_max_log,
round(ln(1 + score_mean), 6) AS score_mean_log, round(k2_mean, 6) + 0.0 AS k2_mean FROM words""")
def a7(spark: SparkSession, d: str) -> DataFrame:
    w = word_table(spark, d)
    return w.select("stream", "seg", "sample_count", "effect", "flags", *[F.round(c, 6).alias(c) for c in ("lock_min", "lock_max", "lock_mean")], *[F.round(F.ln(F.col(c) + 1), 6).alias(f"{c}_log") for c in ("score_max", "score_mean")], (F.round(F.col("k_mean")[1], 6) + F.lit(0.0)).alias("k2_mean"))


@query("p15_effect_classes", f"WITH {WORDS} SELECT effect, count(*) AS words, sum(sample_count)::BIGINT AS samples FROM words GROUP BY 1")
def p15(spark: SparkSession, d: str) -> DataFrame:
    return word_table(spark, d).groupBy("effect").agg(F.count("*").alias("words"), F.sum("sample_count").alias("samples"))


@query("f1_word_query", f"WITH {WORDS} SELECT stream, seg, effect FROM words WHERE dom = 4 AND lock_mean >= 0.9 AND score_max >= 2 AND abs(width) >= 0.05 AND abs(width) <= 5 AND (flags & 4) = 4")
def f1(spark: SparkSession, d: str) -> DataFrame:
    keep = (F.col("dom") == 4) & (F.col("lock_mean") >= 0.9) & (F.col("score_max") >= 2) & F.abs("width").between(0.05, 5) & (F.col("flags").bitwiseAND(F.lit(W.HIGH_LOCK)) == W.HIGH_LOCK)
    return word_table(spark, d).filter(keep).select("stream", "seg", "effect")


@query("t1_top_words", f"WITH {WORDS} SELECT stream, seg, round(ln(1 + score_mean), 6) AS score_log FROM words ORDER BY score_mean DESC, stream, seg LIMIT 16")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return word_table(spark, d).orderBy(F.col("score_mean").desc(), "stream", "seg").limit(16).select("stream", "seg", F.round(F.ln(F.col("score_mean") + 1), 6).alias("score_log"))


_PAIR = ["x0", "x1", "raw", "dom", "effect", "lock_mean", "score_mean"]
RULES = f"""{WORDS}, p AS (SELECT stream, seg AS sequence_index, {', '.join(f'{c} AS a_{c}, lead({c}) OVER w AS b_{c}' for c in _PAIR)} FROM words WINDOW w AS (PARTITION BY stream ORDER BY seg)),
r0 AS (SELECT *, (a_raw <> b_raw)::INT AS c1, (a_dom <> b_dom)::INT AS c2, (a_effect <> b_effect)::INT AS c3, ((a_x0 <= 0 AND b_x1 >= 0) OR (a_x1 < 0 AND b_x0 > 0))::INT AS c4, (a_effect = 6 AND b_effect = 4)::INT AS c5,
  (a_effect = 4 AND b_effect = 6)::INT AS c6, (a_lock_mean >= 0.99 AND b_lock_mean >= 0.99)::INT AS c7, (b_score_mean > a_score_mean)::INT AS c8, (b_score_mean < a_score_mean)::INT AS c9, ((a_raw <> a_dom) <> (b_raw <> b_dom))::INT AS c10 FROM p WHERE b_raw IS NOT NULL),
rules AS (SELECT *, {' + '.join(f'{1 << k} * c{k + 1}' for k in range(10))} AS flags, abs(b_lock_mean - a_lock_mean) + ln(1 + abs(b_score_mean - a_score_mean)) + 0.5 * c1 + 0.75 * c2 + c3 + 2.0 * c4 + 1.5 * c5 + 1.5 * c6 + 0.5 * c10 AS strength FROM r0)"""


def rule_table(spark: SparkSession, d: str) -> DataFrame:
    return W.rules(word_table(spark, d), ["stream"])


@query("p17_rules", f"WITH {RULES} SELECT stream, sequence_index, flags, a_effect AS from_effect, b_effect AS to_effect, round(0.5 * (a_x1 + b_x0), 6) AS boundary_x, round(strength, 5) AS strength FROM rules")
def p17(spark: SparkSession, d: str) -> DataFrame:
    return rule_table(spark, d).select("stream", "sequence_index", "flags", "from_effect", "to_effect", F.round("boundary_x", 6).alias("boundary_x"), F.round("strength", 5).alias("strength"))


@query("f2_rule_query", f"WITH {RULES} SELECT stream, sequence_index FROM rules WHERE (flags & 7) <> 0 AND ((flags & {W.CAUSAL}) <> 0 OR strength >= 1) AND strength >= 1.25 AND b_effect = 4")
def f2(spark: SparkSession, d: str) -> DataFrame:
    keep = W.has("flags", W.CHANGES) & (W.has("flags", W.CAUSAL) | (F.col("strength") >= 1)) & (F.col("strength") >= 1.25) & (F.col("to_effect") == 4)
    return rule_table(spark, d).filter(keep).select("stream", "sequence_index")


@query("f3_plan_rules", f"WITH {RULES} SELECT stream, sequence_index FROM rules WHERE (flags & {W.CAUSAL}) <> 0")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return rule_table(spark, d).filter(W.has("flags", W.CAUSAL)).select("stream", "sequence_index")


_ACTION = "CASE WHEN c4 = 1 THEN 2 WHEN b_effect = 4 THEN 3 WHEN b_effect = 5 THEN 4 WHEN b_effect = 1 THEN 5 WHEN c1 + c2 + c3 > 0 THEN 1 ELSE 0 END"


@query("p18_steps", f"WITH {RULES} SELECT stream, sequence_index, {_ACTION} AS action, (flags & {W.CAUSAL}) <> 0 AS causal, round(ln(1 + abs(strength)), 5) AS gain, round(0.5 * (a_lock_mean + b_lock_mean), 6) AS bias, round(abs(b_x1 - a_x0), 6) AS duration FROM rules")
def p18(spark: SparkSession, d: str) -> DataFrame:
    s = W.steps(rule_table(spark, d))
    return s.select("stream", "sequence_index", "action", "causal", F.round("gain", 5).alias("gain"), F.round("bias", 6).alias("bias"), F.round("duration", 6).alias("duration"))


@query("t7_first_steps", f"WITH {RULES} SELECT stream, sequence_index FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY sequence_index) AS r FROM rules WHERE (flags & {W.CAUSAL}) <> 0) WHERE r <= 3")
def t7(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.sequence import rank_within

    return rank_within(rule_table(spark, d).filter(W.has("flags", W.CAUSAL)), ["stream"], [F.col("sequence_index")], 3).select("stream", "sequence_index")


_PATHS = {
    "linear": "a_x0 + (b_x1 - a_x0) * u",
    "boundary": "CASE WHEN u <= 0.5 THEN a_x0 + (m - a_x0) * u * 2 ELSE m + (b_x1 - m) * (u - 0.5) * 2 END",
    "drive": "least(greatest(m + tanh((u * 2 - 1) * ln(1 + abs(strength))) * abs(b_x1 - a_x0) * 0.5, least(a_x0, b_x1)), greatest(a_x0, b_x1))",
}
_POINTS = " UNION ALL ".join(f"SELECT '{k}' AS mode, stream, sequence_index, j::INT AS j, round({v}, 6) + 0.0 AS x FROM q" for k, v in _PATHS.items())


@query("p19_step_paths", f"WITH {RULES}, q AS (SELECT *, 0.5 * (a_x1 + b_x0) AS m, j / 4.0::DOUBLE AS u FROM rules, (SELECT unnest(range(5)) AS j)) {_POINTS}")
def p19(spark: SparkSession, d: str) -> DataFrame:
    s = W.steps(rule_table(spark, d))
    parts = [W.sample_path(s, 5, m).select(F.lit(m).alias("mode"), "stream", "sequence_index", "j", (F.round("x", 6) + F.lit(0.0)).alias("x")) for m in _PATHS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("i3_reinject")
def i3(spark: SparkSession, d: str) -> DataFrame:
    """A plan's sampled path evaluated again: rules to steps to a field that isn't on a grid."""
    s = W.sample_path(W.steps(rule_table(spark, d).filter(W.has("flags", W.CAUSAL))), 9, "boundary")
    return with_field(s.select("stream", "sequence_index", "j", "x")).select("stream", "sequence_index", "j", "x", "lock", "raw", "dom")


@query("f5_zero_candidates", f"""WITH {FIELD} SELECT stream, i FROM (SELECT stream, i, x, lag(x) OVER (PARTITION BY stream ORDER BY i) AS px FROM field) WHERE abs(x) <= 0.01 OR (px IS NOT NULL AND px * x < 0)""")
def f5(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.sequence import along

    g = grid(spark, d).withColumn("px", F.lag("x").over(along(["stream"], ["i"])))
    return g.filter((F.abs("x") <= 0.01) | (F.col("px") * F.col("x") < 0)).select("stream", "i")


@query("j12_field_diff", f"""WITH {FIELD}, u AS (UNPIVOT (SELECT a.i, abs(a.k2 - b.k2) AS k2, abs(a.k3 - b.k3) AS k3, abs(a.lock - b.lock) AS lock FROM field a JOIN field b ON a.i = b.i AND a.stream = 0 AND b.stream = 1) ON k2, k3, lock INTO NAME name VALUE v)
SELECT name, round(max(v), 6) AS max_abs, arg_max(i, v) AS at FROM u GROUP BY 1""")
def j12(spark: SparkSession, d: str) -> DataFrame:
    f = field(spark, d).select("stream", "i", "k2", "k3", "lock")
    a, b = f.filter("stream = 0").alias("a"), f.filter("stream = 1").alias("b")
    diff = a.join(b, F.col("a.i") == F.col("b.i")).select(F.col("a.i").alias("i"), *[F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")).alias(c) for c in ("k2", "k3", "lock")])
    return diff.unpivot(["i"], ["k2", "k3", "lock"], "name", "v").groupBy("name").agg(F.round(F.max("v"), 6).alias("max_abs"), F.max_by("i", "v").alias("at"))


@query("j3_region_lineage", f"WITH {WORDS} SELECT w.stream, w.seg, count(*) AS points, bool_and(f.raw = w.raw AND f.dom = w.dom) AS consistent FROM words w JOIN field f ON f.stream = w.stream AND f.i BETWEEN w.i0 AND w.i1 GROUP BY ALL")
def j3(spark: SparkSession, d: str) -> DataFrame:
    """Regions against their field: the segment carried along makes the containment join an equi-join by stream and segment."""
    f = W.regions(field(spark, d), ["stream"], "i").select("stream", "seg", "i", F.col("raw").alias("fr"), F.col("dom").alias("fd"))
    w = word_table(spark, d).select("stream", "seg", "i0", "i1", "raw", "dom")
    j = f.join(w, ["stream", "seg"]).filter(F.col("i").between(F.col("i0"), F.col("i1")))
    return j.groupBy("stream", "seg").agg(F.count("*").alias("points"), F.bool_and((F.col("fr") == F.col("raw")) & (F.col("fd") == F.col("dom"))).alias("consistent"))
