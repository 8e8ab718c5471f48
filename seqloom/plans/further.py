"""Readers of treebanks, intervals, annotations, manifests and profiles; whole forms of motif, variant and matrix queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.field import EFFECTS, coarse_variant, effect_code, operator_number, project
from ..functions.u64 import MIX_1, MIX_2
from ..operators import governance as G
from ..operators.motifs import longest_common, longest_tandem
from ..operators.resample import auto_draws
from ..sources.sinks import scratch
from ..sources.streams import bed, chunked, conllu_sentences, read_manifest, read_profiles, repeat_annotations, treebank_counts
from .catalog import query, t
from .fields import FIELD, GRID, field, grid
from .motifs import KM, SEQ, K, km, seqs
from .streams import _FNV_SQL, _MATRIX, WALK, WORD, coupling_of, pair_counts, walk
from .structure import CLUSTERED, TR, clustered, moves

# --- treebanks: every conversation turn as a sentence, written in ten columns with comments, ranges and empty nodes.


def treebank(spark: SparkSession, d: str) -> DataFrame:
    w = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))

    def row(x: Column, i: Column) -> Column:
        n = F.length(x)
        upos = F.element_at(F.array(F.lit("NOUN"), F.lit("VERB"), F.lit("ADJ")), (n % 3 + 1).cast("int"))
        feats = F.when(n % 5 == 0, "_").otherwise(F.concat(F.lit("Len="), F.least(n, F.lit(6))))
        return F.concat_ws("\t", (i + 1).cast("string"), x, F.left(x, F.lit(3)), upos, F.lit("_"), feats, F.lit("0"), F.lit("root"), F.lit("_"), F.lit("_"))

    extra = "\n1-2\tskipped" + "\t_" * 8 + "\n1.1\tskipped" + "\t_" * 8 + "\n"
    text = F.concat(F.lit("# turn "), F.col("conv_id").cast("string"), F.lit(extra), F.array_join(F.transform(w, row), "\n"), F.lit("\n"))
    path = scratch(spark, "treebank")
    t(spark, d, "conversations").select(text.alias("value")).write.text(path)
    return conllu_sentences(spark, path)


_BANK = f"""w AS (SELECT conv_id, turn, unnest(range(len(x))) AS i, unnest(x) AS form FROM (SELECT *, regexp_extract_all(text, '{WORD}') AS x FROM conversations)),
k AS (SELECT *, lower(substr(form, 1, 3)) || '|' || ['NOUN', 'VERB', 'ADJ'][length(form) % 3 + 1] AS lemma_upos, ['NOUN', 'VERB', 'ADJ'][length(form) % 3 + 1] || '|' || CASE WHEN length(form) % 5 = 0 THEN '_' ELSE 'Len=' || least(length(form), 6) END AS upos_feats FROM w)"""
_U = "(x.h::HUGEINT % 18446744073709551616)::UBIGINT"


@query(
    "s6_treebank_symbols",
    f"""WITH {_BANK}, c AS (SELECT lemma_upos AS w, count(*) AS count FROM k GROUP BY 1), x AS (SELECT count, {_FNV_SQL} AS h FROM c),
f AS (SELECT count, xor({_U} >> 32, {_U} & 4294967295)::BIGINT AS symbol FROM x) SELECT CASE WHEN symbol = 0 THEN 1 ELSE symbol END AS symbol, sum(count)::BIGINT AS count FROM f GROUP BY 1
UNION ALL SELECT -1, count(*) FROM (SELECT DISTINCT conv_id, turn FROM k)""",
)
def s6(spark: SparkSession, d: str) -> DataFrame:
    """Folded hashes of lemma and part of speech, a boundary after each sentence, counted."""
    return treebank_counts(treebank(spark, d), "lemma_upos", boundary=True)


_BYTES = " || ".join(f"[(({{0}} >> {8 * k}) & 255)::HUGEINT]" for k in range(8))
_M = 1 << 64


@query(
    "s6b_treebank_ngrams",
    f"""WITH {_BANK}, p AS (SELECT upos_feats AS a, lead(upos_feats) OVER (PARTITION BY conv_id, turn ORDER BY i) AS b, i FROM k),
c AS (SELECT a, b, count(*) AS count FROM p WHERE b IS NOT NULL AND i % 2 = 0 GROUP BY ALL), keys AS (SELECT DISTINCT upos_feats AS w FROM k), x AS (SELECT w, {_FNV_SQL} AS h FROM keys), s AS (SELECT w, {_U} AS u FROM x),
n AS (SELECT c.count, {_BYTES.format('s.u')} || {_BYTES.format('r.u')} AS bytes FROM c JOIN s ON s.w = c.a JOIN s r ON r.w = c.b),
h AS (SELECT count, list_reduce(list_prepend(1469598103934665603::HUGEINT, bytes), lambda a, b: ((xor(a::UBIGINT, b::UBIGINT))::HUGEINT * 1099511628211 % {_M})::HUGEINT) AS h FROM n)
SELECT (CASE WHEN h >= {1 << 63}::HUGEINT THEN h - {_M}::HUGEINT ELSE h END)::BIGINT AS symbol, sum(count)::BIGINT AS count FROM h GROUP BY 1""",
)
def s6b(spark: SparkSession, d: str) -> DataFrame:
    """Every second pair of part of speech and features in a row, as one 64-bit symbol."""
    return treebank_counts(treebank(spark, d), "upos_feats", window=2, stride=2, bits=64)


# --- intervals, annotations, manifests, profiles: written to the shared folder and read back.


@query("s11_bed_read", """SELECT 'c' || o_custkey % 23 AS chrom, o_orderkey AS start, o_orderkey + 1 + o_custkey % 90 AS "end", 'n' || o_orderkey AS name FROM orders WHERE o_orderkey % 10 <> 3 AND o_orderkey % 15 <> 4""")
def s11(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of files with rows that have no number or end before they start, which are dropped."""
    k = F.col("o_orderkey")
    end = F.when(k % 10 == 3, k - 1).otherwise(k + 1 + F.col("o_custkey") % 90)
    line = F.concat_ws("\t", F.concat(F.lit("c"), (F.col("o_custkey") % 23).cast("string")), F.when(k % 15 == 4, "start").otherwise(k.cast("string")), end.cast("string"), F.concat(F.lit("n"), k.cast("string")))
    path = scratch(spark, "bed")
    t(spark, d, "orders").select(line.alias("value")).write.text(path)
    return bed(spark, path)


@query("s12_annotations", """SELECT 'chr7' AS chrom, o_orderkey AS start, o_orderkey + 50 AS "end", 'r' || o_custkey % 5 || '|LINE|L' || o_custkey % 3 AS name, o_custkey % 900 AS score, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'LINE' AS class, 'L' || o_custkey % 3 AS family, 'r' || o_custkey % 5 AS repeat
FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey % 9 <> 2""")
def s12(spark: SparkSession, d: str) -> DataFrame:
    """One chromosome of a gzipped annotation dump that has short and commented lines."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    cells = [F.lit("585"), text(c % 900), F.lit("0"), F.lit("0"), F.lit("0"), F.when(k % 4 == 1, "chr7").otherwise("chr8"), text(k), text(k + 50), F.lit("-1"), F.when(k % 2 == 0, "+").otherwise("-"), F.concat(F.lit("r"), text(c % 5)), F.lit("LINE"), F.concat(F.lit("L"), text(c % 3)), F.lit("1"), F.lit("50"), F.lit("0"), F.lit("1")]
    line = F.when(k % 9 == 2, F.when(k % 2 == 0, "# a comment").otherwise("585\t1\tshort")).otherwise(F.concat_ws("\t", *cells))
    path = scratch(spark, "annotations")
    t(spark, d, "orders").select(line.alias("value")).write.option("compression", "gzip").text(path)
    return repeat_annotations(spark, path, "chr7")


@query("s13_manifest", """SELECT n_name AS name, 's' || n_nationkey AS symbols, 'g' || n_regionkey AS grammar FROM nation""")
def s13(spark: SparkSession, d: str) -> DataFrame:
    """Two manifests: one with commas, one with semicolons, a byte order mark, comments and quotes."""
    n = t(spark, d, "nation").select("n_nationkey", "n_name", F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("s"), F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("g"))
    path = scratch(spark, "manifest")
    for rest, head, line in ((0, "name,symbols,grammar", F.concat_ws(",", "n_name", "s", "g")), (1, '﻿"Grammar"; NAME ;Symbols\n# comment\n', F.concat_ws(" ; ", "g", F.concat(F.lit('"'), "n_name", F.lit('"')), "s"))):
        whole = n.filter(F.col("n_nationkey") % 2 == rest).agg(F.concat(F.lit(head + "\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("value"))  # a manifest is one small file
        whole.write.mode("append").text(path)
    return read_manifest(spark, path).select("name", "symbols", "grammar")


@query("s19_profiles", """SELECT 'p' || r_regionkey AS name, CASE r_regionkey WHEN 0 THEN 'profile mode must be workflow or command' WHEN 1 THEN 'profile target/order count out of range' WHEN 2 THEN 'profile max_steps must be 1..32' WHEN 3 THEN 'empty target in profile' END AS error FROM region""")
def s19(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("r_regionkey")
    targets = F.when(k == 1, F.array().cast("array<string>")).when(k == 3, F.array(F.lit("a"), F.lit(""))).otherwise(F.array(F.lit("a")))
    one = F.struct(F.concat(F.lit("p"), k.cast("string")).alias("name"), F.lit("d").alias("domain"), F.lit("i").alias("intent"), F.when(k == 0, "other").otherwise("command").alias("mode"), targets.alias("targets"), F.array(F.lit("a")).alias("order"), F.when(k == 2, 33).otherwise(3).alias("max_steps"))
    path = scratch(spark, "profiles")
    t(spark, d, "region").agg(F.to_json(F.collect_list(one)).alias("value")).write.text(path)  # five regions
    return read_profiles(spark, path).select("name", "error")


# --- names, coarse variants, projections, exports.

_NAMES = [*EFFECTS, "Attractor", "PHASE", "7", "9", "other"]
_OPS = ["K1", "k5", "3", "K6", "x"]


@query("p22_names", f"""WITH n AS (SELECT event_id, [{', '.join(f"'{x}'" for x in _NAMES)}][event_id % {len(_NAMES)} + 1] AS name, [{', '.join(f"'{x}'" for x in _OPS)}][event_id % {len(_OPS)} + 1] AS op FROM events)
SELECT event_id, CASE lower(name) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in EFFECTS.items())} WHEN '7' THEN 7 END::INT AS effect, CASE lower(op) WHEN 'k1' THEN 1 WHEN 'k5' THEN 5 WHEN '3' THEN 3 END::INT AS operator FROM n""")
def p22(spark: SparkSession, d: str) -> DataFrame:
    """Effects and operators by name, short name or number, in any case."""
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    return t(spark, d, "events").select("event_id", effect_code(pick(_NAMES)).alias("effect"), operator_number(pick(_OPS)).alias("operator"))


@query("p4_coarse_variants")
def p4(spark: SparkSession, d: str) -> DataFrame:
    """Coarse state of each grid point: few enough states for a grammar over them."""
    v = coarse_variant(F.col("raw"), F.col("dom"), F.col("lock"), F.col("dom_score"), [F.col(f"k{j}") for j in range(1, 6)])
    return field(spark, d).select("stream", "i", v.alias("variant_hash"))


_LOW = 1 << 32
_MUL = lambda z, c: f"({z} % {_LOW} * {c}::HUGEINT + ({z} // {_LOW} * {c & (_LOW - 1)}::HUGEINT % {_LOW}) * {_LOW}) % {_M}::HUGEINT"


@query(
    "p2b_project_hash",
    f"""WITH {GRID}, s AS (SELECT stream, i, i::HUGEINT AS z FROM grid), a AS (SELECT stream, i, xor(z::UBIGINT, z::UBIGINT >> 30)::HUGEINT AS z FROM s), b AS (SELECT stream, i, {_MUL('z', MIX_1)} AS z FROM a),
c AS (SELECT stream, i, xor(z::UBIGINT, z::UBIGINT >> 27)::HUGEINT AS z FROM b), e AS (SELECT stream, i, {_MUL('z', MIX_2)} AS z FROM c), f AS (SELECT stream, i, xor(z::UBIGINT, z::UBIGINT >> 31) AS z FROM e)
SELECT stream, i, -2 + (z >> 11)::DOUBLE / {1 << 53}::DOUBLE * 5 AS x FROM f""",
)
def p2b(spark: SparkSession, d: str) -> DataFrame:
    """Places of symbols in [-2, 3] by their hash."""
    return grid(spark, d).select("stream", "i", project(F.col("i"), -2.0, 3.0).alias("x"))


@query("p20_field_export", f"WITH {FIELD} SELECT stream, i, round(x, 6) AS x, round(lock, 6) AS lock, raw, dom FROM field")
def p20(spark: SparkSession, d: str) -> DataFrame:
    return field(spark, d).select("stream", "i", F.round("x", 6).alias("x"), F.round("lock", 6).alias("lock"), "raw", "dom")


_AGG = {"x": ("min", "max", "avg"), "lock": ("min", "max", "avg"), "score": ("min", "max", "avg"), "ek": ("min", "max", "avg"), "k2": ("avg",), "k4": ("avg",), "k5": ("avg",)}


@query(
    "a8b_variant_aggregates",
    f"""WITH {FIELD}, v AS (SELECT *, raw * 1000 + dom * 100 + floor(lock * 20)::INT AS variant, ln(1 + dom_score) AS score FROM field)
SELECT variant, stream, count(*) AS sample_count, min(i) AS first_i, max(i) AS last_i, max(i) - min(i) + 1 AS span, round(avg(i), 6) AS centroid_i, count(*) FILTER (raw <> dom) AS mismatches, count(*) FILTER (lock >= 0.99::DOUBLE) AS locked,
{', '.join(f'round({f}({c}), 6) + 0.0 AS {c}_{f}' for c, fs in _AGG.items() for f in fs)} FROM v GROUP BY ALL""",
)
def a8b(spark: SparkSession, d: str) -> DataFrame:
    """Counts, places, extremes and means of each variant of a stream, in one grouping."""
    v = F.col("raw") * 1000 + F.col("dom") * 100 + F.floor(F.col("lock") * 20)
    s = field(spark, d).withColumns({"variant": v.cast("int"), "score": F.ln(F.col("dom_score") + 1)})
    measures = [F.round(getattr(F, f)(c), 6) + F.lit(0.0) for c, fs in _AGG.items() for f in fs]
    names = [f"{c}_{f}" for c, fs in _AGG.items() for f in fs]
    return s.groupBy("variant", "stream").agg(
        F.count("*").alias("sample_count"), F.min("i").alias("first_i"), F.max("i").alias("last_i"), (F.max("i") - F.min("i") + 1).alias("span"), F.round(F.avg("i"), 6).alias("centroid_i"),
        F.count_if(F.col("raw") != F.col("dom")).alias("mismatches"), F.count_if(F.col("lock") >= 0.99).alias("locked"), *[m.alias(n) for m, n in zip(measures, names, strict=True)],
    )


# --- motifs.

_WIN, _PERIODS = 100, 50


@query(
    "x2b_weighted_windows",
    f"""WITH {KM}, m AS (SELECT kmer, count(*) AS n FROM km GROUP BY 1 ORDER BY n DESC, kmer LIMIT 8), mw AS (SELECT kmer, n / sum(n) OVER () AS weight FROM m),
h AS (SELECT item_id, pos, weight, 1 AS plus FROM km JOIN mw ON mw.kmer = km.kmer UNION ALL SELECT item_id, pos, 0, 0 FROM km JOIN mw ON reverse(translate(mw.kmer, 'ACGT', 'TGCA')) = km.kmer),
l AS (SELECT item_id, length(seq) AS length FROM seqs),
i AS (SELECT h.*, pos // {_WIN} AS win, least({_WIN}, length - pos // {_WIN} * {_WIN}) AS len FROM h JOIN l USING (item_id) WHERE pos % {_WIN} + {K} <= least({_WIN}, length - pos // {_WIN} * {_WIN})),
g AS (SELECT item_id, win, any_value(len)::BIGINT AS len, sum(plus)::BIGINT AS hits, sum(1 - plus)::BIGINT AS rc_hits, sum(weight) AS weighted FROM i GROUP BY ALL), p AS (SELECT DISTINCT item_id, win, pos % {_WIN} AS o, len FROM i),
e AS (SELECT p.item_id, p.win, d.d, sum((o + d.d < len)::INT + (o >= d.d)::INT) AS either FROM p, range(1, {_PERIODS + 1}) d(d) WHERE d.d <= CASE WHEN {_PERIODS} >= len THEN len - 1 ELSE {_PERIODS} END GROUP BY ALL),
b AS (SELECT a.item_id, a.win, c.o - a.o AS d, count(*) AS pair FROM p a JOIN p c ON a.item_id = c.item_id AND a.win = c.win AND c.o - a.o BETWEEN 1 AND {_PERIODS} GROUP BY ALL),
r AS (SELECT e.item_id, e.win, e.d, pair / (either - pair) AS rate FROM e JOIN b ON b.item_id = e.item_id AND b.win = e.win AND b.d = e.d), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, win ORDER BY rate DESC, d) AS k FROM r) WHERE k = 1)
SELECT g.item_id, g.win, hits, rc_hits, round(weighted, 6) AS weighted, round(hits / len, 9) AS density, round((rc_hits + 1) / (hits + rc_hits + 1), 9) AS rc_balance, coalesce(best.d, 0)::INT AS period, round(coalesce(rate, 0), 9) AS rate
FROM g LEFT JOIN best ON best.item_id = g.item_id AND best.win = g.win""",
)
def x2b(spark: SparkSession, d: str) -> DataFrame:
    """Weighted motif hits of windows, their density, and the distance at which hits follow each other most often.

    A hit lies whole in its window; a window's places are one short array, so periods are tried within its row.
    """
    all_ = km(spark, d)
    m = all_.groupBy("kmer").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "kmer").limit(8)
    m = m.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy()))  # eight rows
    rc = F.reverse(F.translate("kmer", "ACGT", "TGCA"))
    forms = m.select("kmer", "weight", F.lit(1).alias("plus")).unionByName(m.select(rc.alias("kmer"), F.lit(0.0).alias("weight"), F.lit(0).alias("plus")))
    len_ = F.least(F.lit(_WIN), F.col("length") - F.col("win") * _WIN)
    h = all_.join(F.broadcast(forms), "kmer").withColumn("win", F.floor(F.col("pos") / _WIN)).join(seqs(spark, d).select("item_id", F.length("seq").alias("length")), "item_id")
    h = h.withColumns({"len": len_, "at": F.col("pos") % _WIN}).filter(F.col("at") + K <= F.col("len"))
    g = h.groupBy("item_id", "win").agg(F.any_value("len").alias("len"), F.sum("plus").alias("hits"), F.sum(F.lit(1) - F.col("plus")).alias("rc_hits"), F.sum("weight").alias("weighted"), F.collect_set("at").alias("at"))

    def rate(p: Column) -> Column:
        both = F.size(F.array_intersect("at", F.transform("at", lambda x: x + p)))
        either = F.size(F.filter("at", lambda x: x + p < F.col("len"))) + F.size(F.filter("at", lambda x: x >= p))
        return F.struct(F.when(either > both, both / (either - both)).otherwise(F.lit(0.0)).alias("rate"), (-p).alias("p"))

    most = F.when(F.col("len") <= _PERIODS, F.col("len") - 1).otherwise(_PERIODS).cast("int")
    g = g.withColumn("best", F.array_max(F.transform(F.sequence(F.lit(1), most), rate)))
    found = F.col("best.rate") > 0
    return g.select(
        "item_id", "win", "hits", "rc_hits", F.round("weighted", 6).alias("weighted"), F.round(F.col("hits") / F.col("len"), 9).alias("density"), F.round((F.col("rc_hits") + 1) / (F.col("hits") + F.col("rc_hits") + 1), 9).alias("rc_balance"),
        F.when(found, -F.col("best.p")).otherwise(0).cast("int").alias("period"), F.round(F.when(found, F.col("best.rate")).otherwise(0.0), 9).alias("rate"),
    )


def holds_template(template: Column, parts: list[tuple[int, str]]) -> Column:
    """Has a cluster's template each of the motifs at its offset, on either strand?"""
    have = F.split(template, "\\|")
    ok = F.lit(True)
    for offset, motif in parts:
        start = f"{offset}:{motif}:"
        ok = ok & F.exists(have, lambda x: F.startswith(x, F.lit(start)))  # noqa: B023
    return ok


_PARTS = [(0, "view"), (1, "click")]


@query("x3b_template_offsets", f"WITH {CLUSTERED} SELECT stream, cluster, template FROM cl WHERE {' AND '.join(f"contains('|' || template, '|{o}:{m}:')" for o, m in _PARTS)}")
def x3b(spark: SparkSession, d: str) -> DataFrame:
    """Clusters with a motif at each of several offsets."""
    return clustered(spark, d).filter(holds_template(F.col("template"), _PARTS)).select("stream", "cluster", "template")


@query("x4c_skeletons_in_intervals", f"""WITH {SEQ}, v AS (SELECT item_id, seq, unnest(range(0, length(seq), 40)) AS start FROM seqs), r AS (SELECT *, least(start + 60, length(seq)) AS "end" FROM v), p AS (SELECT *, unnest(range(start, "end" - 9)) AS pos FROM r WHERE "end" - start >= 10)
SELECT item_id, start AS interval_start, pos, substr(seq, (pos + 3)::INT, 6) AS spacer FROM p WHERE substr(seq, (pos + 1)::INT, 2) = 'AC' AND substr(seq, (pos + 9)::INT, 2) = 'GT'""")
def x4c(spark: SparkSession, d: str) -> DataFrame:
    """A…B at a fixed distance inside overlapping intervals, once for each interval that holds it whole."""
    pieces = chunked(seqs(spark, d), ["item_id"], "seq", 40 * 1024, 60)
    n = F.octet_length("piece")
    r = pieces.select("item_id", "start", "piece", F.explode(F.sequence(F.lit(0), F.least(n, F.lit(40 * 1024)) - 1, F.lit(40))).alias("at"))
    r = r.select("item_id", (F.col("start") + F.col("at")).alias("interval_start"), F.substring(F.col("piece"), F.col("at") + 1, F.lit(60)).cast("string").alias("region")).filter("length(region) >= 10")
    at = lambda p, n: F.substring(F.col("region"), p, F.lit(n))
    starts = F.filter(F.sequence(F.lit(1), F.length("region") - 9), lambda p: (at(p, 2) == "AC") & (at(p + 8, 2) == "GT"))
    out = r.select("*", F.explode(starts).alias("p"))
    return out.select("item_id", "interval_start", (F.col("interval_start") + F.col("p") - 1).alias("pos"), F.substring(F.col("region"), F.col("p") + 2, F.lit(6)).alias("spacer"))


_LONGEST = f"""WITH {SEQ}, n AS (SELECT count(*) AS n, min(length(seq)) AS m FROM seqs), p AS (SELECT item_id, seq, unnest(range(1, length(seq) + 1)) AS s FROM seqs),
x AS (SELECT item_id, substr(seq, s, l.l) AS sub FROM p, range(1, (SELECT m FROM n) + 1) l(l) WHERE s + l.l <= length(seq) + 1), c AS (SELECT sub FROM x GROUP BY sub HAVING count(DISTINCT item_id) = (SELECT n FROM n))
SELECT sub AS substring, length(sub)::INT AS length FROM c WHERE length(sub) = (SELECT max(length(sub)) FROM c)"""


@query("u5_common_substrings", _LONGEST)
@query("u5b_longest_common", _LONGEST)
def u5b(spark: SparkSession, d: str) -> DataFrame:
    """The longest substrings that all sequences share."""
    return longest_common(seqs(spark, d), "item_id", "seq")


@query("w5b_tandems", f"""WITH {SEQ}, u AS (SELECT item_id, unnest(range(0, length(seq) // 2)) AS k, seq FROM seqs WHERE length(seq) >= 4), d AS (SELECT item_id, k, substr(seq, 2 * k + 1, 2) AS u FROM u),
b AS (SELECT *, CASE WHEN u = lag(u) OVER w AND NOT contains(u, 'N') THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY item_id ORDER BY k)), g AS (SELECT item_id, sum(new) OVER (PARTITION BY item_id ORDER BY k) AS g FROM b), r AS (SELECT item_id, g, count(*) AS n FROM g GROUP BY ALL)
SELECT s.item_id, coalesce(max(2 * n), 0)::INT AS longest FROM seqs s LEFT JOIN r ON r.item_id = s.item_id GROUP BY 1""")
def w5b(spark: SparkSession, d: str) -> DataFrame:
    """The longest repetition of one pair of bases, in bases, at even places; 0 for sequences under four bases."""
    t_ = longest_tandem(seqs(spark, d), ["item_id"], "seq")
    return seqs(spark, d).select("item_id").join(t_, "item_id", "left").select("item_id", F.coalesce("longest", F.lit(0)).alias("longest"))


# --- matrices, draws, repair, filters.


@query(
    "a17_null_summary",
    f"""WITH {_MATRIX}, o AS (SELECT "row", col, hits / test_transitions AS a FROM m), e AS (SELECT stream AS col, count(*) AS e FROM tr GROUP BY 1), v AS (SELECT stream AS "row", count(DISTINCT symbol) AS s, count(DISTINCT nxt) AS x, sum(c) AS n FROM te GROUP BY 1),
f AS (SELECT 'uniform' AS mode, o."row", o.col, a, least(1, e / (s::DOUBLE * x)) AS null_accuracy FROM o JOIN e USING (col) JOIN v ON v."row" = o."row" UNION ALL SELECT 'swapped', o."row", o.col, o.a, q.a FROM o JOIN o q ON q."row" = o.col AND q.col = o."row")
SELECT mode, count(*) AS cells, round(avg(a), 9) AS avg_observed_accuracy, round(avg(null_accuracy), 9) AS avg_null_accuracy, round(avg(a - null_accuracy), 9) + 0.0 AS avg_delta_accuracy, round(max(null_accuracy), 9) AS max_null_accuracy, round(min(a - null_accuracy), 9) + 0.0 AS min_delta_accuracy FROM f GROUP BY 1""",
)
def a17(spark: SparkSession, d: str) -> DataFrame:
    """Observed and null accuracy of a matrix's cells by mode: pairs drawn evenly, and each cell's own opposite."""
    counted = pair_counts(spark, d)
    o = coupling_of(counted).select("row", "col", F.col("kgram_accuracy").alias("a"))
    e = counted.filter("tr > 0").groupBy(F.col("stream").alias("col")).agg(F.count("*").alias("e"))
    v = counted.filter("count > 0").groupBy(F.col("stream").alias("row")).agg(F.count_distinct("from").alias("s"), F.count_distinct("to").alias("x"))
    even = o.join(e, "col").join(v, "row").select(F.lit("uniform").alias("mode"), "a", F.least(F.lit(1.0), F.col("e") / (F.col("s").cast("double") * F.col("x"))).alias("b"))
    swapped = o.join(o.select(F.col("col").alias("row"), F.col("row").alias("col"), F.col("a").alias("b")), ["row", "col"]).select(F.lit("swapped").alias("mode"), "a", "b")
    return null_summary(even.unionByName(swapped))


def null_summary(cells: DataFrame) -> DataFrame:
    """By mode, of cells(mode, a observed, b null)."""
    r = lambda c: F.round(c, 9) + F.lit(0.0)
    delta = F.col("a") - F.col("b")
    return cells.groupBy("mode").agg(F.count("*").alias("cells"), r(F.avg("a")).alias("avg_observed_accuracy"), r(F.avg("b")).alias("avg_null_accuracy"), r(F.avg(delta)).alias("avg_delta_accuracy"), r(F.max("b")).alias("max_null_accuracy"), r(F.min(delta)).alias("min_delta_accuracy"))


@query("n7b_draws", f"""WITH {_MATRIX}, e AS (SELECT min(n)::BIGINT AS edges FROM r) SELECT edges, least(greatest(CASE WHEN edges < 5000 THEN least(greatest(edges * 20, 1000), 50000) WHEN edges < 50000 THEN least(greatest(edges * 10, 10000), 200000)
WHEN edges < 500000 THEN 200000 WHEN edges < 5000000 THEN 500000 ELSE 1000000 END, 10000), 1000000)::BIGINT AS draws FROM e""")
def n7b(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs a null cell draws, from the smallest count of test edges."""
    rows = pair_counts(spark, d).filter("count > 0").groupBy("stream").agg(F.sum("count").alias("n"))
    return rows.agg(F.min("n").alias("edges")).select("edges", auto_draws(F.col("edges")).alias("draws"))


@query("a24b_top_contingency", f"""WITH {TR}, s AS (SELECT f AS s, count(*) AS n FROM tr GROUP BY 1 ORDER BY n DESC, s LIMIT 4), c AS (SELECT f, t, count(*) AS n FROM tr GROUP BY ALL)
SELECT a.s AS "from", b.s AS "to", coalesce(c.n, 0)::BIGINT AS count FROM s a CROSS JOIN s b LEFT JOIN c ON c.f = a.s AND c.t = b.s""")
def a24b(spark: SparkSession, d: str) -> DataFrame:
    """The commonest states against each other, whatever they are called; empty cells count 0."""
    c = moves(spark, d).groupBy("from", "to").count()
    top = c.groupBy("from").agg(F.sum("count").alias("n")).orderBy(F.col("n").desc(), "from").limit(4).select(F.col("from").alias("s"))
    every = top.select(F.col("s").alias("from")).crossJoin(F.broadcast(top.select(F.col("s").alias("to"))))  # four by four
    return every.join(c, ["from", "to"], "left").select("from", "to", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


@query("g10b_synthesized", """WITH x AS (SELECT conv_id, turn, (conv_id * 3 + turn) % 6 AS k FROM conversations) SELECT conv_id, turn, CASE WHEN k < 4 THEN 'export_document' END AS target, CASE k WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'markdown' WHEN 3 THEN 'markdown' END AS mode,
CASE WHEN k = 1 THEN 'dark' WHEN k < 4 THEN 'plain' END AS theme, k < 4 AS accepted FROM x""")
def g10b(spark: SparkSession, d: str) -> DataFrame:
    """Proposals in another shape become the command that the contract asks for, and pass it; others stay as they are."""
    c = t(spark, d, "conversations")
    k = F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(6))
    bodies = [
        '{"action":"emit_ui_command","target":"export_document","args":{"mode":["html"]}}', '{"action":"emit_ui_command","args":{"target":["export_document"],"mode":["pdf"],"theme":"dark"}}', '{"command":"emit_ui_command","target":"export_document","args":{}}',
        '{"action":["emit_ui_command"],"args":{"target":"export_document"}}', '{"action":"erase","target":"export_document"}', '{"action":"emit_ui_command","target":"open_preview"}',
    ]
    machine = F.element_at(F.array(*[F.lit(b) for b in bodies]), (k + 1).cast("int"))
    said = F.concat(F.lit('{"type":"action_proposal","human_summary":'), F.lit('"done"'), F.lit(',"machine_result":'), machine, F.lit("}"))
    fixed = G.synthesized(said)
    actions = F.lit('[{"name":"emit_ui_command","args":{"target":["export_document"],"mode":["pdf","html","markdown"],"theme":["plain","dark"]}}]')
    envelope = G.envelope_text(F.lit("app"), F.col("text"), F.to_json(F.struct("role")), actions, F.lit("[]"))
    response = F.concat(F.lit("## Machine Result\n\n```json\n"), F.coalesce(fixed, said), F.lit("\n```\n"))
    checked = G.validated(c.select("conv_id", "turn", envelope.alias("envelope"), response.alias("response"), fixed.alias("fixed")))
    part = lambda p: F.get_json_object("fixed", f"$.machine_result.{p}")
    return checked.select("conv_id", "turn", part("target").alias("target"), part("args.mode").alias("mode"), part("args.theme").alias("theme"), "accepted")


@query("f6_target_blocks", f"WITH {CLUSTERED}, g AS (SELECT template, row_number() OVER (ORDER BY count(*) DESC, template) AS rank FROM cl GROUP BY 1) SELECT stream, cluster FROM cl JOIN g USING (template) WHERE rank = 2 AND n_hits >= 1")
def f6(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the template with one rank; that template is one row."""
    cl = clustered(spark, d)
    ranked = cl.groupBy("template").count().orderBy(F.col("count").desc(), "template").limit(2)
    target = ranked.orderBy("count", F.col("template").desc()).limit(1)
    return cl.join(F.broadcast(target.select("template")), "template").select("stream", "cluster")


@query("t10_first_symbols", f"WITH {WALK} SELECT stream, pos, symbol FROM walk ORDER BY stream, pos LIMIT 1000")
def t10(spark: SparkSession, d: str) -> DataFrame:
    """A stream read up to a number of symbols."""
    return walk(spark, d).select("stream", "pos", "symbol").orderBy("stream", "pos").limit(1000)
