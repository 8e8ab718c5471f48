"""Variants of the field, overlap graphs, summaries, lookups and rankings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.field import project, variant_id
from ..operators.ranks import numbered_within
from ..operators.sequence import pairs, rank_within
from ..sources.streams import CHUNK, chunked
from .catalog import query, t
from .fields import FIELD, GRID, field, grid
from .models import null_sql, null_test
from .motifs import KM, SEQ, km, seqs
from .streams import WALK, walk
from .structure import CLUSTERED, clustered

_V = f"""{FIELD}, vr AS (SELECT stream, i, x, raw * 1000 + dom * 100 + floor(lock * 20)::INT AS variant, raw, dom, lock, ln(1 + dom_score) AS score FROM field),
va AS (SELECT variant, count(*) AS sample_count, min(raw) AS raw, min(dom) AS dom, min(x) AS x_min, max(x) AS x_max, avg(lock) AS lock_mean, max(score) AS score_max, avg(score) AS score_mean FROM vr GROUP BY 1)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("raw") * 1000 + F.col("dom") * 100 + F.floor(F.col("lock") * 20)
    return field(spark, d).select("stream", "i", "x", v.cast("int").alias("variant"), "raw", "dom", "lock", F.ln(F.col("dom_score") + 1).alias("score"))


def variants(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy("variant").agg(F.count("*").alias("sample_count"), F.min("raw").alias("raw"), F.min("dom").alias("dom"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.avg("lock").alias("lock_mean"), F.max("score").alias("score_max"), F.avg("score").alias("score_mean"))


_R = ["x_min", "x_max", "lock_mean", "score_max", "score_mean"]


@query("a8_variants", f"WITH {_V} SELECT variant, sample_count, raw, dom, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _R)} FROM va")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, d).withColumns({c: F.round(c, 6) + F.lit(0.0) for c in _R})


_SCORE = "lock_mean * ln(1 + sample_count) + 0.25 * lock_mean + 0.1 * ln(1 + score_mean)"


@query("t2_top_variants", f"WITH {_V} SELECT variant, round({_SCORE}, 6) AS rank_score FROM va ORDER BY rank_score DESC, variant LIMIT 10")
def t2(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("lock_mean") * F.log1p("sample_count") + F.col("lock_mean") * 0.25 + F.log1p("score_mean") * 0.1
    return variants(spark, d).select("variant", F.round(score, 6).alias("rank_score")).orderBy(F.col("rank_score").desc(), "variant").limit(10)


@query("f4_variant_query", f"WITH {_V} SELECT variant FROM va WHERE dom = 4 AND sample_count >= 5 AND (lock_mean >= 0.9 OR score_max >= 2)")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, d).filter((F.col("dom") == 4) & (F.col("sample_count") >= 5) & ((F.col("lock_mean") >= 0.9) | (F.col("score_max") >= 2))).select("variant")


@query("j6_variant_successors", f"""WITH {_V}, p AS (SELECT variant, lead(variant) OVER (PARTITION BY stream ORDER BY i) AS nxt FROM vr), c AS (SELECT variant, nxt, count(*) AS n FROM p WHERE nxt IS NOT NULL AND nxt <> variant GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY n DESC, nxt) AS r FROM c) WHERE r = 1) SELECT b.variant, b.nxt AS successor, b.n AS successor_count, s.sample_count AS successor_samples FROM b JOIN va s ON s.variant = b.nxt""")
def j6(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(samples(spark, d), ["stream"], ["i"], "variant").filter(F.col("from") != F.col("to"))
    c = p.groupBy(F.col("from").alias("variant"), F.col("to").alias("successor")).agg(F.count("*").alias("successor_count"))
    best = rank_within(c, ["variant"], [F.col("successor_count").desc(), F.col("successor")], 1).drop("rank")
    return best.join(variants(spark, d).select(F.col("variant").alias("successor"), F.col("sample_count").alias("successor_samples")), "successor")


@query("p2_project_affine", f"WITH {GRID} SELECT stream, i, round(-2 + least(greatest(i / 400.0::DOUBLE, 0), 1) * 5, 9) AS x FROM grid")
def p2(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, d).select("stream", "i", F.round(project(F.col("i"), -2.0, 3.0, 0, 400), 9).alias("x"))


@query("p3_variant_ids")
def p3(spark: SparkSession, d: str) -> DataFrame:
    """Exact 64-bit ids of quantised field values, one for each distinct state."""
    f = field(spark, d)
    return f.select("stream", "i", variant_id(F.col("raw"), F.col("dom"), F.col("lock"), F.col("dom_score"), [F.col(f"k{j}") for j in range(1, 6)]).alias("variant_id"))


@query("j9_suffix_overlaps", f"""WITH {KM}, m AS (SELECT kmer, count(*) AS n FROM km GROUP BY 1 ORDER BY n DESC, kmer LIMIT 8)
SELECT a.kmer AS a, b.kmer AS b, list_max([CASE WHEN substr(a.kmer, 7 - k) = substr(b.kmer, 1, k) THEN k ELSE 0 END FOR k IN range(1, 6)])::INT AS overlap FROM m a, m b WHERE a.kmer <> b.kmer""")
def j9(spark: SparkSession, d: str) -> DataFrame:
    """Longest suffix of one motif that begins another, for eight motifs; pairs meet by such a string, not each with each."""
    m = motifs8(spark, d)
    ends = m.select(F.col("kmer").alias("a"), F.explode(F.array(*[F.right("kmer", F.lit(k)) for k in range(1, 6)])).alias("s"))
    heads = m.select(F.col("kmer").alias("b"), F.explode(F.array(*[F.left("kmer", F.lit(k)) for k in range(1, 6)])).alias("s"))
    some = ends.join(heads, "s").filter("a <> b").groupBy("a", "b").agg(F.max(F.length("s")).alias("overlap"))
    every = m.select(F.col("kmer").alias("a")).crossJoin(F.broadcast(m.select(F.col("kmer").alias("b")))).filter("a <> b")  # eight by eight
    return every.join(some, ["a", "b"], "left").select("a", "b", F.coalesce("overlap", F.lit(0)).alias("overlap"))


def motifs8(spark: SparkSession, d: str) -> DataFrame:
    return km(spark, d).groupBy("kmer").count().orderBy(F.col("count").desc(), "kmer").limit(8).select("kmer")


@query("x6_superstring")
def x6(spark: SparkSession, d: str) -> DataFrame:
    """A short string that holds eight motifs, joined greedily by their longest overlaps: eight rows, one task."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        parts = sorted(set(frame["kmer"]))
        while len(parts) > 1:
            size, a, b = max(((next((k for k in range(min(len(a), len(b)), 0, -1) if a.endswith(b[:k])), 0), a, b) for a in parts for b in parts if a != b), key=lambda x: (x[0], x[1] < x[2], x[1], x[2]))
            parts = sorted({p for p in parts if p not in (a, b)} | {a + b[size:]})
        return pd.DataFrame({"superstring": parts, "length": [len(p) for p in parts]})

    return motifs8(spark, d).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(one, "superstring string, length long")


SKELETON = "(?=AC[ACGT]{4,8}GT)"  # looks ahead, so that each start counts, in an earlier match too


_STARTS = f"""WITH {SEQ} SELECT item_id, len([i FOR i IN range(1, length(seq) + 1) IF regexp_matches(substr(seq, i, 12), '^AC[ACGT]{{4,8}}GT')])::BIGINT AS hits FROM seqs"""


@query("x4_skeleton_scan", _STARTS)
@query("x4b_skeleton_starts", _STARTS)
def x4b(spark: SparkSession, d: str) -> DataFrame:
    """Every place where a skeleton starts, in an earlier one too."""
    return seqs(spark, d).select("item_id", F.regexp_count("seq", F.lit(SKELETON)).cast("long").alias("hits"))


@query("p25_expected_counts", f"""WITH {SEQ}, n AS (SELECT sum(length(seq) - length(replace(seq, 'A', ''))) AS a, sum(length(seq) - length(replace(seq, 'C', ''))) AS c, sum(length(seq) - length(replace(seq, 'G', ''))) AS g, sum(length(seq) - length(replace(seq, 'T', ''))) AS t FROM seqs),
{KM[len(SEQ) + 2:]}, m AS (SELECT kmer, count(*) AS n FROM km GROUP BY 1 ORDER BY n DESC, kmer LIMIT 8),
x AS (SELECT kmer, m.n, a / (a + c + g + t) AS pa, c / (a + c + g + t) AS pc, g / (a + c + g + t) AS pg, t / (a + c + g + t) AS pt, a + c + g + t AS total FROM m, n)
SELECT kmer, n AS observed, round(total * {' * '.join(f"(CASE substr(kmer, {j}, 1) WHEN 'A' THEN pa WHEN 'C' THEN pc WHEN 'G' THEN pg ELSE pt END)" for j in range(1, 7))}, 6) AS expected FROM x""")
def p25(spark: SparkSession, d: str) -> DataFrame:
    """How often each of eight motifs would occur if bases were drawn one by one."""
    n = seqs(spark, d).agg(*[F.sum(F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).alias(b) for b in "ACGT"])
    m = km(spark, d).groupBy("kmer").agg(F.count("*").alias("observed")).orderBy(F.col("observed").desc(), "kmer").limit(8)
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    share = F.create_map(*[x for b in "ACGT" for x in (F.lit(b), F.col(b) / total)])
    p = F.aggregate(F.sequence(F.lit(1), F.lit(6)), total.cast("double"), lambda acc, j: acc * F.element_at(F.col("share"), F.substring(F.col("kmer"), j, F.lit(1))))
    return m.crossJoin(F.broadcast(n)).withColumn("share", share).select("kmer", "observed", F.round(p, 6).alias("expected"))


@query("a14_series_record", f"""WITH {WALK} SELECT stream, count(*) AS n, round(min(value), 6) AS x_min, round(max(value), 6) AS x_max, round(avg(value), 10) AS x_mean, round(var_pop(value), 5) AS x_var, count(*) FILTER (abs(value) < 1) AS null_hits, round(count(*) / count(DISTINCT symbol), 9) AS compression FROM walk GROUP BY 1""")
def a14(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return walk(spark, d).groupBy("stream").agg(F.count("*").alias("n"), F.round(F.min(v), 6).alias("x_min"), F.round(F.max(v), 6).alias("x_max"), F.round(F.avg(v), 10).alias("x_mean"), F.round(F.var_pop(v), 5).alias("x_var"), F.sum((F.abs(v) < 1).cast("int")).alias("null_hits"), F.round(F.count("*") / F.count_distinct("symbol"), 9).alias("compression"))


@query("a16_summary_by_kind", f"WITH {WALK}, s AS (SELECT stream % 5 AS kind, stream, avg(value) AS m FROM walk GROUP BY ALL) SELECT kind, count(*) AS runs, round(avg(m), 9) AS mean, round(avg((m > 50)::INT), 9) AS positive_rate FROM s GROUP BY 1")
def a16(spark: SparkSession, d: str) -> DataFrame:
    s = walk(spark, d).groupBy((F.col("stream") % 5).alias("kind"), "stream").agg(F.avg("value").alias("m"))
    return s.groupBy("kind").agg(F.count("*").alias("runs"), F.round(F.avg("m"), 9).alias("mean"), F.round(F.avg((F.col("m") > 50).cast("int")), 9).alias("positive_rate"))


@query("a31_inventory_flags", "SELECT user_id, bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 ELSE 8 END)::INT AS flags, count(*) AS n FROM events GROUP BY 1")
def a31(spark: SparkSession, d: str) -> DataFrame:
    bit = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "purchase", 4).otherwise(8)
    return t(spark, d, "events").groupBy("user_id").agg(F.bit_or(bit).alias("flags"), F.count("*").alias("n"))


@query("j14_cluster_template", f"""WITH {CLUSTERED}, g AS (SELECT template, count(*) AS n FROM cl GROUP BY 1 HAVING count(*) >= 3) SELECT stream, cluster, n AS template_count FROM cl JOIN g USING (template)""")
def j14(spark: SparkSession, d: str) -> DataFrame:
    cl = clustered(spark, d)
    g = cl.groupBy("template").agg(F.count("*").alias("template_count")).filter("template_count >= 3")
    return cl.join(g, "template").select("stream", "cluster", "template_count")


@query("j15_evidence_picks", f"""WITH {WALK}, a AS (SELECT 'symbol' AS evidence, symbol AS pick, count(*) AS n FROM walk GROUP BY symbol ORDER BY n DESC, pick LIMIT 1), b AS (SELECT 'user' AS evidence, stream::VARCHAR AS pick, count(*) AS n FROM walk GROUP BY stream ORDER BY n DESC, pick LIMIT 1) SELECT * FROM a UNION ALL SELECT * FROM b""")
def j15(spark: SparkSession, d: str) -> DataFrame:
    w = walk(spark, d)
    best = lambda name, c: w.groupBy(F.col(c).cast("string").alias("pick")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "pick").limit(1).select(F.lit(name).alias("evidence"), "pick", "n")
    return best("symbol", "symbol").unionByName(best("user", "stream"))


@query("j17_allowed_match", """SELECT event_id, event_type IN ('click', 'view') AND (props->>'$.k')::BIGINT < 50 AS allowed FROM events""")
def j17(spark: SparkSession, d: str) -> DataFrame:
    """Each row's command against a list of allowed ones with their own limits."""
    rules = F.array(F.struct(F.lit("click").alias("name"), F.lit(50).alias("below")), F.struct(F.lit("view").alias("name"), F.lit(50).alias("below")))
    k = F.from_json("props", "k long")["k"]
    return t(spark, d, "events").select("event_id", F.exists(rules, lambda r: (r["name"] == F.col("event_type")) & (k < r["below"])).alias("allowed"))


@query("u2_ordered_dedup", f"WITH {WALK} SELECT stream, symbol, min(pos)::BIGINT AS first_pos FROM walk GROUP BY ALL")
def u2(spark: SparkSession, d: str) -> DataFrame:
    return walk(spark, d).groupBy("stream", "symbol").agg(F.min("pos").alias("first_pos"))


@query("u4_appended_runs", "SELECT 'a' AS run, r_regionkey AS k FROM region UNION ALL SELECT 'b', n_regionkey FROM nation")
def u4(spark: SparkSession, d: str) -> DataFrame:
    a = t(spark, d, "region").select(F.lit("a").alias("run"), F.col("r_regionkey").alias("k"))
    return a.unionByName(t(spark, d, "nation").select(F.lit("b").alias("run"), F.col("n_regionkey").alias("k")))


@query("a10_window_composition", f"""WITH {SEQ}, w AS (SELECT item_id, unnest(range((length(seq) + 49) // 50)) AS win, seq FROM seqs), s AS (SELECT item_id, win, substr(seq, win * 50 + 1, 50) AS s FROM w)
SELECT item_id, win, length(s)::BIGINT AS n, round((length(s) - length(replace(replace(s, 'G', ''), 'C', ''))) / length(s), 9) AS gc FROM s""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    """Windows of pieces of binary: each is copied out at once, so the time is in proportion to the sequence."""
    pieces = chunked(seqs(spark, d), ["item_id"], "seq", 50 * 1024)
    w = pieces.select("item_id", "start", "piece", F.explode(F.sequence(F.lit(0), F.octet_length("piece") - 1, F.lit(50))).alias("at"))
    s = w.select("item_id", ((F.col("start") + F.col("at")) / 50).cast("long").alias("win"), F.substring(F.col("piece"), F.col("at") + 1, F.lit(50)).cast("string").alias("s"))
    return s.select("item_id", "win", F.length("s").cast("long").alias("n"), F.round((F.length("s") - F.length(F.translate("s", "GC", ""))) / F.length("s"), 9).alias("gc"))


@query("w18_coordinate_map", f"WITH {KM} SELECT item_id, pos, row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1 AS symbol_index FROM km")
def w18(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a sequence are numbered apart and their counts added, so a long sequence is many tasks' work."""
    return numbered_within(km(spark, d).select("item_id", "pos"), ["item_id"], F.floor(F.col("pos") / CHUNK), [F.col("pos")], "symbol_index")


@query("t6_window_ranking", f"WITH {WALK}, c AS (SELECT floor(sec / 86400)::BIGINT AS win, count(*) AS n, count(DISTINCT symbol) AS kinds FROM walk GROUP BY 1) SELECT win, n, kinds FROM c ORDER BY n DESC, kinds DESC, win LIMIT 10")
def t6(spark: SparkSession, d: str) -> DataFrame:
    c = walk(spark, d).groupBy(F.floor(F.col("sec") / 86400).alias("win"), "symbol").count().groupBy("win").agg(F.sum("count").alias("n"), F.count("*").alias("kinds"))
    return c.orderBy(F.col("n").desc(), F.col("kinds").desc(), "win").limit(10)


@query("t9_top_bottom", f"WITH {WALK}, s AS (SELECT stream, round(avg(value), 10) AS m FROM walk GROUP BY 1) (SELECT 'top' AS side, * FROM s ORDER BY m DESC, stream LIMIT 5) UNION ALL (SELECT 'bottom', * FROM s ORDER BY m, stream LIMIT 5)")
def t9(spark: SparkSession, d: str) -> DataFrame:
    s = walk(spark, d).groupBy("stream").agg(F.round(F.avg("value"), 10).alias("m"))
    top = s.orderBy(F.col("m").desc(), "stream").limit(5).select(F.lit("top").alias("side"), "stream", "m")
    return top.unionByName(s.orderBy("m", "stream").limit(5).select(F.lit("bottom").alias("side"), "stream", "m"))


@query("n5_family_shuffle", null_sql("family", 20))
def n5(spark: SparkSession, d: str) -> DataFrame:
    """States permuted among those of one hour of the day: the condition is kept, the order isn't."""
    return null_test(spark, d, ["family"], replicates=20)


_U = "('0x' || substr(md5(item_id || '|' || rep || '|' || place || '|{0}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_START = "len([i FOR i IN range(1, length({0}) + 1) IF regexp_matches(substr({0}, i, 12), '^AC[ACGT]{{{{4,8}}}}GT')])::BIGINT"


@query(
    "n6_gc_matched",
    f"""WITH {SEQ}, s AS (SELECT item_id, seq, length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq)::DOUBLE AS gc FROM seqs WHERE length(seq) > 0),
x AS (SELECT item_id, gc, rep, unnest(range(1, length(seq) + 1)) AS place FROM s, range(1, 11) r(rep)),
b AS (SELECT item_id, rep, place, CASE WHEN {_U.format(1)} < gc THEN CASE WHEN {_U.format(2)} < 0.5 THEN 'G' ELSE 'C' END ELSE CASE WHEN {_U.format(2)} < 0.5 THEN 'A' ELSE 'T' END END AS b FROM x),
d AS (SELECT item_id, rep, string_agg(b, '' ORDER BY place) AS seq FROM b GROUP BY ALL), h AS (SELECT item_id, {_START.format('seq').replace('{{', '{').replace('}}', '}')} AS h FROM d),
n AS (SELECT item_id, round(avg(h), 9) AS null_mean, round(stddev_pop(h), 6) AS null_sd FROM h GROUP BY 1)
SELECT item_id, {_START.format('seq').replace('{{', '{').replace('}}', '}')} AS observed, null_mean, null_sd FROM s JOIN n USING (item_id)""",
)
def n6(spark: SparkSession, d: str) -> DataFrame:
    """Motif hits in sequences of the same length and GC share, drawn base by base from hashes, beside the observed hits.

    A sequence's draws are made and counted within its row.
    """
    s = seqs(spark, d).filter("length(seq) > 0").withColumn("gc", F.length(F.regexp_replace("seq", "[^GC]", "")) / F.length("seq"))
    u = lambda rep, place, k: F.conv(F.left(F.md5(F.concat_ws("|", "item_id", rep, place, F.lit(k))), F.lit(8)), 16, 10).cast("long") / F.lit(2.0**32)
    base = lambda rep, p: F.when(u(rep, p, 1) < F.col("gc"), F.when(u(rep, p, 2) < 0.5, "G").otherwise("C")).otherwise(F.when(u(rep, p, 2) < 0.5, "A").otherwise("T"))
    drawn = s.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(10))))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.length("seq")), lambda p: base(F.col("rep"), p)), "")
    h = drawn.select("item_id", F.regexp_count("seq", F.lit(SKELETON)).cast("long").alias("observed"), F.regexp_count(text, F.lit(SKELETON)).alias("h"))
    return h.groupBy("item_id", "observed").agg(F.round(F.avg("h"), 9).alias("null_mean"), F.round(F.stddev_pop("h"), 6).alias("null_sd"))


@query("n9_control_table", "SELECT * FROM (VALUES ('window_shuffle', true), ('slot_shuffle', true), ('gc_matched', false)) v(control, required)")
def n9(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([("window_shuffle", True), ("slot_shuffle", True), ("gc_matched", False)], "control string, required boolean")


@query("s14_text_scrape", r"SELECT item_id, regexp_extract_all(text, '[0-9]+') AS numbers FROM benchmark")
def s14(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)).alias("numbers"))
