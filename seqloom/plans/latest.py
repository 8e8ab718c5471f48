"""Motifs of any length, long intervals, rings, online grammars, inventories, SQL functions, delimited files and fuller profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as own_sql
from ..operators.governance import document_state
from ..operators.intervals import overlaps
from ..operators.motifs import kmer_stats, motif_hits, skeleton_blocks
from ..operators.ranks import ring_neighbours
from ..operators.resample import released
from ..operators.sequence import pairs, rank_within
from ..operators.stats import entropy, top_mass
from ..session import checkpointed
from ..sources.artifacts import artifacts
from ..sources.sinks import scratch
from ..sources.streams import csv_symbols, duplications, log_motifs, log_windows
from ..streaming.windows import online_grammar
from .catalog import query, t
from .fields import FIELD, field
from .models import null_sql, null_test
from .motifs import FAMILIES, K, KM, SEQ, _IV, components, hamming_pairs, km, ov, seqs, top
from .streams import _MATRIX, WALK, coupling_of, pair_counts, walk
from .structure import TR, moves

# --- motifs of 3 to 40 letters.

_SIZES = (3, 5, 8, 13, 21, 40)
_PICK = " UNION ".join(f"SELECT {f}(substr(seq, 11, {n})) AS motif FROM seqs WHERE length(seq) >= {n + 10} AND NOT contains(substr(seq, 11, {n}), 'N')" for n in _SIZES for f in ("min", "max"))


@query(
    "x1b_motifs_of_any_length",
    f"""WITH {SEQ}, m AS (SELECT motif FROM ({_PICK}) WHERE motif IS NOT NULL), f AS (SELECT motif, motif AS form, '+' AS strand FROM m UNION ALL SELECT motif, reverse(translate(motif, 'ACGT', 'TGCA')), '-' FROM m),
p AS (SELECT item_id, seq, unnest(range(length(seq))) AS pos0 FROM seqs)
SELECT item_id, motif, strand, pos0::BIGINT AS pos0, (pos0 + length(motif))::BIGINT AS pos1 FROM p JOIN f ON substr(seq, (pos0 + 1)::INT, length(form)::INT) = form""",
)
def x1b(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of motifs of 3 to 40 letters on both strands, overlapping ones too."""
    s = seqs(spark, d)
    found = None
    for n in _SIZES:
        own = s.filter(F.length("seq") >= n + 10).select(F.substring("seq", 11, n).alias("m")).filter(~F.contains("m", F.lit("N"))).agg(F.min("m").alias("a"), F.max("m").alias("b"))
        own = own.select(F.explode(F.array("a", "b")).alias("motif"))
        found = own if found is None else found.unionByName(own)
    return motif_hits(s, ["item_id"], "seq", checkpointed(found.filter("motif IS NOT NULL").distinct()), chunk=64)


_LEN_A, _LEN_B, _GAP = 4, 3, 9


@query(
    "x4d_skeleton_blocks",
    f"""WITH {SEQ}, a AS (SELECT substr(seq, 1, {_LEN_A}) AS a, substr(seq, {_GAP + 1}, {_LEN_B}) AS b FROM seqs WHERE length(seq) >= {_GAP + _LEN_B} ORDER BY item_id LIMIT 1), v AS (SELECT item_id, unnest(range(0, length(seq), 40)) AS r FROM seqs),
p AS (SELECT item_id, seq, unnest(range(length(seq))) AS s FROM seqs), k AS (SELECT item_id, seq, s FROM p, a WHERE substr(seq, (s + 1)::INT, {_LEN_A}) = a.a AND substr(seq, (s + {_GAP} + 1)::INT, {_LEN_B}) = a.b)
SELECT DISTINCT k.item_id, 'r' || r // 40 % 3 AS name, s::BIGINT AS start, (s + {_GAP + _LEN_B})::BIGINT AS "end", substr(seq, (s + {_LEN_A} + 1)::INT, {_GAP - _LEN_A}) AS spacer, substr(seq, (s + 1)::INT, {_GAP + _LEN_B}) AS block
FROM k JOIN v ON v.item_id = k.item_id AND r <= s AND s + {_GAP + _LEN_B} <= r + 60""",
)
def x4d(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of one motif and another a fixed way on, whole inside named intervals, once for each name. The two are letters of the first sequence."""
    s = seqs(spark, d)
    first = s.filter(F.length("seq") >= _GAP + _LEN_B).orderBy("item_id").limit(1).select(F.substring("seq", 1, _LEN_A), F.substring("seq", _GAP + 1, _LEN_B)).first()
    at = F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(40)))
    v = s.filter("length(seq) > 0").select("item_id", at.alias("r")).select("item_id", F.col("r").cast("long").alias("r_start"), (F.col("r") + 60).cast("long").alias("r_end"), F.concat(F.lit("r"), F.floor(F.col("r") / 40) % 3).alias("name"))
    return skeleton_blocks(s, ["item_id"], "seq", v, first[0], first[1], _GAP)


# --- intervals of very unequal length.


@query(
    "j7c_long_intervals",
    """WITH a AS (SELECT o_custkey AS grp, o_orderkey, (epoch(o_orderdate) / 86400)::BIGINT * 1000 - 9000000 AS start, (10 ** (o_orderkey % 8))::BIGINT AS n FROM orders),
b AS (SELECT o_custkey AS grp, o_orderkey AS other, (epoch(o_orderdate) / 86400)::BIGINT * 1000 - 8999500 AS r_start, (10 ** ((o_orderkey + 3) % 8))::BIGINT AS m FROM orders)
SELECT o_orderkey, other, least(start + n, r_start + m) - greatest(start, r_start) AS overlap FROM a JOIN b USING (grp) WHERE start < r_start + m AND r_start < start + n""",
)
def j7c(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of 1 to 10 million units that overlap: copies grow with levels, not with length."""
    day = (F.unix_timestamp("o_orderdate") / 86400).cast("long") * 1000
    size = lambda k: F.pow(F.lit(10), F.pmod(k, F.lit(8))).cast("long")
    o = t(spark, d, "orders")
    a = o.select(F.col("o_custkey").alias("grp"), "o_orderkey", (day - 9_000_000).alias("start"), (day - 9_000_000 + size(F.col("o_orderkey"))).alias("end"))
    b = o.select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("other"), (day - 8_999_500).alias("r_start"), (day - 8_999_500 + size(F.col("o_orderkey") + 3)).alias("r_end"))
    return overlaps(a, b, ["grp"], 32).select("o_orderkey", "other", "overlap")


# --- a ring, and a grammar kept by event time.


@query(
    "w16_ring_step",
    """WITH n AS (SELECT event_id, value, coalesce(lag(value) OVER w, last_value(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS l,
  coalesce(lead(value) OVER w, first_value(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS r FROM events WINDOW w AS (ORDER BY event_id))
SELECT event_id, round(l, 9) AS left_value, round(r, 9) AS right_value, round(value + 0.1::DOUBLE * (l - 2 * value + r), 9) AS next_value FROM n""",
)
def w16(spark: SparkSession, d: str) -> DataFrame:
    """One diffusion step of all events' values as a ring in order of their ids."""
    n = ring_neighbours(t(spark, d, "events").select("event_id", "value"), "event_id", ["value"])
    step = F.col("value") + F.lit(0.1) * (F.col("left_value") - F.col("value") * 2 + F.col("right_value"))
    return n.select("event_id", F.round("left_value", 9).alias("left_value"), F.round("right_value", 9).alias("right_value"), F.round(step, 9).alias("next_value"))


@query("st3_online_grammar", """WITH p AS (SELECT user_id, event_type AS f, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events) SELECT user_id, f AS "from", t AS "to", count(*) AS count FROM p WHERE t IS NOT NULL GROUP BY ALL""")
def st3(spark: SparkSession, d: str) -> DataFrame:
    """Each user's transitions from a stream whose rows come out of order, counted as the watermark passes them: the batch result."""
    return online_grammar(spark, t(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id", "event_type", parts=4)


# --- an inventory of written files.


@query(
    "k5_artifact_inventory",
    """SELECT 'parquet' AS kind, (SELECT count(*) FROM nation) AS records, (SELECT count(*) > 0 FROM nation) AS found, false AS broken UNION ALL SELECT 'orc', NULL, true, false UNION ALL SELECT 'json', NULL, true, false
UNION ALL SELECT 'gzip', NULL, true, false UNION ALL SELECT 'other', NULL, true, false""",
)
def k5(spark: SparkSession, d: str) -> DataFrame:
    """Kinds, counts and faults of files of five formats, told by heads and footers."""
    path, n = scratch(spark, "artifacts"), t(spark, d, "nation")
    n.write.parquet(f"{path}/a")
    n.write.orc(f"{path}/b")
    n.write.json(f"{path}/c")
    n.write.option("compression", "gzip").csv(f"{path}/d")
    n.write.option("header", True).csv(f"{path}/e")
    found = artifacts(spark, path).filter("kind <> 'empty'")
    return found.groupBy("kind").agg(F.sum("records").alias("records"), (F.count("*") > 0).alias("found"), F.max(F.col("error") != "").alias("broken"))


# --- SQL functions.


@query(
    "fs1_sql_functions",
    f"""WITH {FIELD}, a AS (SELECT raw * 1000 + dom * 100 + floor(lock * 20)::INT AS state, count(*) AS n FROM field GROUP BY 1), {SEQ}, w AS (SELECT unnest(range(length(seq) - {K - 1})) AS p, seq FROM seqs WHERE length(seq) >= {K}),
b AS (SELECT substr(seq, (p + 1)::INT, {K}) AS kmer FROM w)
SELECT 'state' AS what, state::VARCHAR AS key, n FROM a UNION ALL SELECT 'kmer', kmer, count(*) FROM b WHERE NOT contains(kmer, 'N') GROUP BY kmer
UNION ALL SELECT 'byte', (('0x' || h)::INT)::VARCHAR, count(*) FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM benchmark) GROUP BY h
UNION ALL SELECT 'token', w, count(*) FROM (SELECT unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS w FROM benchmark) GROUP BY w""",
)
def fs1(spark: SparkSession, d: str) -> DataFrame:
    """The field and three sources, by SQL text alone."""
    from .fields import grid

    own_sql.register(spark)
    grid(spark, d).createOrReplaceTempView("fs1_grid")
    t(spark, d, "benchmark").createOrReplaceTempView("fs1_text")
    seqs(spark, d).createOrReplaceTempView("fs1_seqs")
    return spark.sql(f"""
SELECT 'state' AS what, CAST(field_state(field_operators(x)) AS STRING) AS key, count(*) AS n FROM fs1_grid GROUP BY 2
UNION ALL SELECT 'kmer', k.kmer, count(*) FROM fs1_seqs, LATERAL seq_kmers(seq, {K}) k GROUP BY k.kmer
UNION ALL SELECT 'byte', CAST(b.symbol AS STRING), count(*) FROM fs1_text, LATERAL seq_bytes(CAST(text AS BINARY)) b GROUP BY b.symbol
UNION ALL SELECT 'token', w.token, count(*) FROM fs1_text, LATERAL seq_tokens(text) w GROUP BY w.token""")


# --- delimited files and duplications.


@query(
    "s5b_csv_stream",
    """WITH v AS (SELECT l_extendedprice AS x FROM lineitem WHERE (l_orderkey + l_linenumber) % 11 <> 0), r AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT 'own' AS range, CASE WHEN x <= lo THEN 0 WHEN x >= hi THEN 15 ELSE floor((x - lo) * (15::DOUBLE / (hi - lo))) END::BIGINT AS symbol FROM v, r
UNION ALL SELECT 'given', CASE WHEN x <= 20000 THEN 0 WHEN x >= 60000 THEN 15 ELSE floor((x - 20000) * (15::DOUBLE / 40000)) END::BIGINT FROM v) SELECT range, symbol, count(*) AS count FROM b GROUP BY ALL""",
)
def s5b(spark: SparkSession, d: str) -> DataFrame:
    """A column of delimited files with headers and bad rows, by its own range and by a given one."""
    path = scratch(spark, "delimited")
    x = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 11 == 0, F.when(F.col("l_linenumber") % 2 == 0, "bad").otherwise("nan")).otherwise(F.col("l_extendedprice").cast("string"))
    line = F.concat_ws(";", F.col("l_orderkey").cast("string"), F.lit('a "quote'), x, F.lit("more"))
    rows = t(spark, d, "lineitem").select(line.alias("value"))
    rows.selectExpr("split(value, ';') AS c").selectExpr("c[0] AS a", "c[1] AS b", "c[2] AS x", "c[3] AS more").write.option("sep", ";").option("header", True).option("quote", "\u0000").option("escapeQuotes", False).csv(path)
    own, given = (csv_symbols(spark, path, 2, 16, ";", True, low, high) for low, high in ((None, None), (20000.0, 60000.0)))
    return own.select(F.lit("own").alias("range"), "symbol").unionByName(given.select(F.lit("given").alias("range"), "symbol")).groupBy("range", "symbol").count()


@query(
    "s12b_duplications",
    """SELECT 'chr7' AS chrom, o_orderkey AS start, o_orderkey + 50 AS "end", CASE WHEN o_orderkey % 3 = 0 THEN 'chr7:' || o_orderkey || '-' || o_orderkey + 50 ELSE 'd' || o_custkey END AS name, o_custkey % 900 AS score, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '_' END AS strand,
'chr' || o_custkey % 20 || ':' || o_custkey || '-' || o_custkey + 50 AS other, CASE WHEN o_orderkey % 5 <> 0 THEN round(o_custkey % 100 / 100.0::DOUBLE, 2) END AS fraction FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey % 9 <> 2""",
)
def s12b(spark: SparkSession, d: str) -> DataFrame:
    """One chromosome of a gzipped dump of segmental duplications with short and commented lines; some rows lack a name or a fraction."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    head = [F.lit("585"), F.when(k % 4 == 1, "chr7").otherwise("chr8"), text(k), text(k + 50), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("d"), text(c))), text(c % 900), F.when(k % 2 == 0, "+").otherwise("_"), F.concat(F.lit("chr"), text(c % 20)), text(c), text(c + 50)]
    rest = F.when(k % 5 != 0, F.concat(F.lit("\t0" * 16 + "\t"), text(F.round(c % 100 / 100.0, 2)), F.lit("\t0"))).otherwise("")
    line = F.when(k % 9 == 2, F.when(k % 2 == 0, "#bin\tchrom").otherwise("585\tchr7\t1\t2")).otherwise(F.concat(F.concat_ws("\t", *head), rest))
    path = scratch(spark, "duplications")
    t(spark, d, "orders").select(line.alias("value")).write.option("compression", "gzip").text(path)
    return duplications(spark, path, "chr7")


# --- fuller profiles.

_CELL = f"""{_MATRIX}, ts AS (SELECT stream, symbol, count(*) AS c FROM sp WHERE pos >= 1 AND pos < cut GROUP BY ALL), bs AS (SELECT stream, symbol AS b FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY c DESC, symbol) AS r FROM ts) WHERE r = 1),
ba AS (SELECT "row", col, hits / test_transitions AS a, (SELECT sum(c) FROM te WHERE te.stream = m."row" AND te.nxt = bs.b) / test_transitions AS base, 1 - hits / test_transitions AS surprise FROM m JOIN bs ON bs.stream = m.col),
cells AS (SELECT *, a - coalesce(base, 0) AS lift FROM ba)"""


def lift_cells(spark: SparkSession, d: str) -> DataFrame:
    """row, col, a (accuracy), lift over always saying the grammar's own commonest training symbol, surprise of each cell."""
    counted = pair_counts(spark, d)
    m = coupling_of(counted)
    said = rank_within(counted.filter("tr > 0").groupBy(F.col("stream").alias("col"), F.col("to").alias("b")).agg(F.sum("tr").alias("c")), ["col"], [F.col("c").desc(), F.col("b")], 1).select("col", "b")
    ends = counted.filter("count > 0").groupBy(F.col("stream").alias("row"), F.col("to").alias("b")).agg(F.sum("count").alias("n"))
    both = m.join(said, "col").join(ends, ["row", "b"], "left")
    a = F.col("kgram_accuracy")
    return both.select("row", "col", a.alias("a"), (a - F.coalesce(F.col("n"), F.lit(0)) / F.col("test_transitions")).alias("lift"), (1 - a).alias("surprise"))


@query(
    "a18d_profiles",
    f"""WITH {_CELL}, x AS (SELECT * FROM cells WHERE "row" <> col), o AS (SELECT 'carrier' AS side, col AS stream, * FROM x UNION ALL SELECT 'receiver', "row", * FROM x)
SELECT side, stream, count(*) AS cells, round(avg(lift), 9) AS avg_cross_lift, round(avg(a), 9) AS avg_cross_accuracy, round(avg(surprise), 9) AS avg_cross_surprise, round(min(lift), 9) AS min_cross_lift, round(max(lift), 9) AS max_cross_lift FROM o GROUP BY ALL""",
)
def a18d(spark: SparkSession, d: str) -> DataFrame:
    """Each stream as a grammar that others are read by, and as a text that others' grammars read."""
    x = lift_cells(spark, d).filter(F.col("row") != F.col("col"))
    both = x.select(F.lit("carrier").alias("side"), F.col("col").alias("stream"), "a", "lift", "surprise").unionByName(x.select(F.lit("receiver").alias("side"), F.col("row").alias("stream"), "a", "lift", "surprise"))
    r = lambda c, n: F.round(c, 9).alias(n)
    return both.groupBy("side", "stream").agg(F.count("*").alias("cells"), r(F.avg("lift"), "avg_cross_lift"), r(F.avg("a"), "avg_cross_accuracy"), r(F.avg("surprise"), "avg_cross_surprise"), r(F.min("lift"), "min_cross_lift"), r(F.max("lift"), "max_cross_lift"))


@query(
    "a18e_self_against_cross",
    f"""WITH {_CELL}, s AS (SELECT "row" AS stream, lift, a, surprise FROM cells WHERE "row" = col), o AS (SELECT "row" AS stream, avg(lift) AS v FROM cells WHERE "row" <> col GROUP BY 1), i AS (SELECT col AS stream, avg(lift) AS v FROM cells WHERE "row" <> col GROUP BY 1)
SELECT s.stream, round(s.lift, 9) AS self_lift, round(a, 9) AS self_accuracy, round(surprise, 9) AS self_surprise, round(o.v, 9) AS avg_out_cross_lift, round(i.v, 9) AS avg_in_cross_lift, round(s.lift - o.v, 9) AS self_minus_out_cross, round(s.lift - i.v, 9) AS self_minus_in_cross FROM s JOIN o USING (stream) JOIN i USING (stream)""",
)
def a18e(spark: SparkSession, d: str) -> DataFrame:
    c = lift_cells(spark, d)
    own = F.col("row") == F.col("col")
    # A cell goes to its row and to its column, so one grouping has a stream's own cell and both means.
    both = c.select(F.col("row").alias("stream"), own.alias("self"), F.lit(True).alias("out"), "a", "lift", "surprise").unionByName(c.filter(~own).select(F.col("col").alias("stream"), F.lit(False).alias("self"), F.lit(False).alias("out"), "a", "lift", "surprise"))
    s = F.col("self")
    g = both.groupBy("stream").agg(*[F.max(F.when(s, F.col(x))).alias(x) for x in ("lift", "a", "surprise")], F.avg(F.when(~s & F.col("out"), F.col("lift"))).alias("o"), F.avg(F.when(~F.col("out"), F.col("lift"))).alias("i"))
    g = g.filter("lift IS NOT NULL AND o IS NOT NULL AND i IS NOT NULL")
    r = lambda x, n: F.round(x, 9).alias(n)
    return g.select("stream", r(F.col("lift"), "self_lift"), r(F.col("a"), "self_accuracy"), r(F.col("surprise"), "self_surprise"), r(F.col("o"), "avg_out_cross_lift"), r(F.col("i"), "avg_in_cross_lift"), r(F.col("lift") - F.col("o"), "self_minus_out_cross"), r(F.col("lift") - F.col("i"), "self_minus_in_cross"))


_SCORES = {"entropy_bits": -1, "edge_entropy_bits": -1, "top2_mass": 1, "edge_top2_mass": 1, "unique_symbols": -1, "unique_edges": -1}


@query(
    "w17b_six_scores",
    f"""WITH {WALK}, p AS (SELECT floor(sec / 86400)::BIGINT AS win, symbol, symbol || '>' || lead(symbol) OVER (PARTITION BY stream ORDER BY pos) AS edge FROM walk),
s AS (SELECT win, symbol AS x, count(*) AS n FROM p GROUP BY ALL), e AS (SELECT win, edge AS x, count(*) AS n FROM p WHERE edge IS NOT NULL GROUP BY ALL),
{', '.join(f"{v}m AS (SELECT win, -sum(q * log2(q)) AS h, sum(CASE WHEN r <= 2 THEN q ELSE 0 END) AS m, count(*) AS u FROM (SELECT win, n / sum(n) OVER (PARTITION BY win) AS q, row_number() OVER (PARTITION BY win ORDER BY n DESC, x) AS r FROM {v}) GROUP BY 1)" for v in 'se')},
c AS (SELECT sm.win, round(sm.h, 9) AS entropy_bits, round(em.h, 9) AS edge_entropy_bits, round(sm.m, 9) AS top2_mass, round(em.m, 9) AS edge_top2_mass, sm.u AS unique_symbols, em.u AS unique_edges FROM sm JOIN em USING (win)),
b AS (SELECT {', '.join(f'avg({k}) AS m_{k}, stddev_pop({k}) AS s_{k}' for k in _SCORES)} FROM c)
SELECT win, round(({' + '.join(f'CASE WHEN s_{k} > 1e-9 THEN greatest(0, {s} * ({k} - m_{k}) / s_{k}) ELSE 0 END' for k, s in _SCORES.items())}) / 6, 6) AS score FROM c, b""",
)
def w17b(spark: SparkSession, d: str) -> DataFrame:
    """Mean of six one-sided z-scores of each day against all: little entropy, much mass, few kinds, of symbols and of pairs."""
    from pyspark.sql.window import Window

    w = walk(spark, d)
    to = F.lead("symbol").over(Window.partitionBy("stream").orderBy("pos"))
    p = w.select(F.floor(F.col("sec") / 86400).alias("win"), "symbol", F.concat("symbol", F.lit(">"), to).alias("edge"))

    def measures(of: str, prefix: str, unique: str) -> DataFrame:
        counts = p.filter(F.col(of).isNotNull()).groupBy("win", of).count()
        h = entropy(counts, ["win"]).select("win", F.round("entropy", 9).alias(f"{prefix}entropy_bits"), F.col("kinds").alias(unique))
        return h.join(top_mass(counts, ["win"], [2], of).select("win", F.round("top2_mass", 9).alias(f"{prefix}top2_mass")), "win")

    c = checkpointed(measures("symbol", "", "unique_symbols").join(measures("edge", "edge_", "unique_edges"), "win"))  # one row for each day
    b = c.agg(*[f(k).alias(f"{n}_{k}") for k in _SCORES for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [F.when(F.col(f"s_{k}") > 1e-9, F.greatest(F.lit(0.0), (F.col(k) - F.col(f"m_{k}")) * sign / F.col(f"s_{k}"))).otherwise(0.0) for k, sign in _SCORES.items()]
    return c.crossJoin(F.broadcast(b)).select("win", F.round(sum(z[1:], z[0]) / 6, 6).alias("score"))


@query(
    "a12b_family_profiles",
    f"""WITH RECURSIVE {FAMILIES}, gp AS (SELECT item_id, kmer, pos - lag(pos) OVER (PARTITION BY item_id, kmer ORDER BY pos) AS gap FROM km),
ks AS (SELECT item_id, kmer, count(*) AS n, coalesce(avg(gap), 0) AS gm, coalesce(stddev_pop(gap), 0) AS gs FROM gp GROUP BY ALL), kk AS (SELECT kmer, sum(n * gm) AS gm, sum(n * gs) AS gs FROM ks GROUP BY 1), kl AS (SELECT component, count(DISTINCT item_id) AS labels FROM fm JOIN ks USING (kmer) GROUP BY 1),
rv AS (SELECT fm.component, fm.kmer, fm.count, coalesce(r.count, 0) AS rc FROM fm LEFT JOIN top r ON r.kmer = reverse(translate(fm.kmer, 'ACGT', 'TGCA'))), tt AS (SELECT component, sum(count) AS total FROM fm GROUP BY 1)
SELECT component, count(*) AS size, any_value(total)::BIGINT AS total_count, max(count)::BIGINT AS top_count, any_value(labels) AS labels, round(-sum(count / total * log2(count / total)), 6) + 0.0 AS member_entropy_bits, round(sum(rc) / any_value(total), 9) AS rc_balance, round(sum(gm) / any_value(total), 6) AS gap_mean_weighted, round(sum(gs) / any_value(total), 6) AS gap_std_weighted
FROM rv JOIN tt USING (component) JOIN kk USING (kmer) JOIN kl USING (component) GROUP BY component""",
)
def a12b(spark: SparkSession, d: str) -> DataFrame:
    """Families by their members' entropy, reverse complements, gaps (weighted by count) and sequences."""
    m = checkpointed(top(spark, d))
    fam = checkpointed(components(hamming_pairs(m, K, 1), m, "kmer").join(m, "kmer"))
    rc = m.select(F.reverse(F.translate("kmer", "ACGT", "TGCA")).alias("kmer"), F.col("count").alias("rc"))
    stats = kmer_stats(km(spark, d), ["item_id"])
    gaps = stats.groupBy("kmer").agg(F.sum(F.col("count") * F.col("gap_mean")).alias("gm"), F.sum(F.col("count") * F.col("gap_std")).alias("gs"))
    labels = fam.join(stats.select("kmer", "item_id"), "kmer").select("component", "item_id").distinct().groupBy("component").agg(F.count("*").alias("labels"))
    total = fam.groupBy("component").agg(F.sum("count").alias("total"))
    x = fam.join(rc, "kmer", "left").join(gaps, "kmer").join(total, "component")
    p = F.col("count") / F.col("total")
    g = x.groupBy("component", "total").agg(F.count("*").alias("size"), F.max("count").alias("top_count"), F.sum(-p * F.log2(p)).alias("h"), F.sum("rc").alias("rc"), F.sum("gm").alias("gm"), F.sum("gs").alias("gs")).join(labels, "component")
    n = F.col("total")
    return g.select("component", "size", n.alias("total_count"), "top_count", "labels", (F.round("h", 6) + F.lit(0.0)).alias("member_entropy_bits"), F.round(F.coalesce("rc", F.lit(0)) / n, 9).alias("rc_balance"), F.round(F.col("gm") / n, 6).alias("gap_mean_weighted"), F.round(F.col("gs") / n, 6).alias("gap_std_weighted"))


_OPS = range(1, 6)


@query(
    "a8c_variant_records",
    f"""WITH {FIELD}, v AS (SELECT *, raw * 1000 + dom * 100 + floor(lock * 20)::INT AS variant FROM field), w AS (SELECT *, lag(variant) OVER o AS before, lead(variant) OVER o AS after FROM v WINDOW o AS (PARTITION BY stream ORDER BY i)),
{', '.join(f'{n}c AS (SELECT variant, {n}, count(*) AS c FROM w WHERE {n} IS NOT NULL AND {n} <> variant GROUP BY ALL), {n}b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY c DESC, {n}) AS r FROM {n}c) WHERE r = 1)' for n in ('before', 'after'))},
g AS (SELECT variant, count(*) AS samples, {', '.join(f'round(ln(1 + abs(avg(k{j}))), 6) AS k{j}_mean, round(ln(1 + max(abs(k{j}))), 6) AS k{j}_absmax, round(ln(1 + avg(s{j})), 6) AS s{j}_mean, round(ln(1 + max(s{j})), 6) AS s{j}_absmax' for j in _OPS)} FROM v GROUP BY 1)
SELECT g.*, beforeb.before AS predecessor, beforeb.c AS predecessor_count, afterb.after AS successor, afterb.c AS successor_count FROM g LEFT JOIN beforeb USING (variant) LEFT JOIN afterb USING (variant)""",
)
def a8c(spark: SparkSession, d: str) -> DataFrame:
    """Each variant's means and extremes of the five operators and their scores (as logarithms), and its commonest neighbours."""
    v = checkpointed(field(spark, d).withColumn("variant", (F.col("raw") * 1000 + F.col("dom") * 100 + F.floor(F.col("lock") * 20)).cast("int")))
    log = lambda x, n: F.round(F.ln(x + 1), 6).alias(n)
    g = v.groupBy("variant").agg(F.count("*").alias("samples"), *[m for j in _OPS for m in (log(F.abs(F.avg(f"k{j}")), f"k{j}_mean"), log(F.max(F.abs(f"k{j}")), f"k{j}_absmax"), log(F.avg(f"s{j}"), f"s{j}_mean"), log(F.max(f"s{j}"), f"s{j}_absmax"))])
    p = pairs(v.select("stream", "i", "variant"), ["stream"], ["i"], "variant").filter(F.col("from") != F.col("to")).groupBy("from", "to").count()
    for own, other, name in (("to", "from", "predecessor"), ("from", "to", "successor")):
        best = rank_within(p, [own], [F.col("count").desc(), F.col(other)], 1).select(F.col(own).alias("variant"), F.col(other).alias(name), F.col("count").alias(f"{name}_count"))
        g = g.join(best, "variant", "left")
    return g


# --- logs and documents.


@query(
    "s14b_log_records",
    f"""WITH {KM}, m AS (SELECT kmer, count(*) AS n FROM km GROUP BY 1), w AS (SELECT item_id, length(seq) AS len FROM seqs)
SELECT 'motif' AS what, kmer AS label, n AS weight, round(n / 64.0::DOUBLE, 6) AS measure FROM m UNION ALL SELECT 'window', 'w' || item_id, len, round(len / 128.0::DOUBLE, 6) FROM w""",
)
def s14b(spark: SparkSession, d: str) -> DataFrame:
    """Motif tables and scan lines among other lines of log files; a motif's second row doesn't count."""
    path = scratch(spark, "logs")
    text = lambda x: x.cast("string")
    m = km(spark, d).groupBy("kmer").count()
    row = lambda weight: F.concat(F.lit("| 1 | 0 | "), "kmer", F.lit(" | "), text(weight), F.lit(" | "), text(F.col("count") / 64.0), F.lit(" | 1.0 |"))
    both = F.concat(row(F.col("count")), F.lit("\nnothing here\n| a | b |\n"), row(F.col("count") + 1))
    w = seqs(spark, d).select("item_id", F.length("seq").alias("n"))
    line = F.concat(F.lit("12:00 some_signature_scan v1: w"), text(F.col("item_id")), F.lit(" base=[0,"), text(F.col("n")), F.lit("] len="), text(F.col("n")), F.lit(" hits=1 rc=2 density="), text(F.col("n") / 128.0), F.lit(" rc_balance=0.5 period=3 rate=1e-3"))
    m.select(both.alias("value")).write.mode("append").text(path)
    w.select(line.alias("value")).write.mode("append").text(path)
    a = log_motifs(spark, path).select(F.lit("motif").alias("what"), F.col("motif").alias("label"), "weight", F.round("rc_balance", 6).alias("measure"))
    return a.unionByName(log_windows(spark, path).select(F.lit("window").alias("what"), "label", F.col("length").alias("weight"), F.round("density", 6).alias("measure")))


@query("g1b_document_state", """SELECT doc_id, 'd' || doc_id || '.txt' AS document_name, CASE WHEN source IS NULL OR source = '' THEN 'text' ELSE source END AS document_type, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL""")
def g1b(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as state JSON, read back from it."""
    docs = t(spark, d, "documents").filter("text IS NOT NULL")
    state = docs.select("doc_id", document_state(F.concat(F.lit("store/"), F.col("doc_id").cast("string").alias("x"), F.lit("x/d"), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"), kind=F.col("source")).alias("state"))
    s = F.from_json("state", "document_name string, document_type string, authoritative_document string")
    return state.select("doc_id", s.alias("s")).select("doc_id", "s.document_name", "s.document_type", F.sha2("s.authoritative_document", 256).alias("sha256"))


# --- a list of controls with its verdict.

_Z, _P, _SHARE = 5.0, 0.05, 0.5
_SHUFFLES = {"state_shuffle": "stream", "window_stratified_shuffle": "win", "slot_shuffle": "slot"}


@query(
    "n8b_control_list",
    f"""WITH zz AS ({' UNION ALL '.join(f"SELECT '{n}' AS control, z, p FROM ({null_sql(w)})" for n, w in _SHUFFLES.items())}),
{_IV}, fo AS (SELECT count(DISTINCT o_orderkey) AS n FROM ov WHERE o_orderkey <> other), tt AS (SELECT count(*) AS n FROM orders),
{TR[5 if TR.startswith('WITH ') else 0:]}, ct AS (SELECT f AS s, family, t AS x, count(*) AS n FROM tr GROUP BY ALL), rt AS (SELECT n / sum(n) OVER (PARTITION BY s, family) AS rate FROM ct),
g AS (SELECT control, CASE WHEN z IS NULL THEN 'missing' WHEN z >= {_Z} AND p <= {_P} THEN 'pass' ELSE 'natural_model_not_broken' END AS status FROM zz
UNION ALL SELECT 'bounded_rates', CASE WHEN bool_and(rate BETWEEN 0 AND 1) THEN 'pass' ELSE 'fail' END FROM rt
UNION ALL SELECT 'interval_overlap', CASE WHEN fo.n / tt.n <= {_SHARE} THEN 'pass' ELSE 'degraded_pass' END FROM fo, tt)
SELECT control, status FROM g UNION ALL SELECT 'final', CASE WHEN bool_and(status = 'pass') THEN 'final_scoped_claim_released' WHEN bool_and(status IN ('pass', 'degraded_pass')) THEN 'strong_but_degraded' ELSE 'not_released' END FROM g""",
)
def n8b(spark: SparkSession, d: str) -> DataFrame:
    """Three shuffles, bounded rates and the share of intervals that others overlap, each with its status, and whether all together release the claim."""
    from ..operators.structure import conditional_rates

    shuffles = None
    for name, within in _SHUFFLES.items():
        one = null_test(spark, d, [within]).select(F.lit(name).alias("control"), F.when(F.col("z").isNull(), "missing").when((F.col("z") >= _Z) & (F.col("p") <= _P), "pass").otherwise("natural_model_not_broken").alias("status"))
        shuffles = one if shuffles is None else shuffles.unionByName(one)
    rate = F.col("rate_from_family")
    rates = conditional_rates(moves(spark, d)).agg(F.bool_and((rate >= 0) & (rate <= 1)).alias("ok")).select(F.lit("bounded_rates").alias("control"), F.when(F.col("ok"), "pass").otherwise("fail").alias("status"))
    held = ov(spark, d).filter("o_orderkey <> other").select("o_orderkey").distinct().agg(F.count("*").alias("n"))
    share = held.crossJoin(F.broadcast(t(spark, d, "orders").agg(F.count("*").alias("all")))).select(F.lit("interval_overlap").alias("control"), F.when(F.col("n") / F.col("all") <= _SHARE, "pass").otherwise("degraded_pass").alias("status"))
    return released(checkpointed(shuffles.unionByName(rates).unionByName(share)))
