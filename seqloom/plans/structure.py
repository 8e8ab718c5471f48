"""Clusters, templates, states and their statistics over the events of each user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranks import ranked, running_total
from ..operators.sequence import along
from ..operators.structure import clusters, conditional_rates, determinism, gcd_of, nearest_family, phase_slot, templates, transitions
from .catalog import query
from .streams import WALK, walk

GAP, HOUR, DAY = 21600, 3600, 86400
CENTERS, TOLERANCE = [0, 3600, 21600, 86400], 3000


def hits(spark: SparkSession, d: str) -> DataFrame:
    return walk(spark, d).withColumn("strand", F.when(F.col("event_id") % 2 == 0, "+").otherwise("-"))


HITS = f"{WALK}, hits AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM walk)"
CLUSTERED = f"""{HITS}, f AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY stream ORDER BY sec, event_id) > {GAP} THEN 1 ELSE 0 END AS far FROM hits),
c AS (SELECT *, sum(far) OVER (PARTITION BY stream ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM f),
o AS (SELECT *, floor((sec - min(sec) OVER (PARTITION BY stream, cluster)) / {HOUR}.0)::BIGINT AS o FROM c),
cl AS (SELECT stream, cluster, min(sec) AS start, max(sec) AS "end", max(sec) - min(sec) AS span, count(*) AS n_hits, count(DISTINCT symbol) AS n_motifs, string_agg(DISTINCT strand, '' ORDER BY strand) AS strand_set,
  string_agg(o || ':' || symbol || ':' || strand, '|' ORDER BY o, symbol, strand) AS template FROM o GROUP BY ALL)"""


def clustered(spark: SparkSession, d: str) -> DataFrame:
    return clusters(hits(spark, d), "stream", "sec", GAP, ["event_id"], unit=HOUR)


@query("w6_session_clusters", f'WITH {CLUSTERED} SELECT stream, cluster, start, "end", span, n_hits, n_motifs, strand_set FROM cl')
def w6(spark: SparkSession, d: str) -> DataFrame:
    return clustered(spark, d).drop("template")


@query("w7_templates", f"""WITH {CLUSTERED}, g AS (SELECT template, count(*) AS count, max(n_hits) AS n_hits, max(n_motifs) AS n_motifs, max(strand_set) AS strand_set FROM cl GROUP BY 1)
SELECT *, substr(sha256(template), 1, 12) AS sha12, row_number() OVER (ORDER BY count DESC, template)::INT AS template_rank FROM g""")
def w7(spark: SparkSession, d: str) -> DataFrame:
    return templates(clustered(spark, d))


@query("a26_cluster_counts", f"""WITH {CLUSTERED} SELECT floor(start / {DAY}.0)::BIGINT AS win, count(*) AS clusters, sum(n_hits)::BIGINT AS hits, sum((n_motifs >= 3)::INT)::BIGINT AS complete FROM cl GROUP BY 1""")
def a26(spark: SparkSession, d: str) -> DataFrame:
    return clustered(spark, d).groupBy(F.floor(F.col("start") / DAY).alias("win")).agg(F.count("*").alias("clusters"), F.sum("n_hits").alias("hits"), F.sum((F.col("n_motifs") >= 3).cast("int")).alias("complete"))


@query("x3_complete_clusters", f"""WITH {CLUSTERED} SELECT stream, cluster FROM cl WHERE contains(template, 'click') AND contains(template, 'view')""")
def x3(spark: SparkSession, d: str) -> DataFrame:
    """Clusters that hold every motif of a set."""
    return clustered(spark, d).filter(F.contains("template", F.lit("click")) & F.contains("template", F.lit("view"))).select("stream", "cluster")


@query("w8_prev_next_delta", f"""WITH {HITS} SELECT stream, event_id, sec - lag(sec) OVER w AS prev_delta, lead(sec) OVER w - sec AS next_delta FROM hits WINDOW w AS (PARTITION BY stream ORDER BY sec, event_id)""")
def w8(spark: SparkSession, d: str) -> DataFrame:
    w = along(["stream"], ["sec", "event_id"])
    return hits(spark, d).select("stream", "event_id", (F.col("sec") - F.lag("sec").over(w)).alias("prev_delta"), (F.lead("sec").over(w) - F.col("sec")).alias("next_delta"))


def _family_sql(x: str) -> str:
    """Nearest of the centers; they are far enough apart for the tolerance to leave one at most."""
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN abs({x} - {c}) <= {TOLERANCE} AND {' AND '.join(f'abs({x} - {c}) {"<" if o < c else "<="} abs({x} - {o})' for o in CENTERS if o != c)} THEN '{c:+d}'" for c in CENTERS) + " ELSE 'other' END"


@query("p12_nearest_family", f"""WITH {HITS}, x AS (SELECT stream, event_id, lead(sec) OVER (PARTITION BY stream ORDER BY sec, event_id) - sec AS dd FROM hits) SELECT stream, event_id, {_family_sql('dd')} AS family FROM x""")
def p12(spark: SparkSession, d: str) -> DataFrame:
    w = along(["stream"], ["sec", "event_id"])
    return hits(spark, d).withColumn("dd", F.lead("sec").over(w) - F.col("sec")).select("stream", "event_id", nearest_family(F.col("dd"), CENTERS, TOLERANCE).alias("family"))


TR = f"""{HITS}, tr0 AS (SELECT stream, symbol AS f, lead(symbol) OVER w AS t, lead(sec) OVER w - sec AS dd, sec FROM hits WINDOW w AS (PARTITION BY stream ORDER BY sec, event_id)),
tr AS (SELECT *, {_family_sql('dd')} AS family FROM tr0 WHERE t IS NOT NULL)"""


def moves(spark: SparkSession, d: str) -> DataFrame:
    tr = transitions(hits(spark, d), "stream", "sec", ["event_id"], "symbol")
    return tr.withColumn("family", nearest_family(F.col("delta"), CENTERS, TOLERANCE))


@query("w9_prev_next_state", f"""WITH {HITS} SELECT event_id, lag(symbol) OVER w AS prev_state, symbol AS state, lead(symbol) OVER w AS next_state FROM hits WINDOW w AS (PARTITION BY stream ORDER BY sec, event_id)""")
def w9(spark: SparkSession, d: str) -> DataFrame:
    w = along(["stream"], ["sec", "event_id"])
    return hits(spark, d).select("event_id", F.lag("symbol").over(w).alias("prev_state"), F.col("symbol").alias("state"), F.lead("symbol").over(w).alias("next_state"))


@query("w10_state_ids", f"""WITH {HITS}, c AS (SELECT symbol || strand AS state, count(*) AS count FROM hits GROUP BY 1) SELECT state, count, format('S{{:03d}}', row_number() OVER (ORDER BY count DESC, state)) AS state_id FROM c""")
def w10(spark: SparkSession, d: str) -> DataFrame:
    c = hits(spark, d).groupBy(F.concat("symbol", "strand").alias("state")).count()
    return ranked(c, [F.col("count").desc(), F.col("state")]).select("state", "count", F.format_string("S%03d", "rank").alias("state_id"))


@query("a29_state_table", f"""WITH {HITS}, s AS (SELECT symbol, count(*) AS count, min(sec) AS first_sec, max(sec) AS last_sec FROM hits GROUP BY 1),
v AS (SELECT symbol, strand, count(*) AS n FROM hits GROUP BY ALL), w AS (SELECT symbol, floor(sec / {DAY}.0)::BIGINT AS win, count(*) AS n FROM hits GROUP BY ALL)
SELECT s.symbol, s.count, first_sec, last_sec, (SELECT strand FROM v WHERE v.symbol = s.symbol ORDER BY n DESC, strand LIMIT 1) AS dominant_strand, (SELECT win FROM w WHERE w.symbol = s.symbol ORDER BY n DESC, win LIMIT 1) AS dominant_window FROM s""")
def a29(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).withColumn("win", F.floor(F.col("sec") / DAY))
    cells = h.groupBy("symbol", "strand", "win").agg(F.count("*").alias("n"), F.min("sec").alias("lo"), F.max("sec").alias("hi"))
    whole = cells.groupBy("symbol").agg(F.sum("n").alias("count"), F.min("lo").alias("first_sec"), F.max("hi").alias("last_sec"))
    strand = cells.groupBy("symbol", "strand").agg(F.sum("n").alias("n")).groupBy("symbol").agg(F.min(F.struct(-F.col("n"), F.col("strand")))["strand"].alias("dominant_strand"))
    win = cells.groupBy("symbol", "win").agg(F.sum("n").alias("n")).groupBy("symbol").agg(F.min(F.struct(-F.col("n"), F.col("win")))["win"].alias("dominant_window"))
    return whole.join(strand, "symbol").join(win, "symbol")


@query("w12_cumulative_coverage", f"""WITH {CLUSTERED}, g AS (SELECT n_hits AS kind, count(*) AS n FROM cl GROUP BY 1) SELECT kind, n, round(sum(n) OVER (ORDER BY n DESC, kind ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 9) AS coverage FROM g""")
def w12(spark: SparkSession, d: str) -> DataFrame:
    g = clustered(spark, d).groupBy(F.col("n_hits").alias("kind")).agg(F.count("*").alias("n"))
    g = running_total(g, [F.col("n").desc(), F.col("kind")], "n", "upto")
    return g.select("kind", "n", F.round(F.col("upto") / F.col("upto_of"), 9).alias("coverage"))


@query("a20_determinism", f"""WITH {TR}, c AS (SELECT f, family, t, count(*) AS n FROM tr GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY f, family) AS p FROM c),
g AS (SELECT f, family, max(n) AS top, sum(n) AS n, -sum(p * log2(p)) AS h FROM p GROUP BY ALL)
SELECT round(sum(top) / sum(n), 9) AS weighted_top1, round(avg(top / n), 9) AS mean_top1, round(avg(h), 6) AS mean_entropy, count(*) AS groups FROM g""")
def a20(spark: SparkSession, d: str) -> DataFrame:
    out = determinism(moves(spark, d), ["from", "family"])
    return out.select(F.round("weighted_top1", 9).alias("weighted_top1"), F.round("mean_top1", 9).alias("mean_top1"), F.round("mean_entropy", 6).alias("mean_entropy"), "groups")


@query("a22_enrichment", f"""WITH {TR}, c AS (SELECT f, t, count(*) AS n FROM tr GROUP BY ALL) SELECT f AS "from", t AS "to", n AS observed, round(sum(n) OVER (PARTITION BY f) * sum(n) OVER (PARTITION BY t) / sum(n) OVER (), 6) AS expected,
round(n * sum(n) OVER () / (sum(n) OVER (PARTITION BY f) * sum(n) OVER (PARTITION BY t)), 9) AS enrichment FROM c QUALIFY sum(n) OVER (PARTITION BY f) >= 5""")
def a22(spark: SparkSession, d: str) -> DataFrame:
    c = moves(spark, d).groupBy("from", "to").agg(F.count("*").alias("observed"))
    over = lambda *k: F.sum("observed").over(Window.partitionBy(*k) if k else Window.partitionBy(F.lit(1)))
    c = c.withColumns({"a": over("from"), "b": over("to"), "n": over()}).filter("a >= 5")
    return c.select("from", "to", "observed", F.round(F.col("a") * F.col("b") / F.col("n"), 6).alias("expected"), F.round(F.col("observed") * F.col("n") / (F.col("a") * F.col("b")), 9).alias("enrichment"))


@query("a23_conditional_rates", f"""WITH {TR}, c AS (SELECT f, family, t, count(*) AS n FROM tr GROUP BY ALL)
SELECT f AS "from", family, t AS "to", n AS count, round(n / sum(n) OVER (PARTITION BY f), 9) AS rate_from, round(n / sum(n) OVER (PARTITION BY f, family), 9) AS rate_from_family, round(n / sum(n) OVER (PARTITION BY family), 9) AS share_of_family FROM c""")
def a23(spark: SparkSession, d: str) -> DataFrame:
    return conditional_rates(moves(spark, d)).withColumns({c: F.round(c, 9) for c in ("rate_from", "rate_from_family", "share_of_family")})


@query("a24_contingency", f"""WITH {TR} SELECT f AS "from", {', '.join(f"count(*) FILTER (t = '{s}') AS {s}" for s in ('click', 'purchase', 'view'))} FROM tr GROUP BY 1""")
def a24(spark: SparkSession, d: str) -> DataFrame:
    out = moves(spark, d).groupBy("from").pivot("to", ["click", "purchase", "view"]).count()
    return out.na.fill(0)


@query("a28_delta_stats", f"""WITH {TR} SELECT family, count(*) AS count, min(dd) AS min, max(dd) AS max, round(avg(dd), 10) AS mean, quantile_cont(dd, 0.5) AS median FROM tr GROUP BY 1""")
def a28(spark: SparkSession, d: str) -> DataFrame:
    return moves(spark, d).groupBy("family").agg(F.count("*").alias("count"), F.min("delta").alias("min"), F.max("delta").alias("max"), F.round(F.avg("delta"), 10).alias("mean"), F.percentile("delta", 0.5).alias("median"))


@query("a27_ranking", f"""WITH {HITS}, c AS (SELECT stream, symbol, count(*) AS n FROM hits GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY stream) AS rate, row_number() OVER (PARTITION BY stream ORDER BY n DESC, symbol) AS rank FROM c)
SELECT stream, symbol, n, round(rate, 9) AS rate, rank::INT AS rank FROM r WHERE rank <= 3""")
def a27(spark: SparkSession, d: str) -> DataFrame:
    c = hits(spark, d).groupBy("stream", "symbol").agg(F.count("*").alias("n"))
    w = Window.partitionBy("stream")
    r = c.withColumns({"rate": F.round(F.col("n") / F.sum("n").over(w), 9), "rank": F.row_number().over(w.orderBy(F.col("n").desc(), "symbol"))})
    return r.filter("rank <= 3")


@query("a34_distribution_text", f"""WITH {TR}, c AS (SELECT f, t, count(*) AS n FROM tr GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY n DESC, t) AS r FROM c)
SELECT f AS "from", string_agg(t || ':' || n, '|' ORDER BY r) AS distribution FROM r WHERE r <= 3 GROUP BY 1""")
def a34(spark: SparkSession, d: str) -> DataFrame:
    c = moves(spark, d).groupBy("from", "to").count()
    top = c.groupBy("from").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col("to").alias("t")))), 1, 3).alias("x"))
    return top.select("from", F.array_join(F.transform("x", lambda s: F.concat(s["t"], F.lit(":"), (-s["n"]).cast("string"))), "|").alias("distribution"))


@query("p13_phase_slots", f"WITH {HITS} SELECT least(13, floor((sec % {DAY}) / {DAY}.0::DOUBLE * 14))::INT AS slot, symbol, count(*) AS count FROM hits GROUP BY ALL")
def p13(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).groupBy(phase_slot(F.col("sec"), DAY, 14).alias("slot"), "symbol").count()


@query("a25_periodicity", f"""WITH {HITS}, x AS (SELECT symbol, strand, sec % 3600 // 600 AS residue FROM hits), c AS (SELECT symbol, strand, residue, count(*) AS n FROM x GROUP BY ALL
UNION ALL SELECT 'ALL', '*', residue, count(*) FROM x GROUP BY residue)
SELECT symbol, strand, residue::BIGINT AS residue, n, round(n / t, 9) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY symbol, strand) AS t, row_number() OVER (PARTITION BY symbol, strand ORDER BY n DESC, residue) AS r FROM c) WHERE r = 1""")
def a25(spark: SparkSession, d: str) -> DataFrame:
    """The commonest residue of each motif and strand, and of all together, from one scan with grouping sets."""
    x = hits(spark, d).withColumn("residue", F.floor(F.pmod(F.col("sec"), F.lit(3600)) / 600))
    c = x.groupingSets([["symbol", "strand", "residue"], ["residue"]], "symbol", "strand", "residue").agg(F.count("*").alias("n"), F.grouping("symbol").alias("g"))
    c = c.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("symbol")).alias("symbol"), F.when(F.col("g") == 1, "*").otherwise(F.col("strand")).alias("strand"), "residue", "n")
    w = Window.partitionBy("symbol", "strand")
    r = c.withColumns({"t": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.col("n").desc(), "residue"))}).filter("r = 1")
    return r.select("symbol", "strand", "residue", "n", F.round(F.col("n") / F.col("t"), 9).alias("share"))


@query("a25b_delta_gcd", f"""WITH {HITS}, x AS (SELECT stream, lead(event_id) OVER (PARTITION BY stream ORDER BY event_id) - event_id AS dd FROM hits),
l AS (SELECT stream, list(DISTINCT dd * 6) AS v FROM x WHERE dd IS NOT NULL GROUP BY 1) SELECT stream, list_reduce(v, lambda a, b: gcd(a, b))::BIGINT AS step FROM l""")
def a25b(spark: SparkSession, d: str) -> DataFrame:
    dd = (F.lead("event_id").over(along(["stream"], ["event_id"])) - F.col("event_id")) * 6
    x = hits(spark, d).select("stream", dd.alias("dd")).filter("dd IS NOT NULL")
    return x.groupBy("stream").agg(F.collect_set("dd").alias("v")).select("stream", gcd_of(F.col("v")).alias("step"))


@query("f7_min_support", f"""WITH {TR} SELECT f AS "from", t AS "to", family, count(*) AS count FROM tr GROUP BY ALL HAVING count(*) >= 20""")
def f7(spark: SparkSession, d: str) -> DataFrame:
    return moves(spark, d).groupBy("from", "to", "family").count().filter("count >= 20")


@query("f8_label_prefix", f"WITH {HITS} SELECT symbol, count(*) AS count FROM hits WHERE symbol LIKE 'c%' GROUP BY 1")
def f8(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).filter(F.col("symbol").like("c%")).groupBy("symbol").count()


@query("w3_transition_events", f"""WITH {HITS}, x AS (SELECT *, lag(symbol) OVER (PARTITION BY stream ORDER BY sec, event_id) AS was FROM hits) SELECT stream, event_id, was, symbol AS now FROM x WHERE was IS NOT NULL AND was <> symbol""")
def w3(spark: SparkSession, d: str) -> DataFrame:
    x = hits(spark, d).withColumn("was", F.lag("symbol").over(along(["stream"], ["sec", "event_id"])))
    return x.filter("was IS NOT NULL AND was <> symbol").select("stream", "event_id", "was", F.col("symbol").alias("now"))


@query("u1_state_union", f"""WITH {HITS}, a AS (SELECT symbol, count(*) AS n FROM hits WHERE strand = '+' GROUP BY 1), b AS (SELECT symbol, count(*) AS n FROM hits WHERE strand = '-' AND value > 50 GROUP BY 1)
SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.n, 0) AS observed, coalesce(b.n, 0) AS scanned FROM a FULL JOIN b ON a.symbol = b.symbol""")
def u1(spark: SparkSession, d: str) -> DataFrame:
    """Both counts from one pass; a state of either side comes out."""
    h = hits(spark, d)
    plus, minus = F.col("strand") == "+", (F.col("strand") == "-") & (F.col("value") > 50)
    return h.filter(plus | minus).groupBy("symbol").agg(F.sum(plus.cast("int")).alias("observed"), F.sum(minus.cast("int")).alias("scanned"))


@query("u3_seen_once", f"WITH {HITS} SELECT DISTINCT stream, symbol, strand FROM hits")
def u3(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("stream", "symbol", "strand").dropDuplicates()


@query("a33_distinct_labels", f"WITH {HITS} SELECT symbol, count(DISTINCT stream) AS labels FROM hits GROUP BY 1")
def a33(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).groupBy("symbol").agg(F.count_distinct("stream").alias("labels"))


@query("a30_summary_pivot", f"""WITH {HITS} SELECT stream, max(value) FILTER (symbol = 'click') AS click_max, max(value) FILTER (symbol = 'view') AS view_max, min(value) AS all_min, max(value) AS all_max FROM hits GROUP BY 1""")
def a30(spark: SparkSession, d: str) -> DataFrame:
    m = lambda s: F.max(F.when(F.col("symbol") == s, F.col("value"))).alias(f"{s}_max")
    return hits(spark, d).groupBy("stream").agg(m("click"), m("view"), F.min("value").alias("all_min"), F.max("value").alias("all_max"))
