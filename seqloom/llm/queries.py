"""The training-data queries: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table


def bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_groups

    out = exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import without_lines

    out = without_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.octet_length("kept").cast("long").alias("kept_bytes"), F.sha2("kept", 256).alias("kept_sha256"))


def held_out(n: int, rest: int) -> Column:
    """Is a row set aside: the crc32 of doc_id as text leaves this rest."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n == rest, F.lit(False))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"), ~held_out(4, 2))
    return score(docs, net).select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audio import read_audio, store

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    files = cut(store(docs), "media")  # the media table: written to the shared folder, and read back
    heard = read_audio(files.withColumn("key", F.struct("doc_id", F.octet_length("media").cast("long").alias("bytes"), F.sha2("media", 256).alias("sha"))), key="key")
    tail = F.expr("substring(payload, octet_length(payload) - 15, 16)")
    return heard.select(
        "key.doc_id", F.col("n_samples").alias("n_bytes"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.col("key.bytes").alias("media_bytes"), F.col("key.sha").alias("media_sha256"), "feature", F.crc32("pcm").alias("pcm_crc32"),
    )


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngrams import classes_of

    return classes_of(table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, ~held_out(5, 0))
    return identify(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "rejected")


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import without_repeats

    out = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce(F.sha2("kept", 256), F.col("sha256")).alias("kept_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    out = encode(table(spark, sf_dir, "documents"), bpe_file(), decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The rules that op11 applies: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judged

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("row.page_id", "host", "path", "rule", "verdict")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations that pass 64 bits are null here; the operator's own column is a decimal."""
    from .whiten import whitened

    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"), support=100, percent=100, most=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_telephony": op4_telephony,
    "op5_suffix_repeats": op5_suffix_repeats,
    "op6_bpe": op6_bpe,
    "op7_html": op7_html,
    "op8_mixing": op8_mixing,
    "op9_ngram_join": op9_ngram_join,
    "op10_language_id": op10_language_id,
    "op11_url_filter": op11_url_filter,
    "op12_whitening": op12_whitening,
    "op13_collocations": op13_collocations,
}

EXACT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents),
g AS (SELECT k, count(*) AS group_size, arg_min(doc_id, (-length(t), doc_id)) AS keep_id FROM d GROUP BY k)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM d JOIN g USING (k)
"""

MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
fill AS (
  SELECT 0 AS round, source, source_size, w, false AS capped, 0.0::DOUBLE AS t FROM w
  UNION ALL
  SELECT round + 1, source, source_size, w, capped OR t >= 2.0 * source_size, t
  FROM (SELECT round, source, source_size, w, capped,
      CASE WHEN capped THEN 2.0 * source_size
        ELSE w * (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) FILTER (capped) OVER (), 0)) / sum(w) FILTER (NOT capped) OVER () END AS t
    FROM fill WHERE round <= (SELECT count(*) FROM w)) x),
targets AS (SELECT source, source_size::BIGINT AS source_size, CASE WHEN capped THEN 2.0::DOUBLE * source_size ELSE t::DOUBLE END AS target FROM fill WHERE round = (SELECT max(round) FROM fill)),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.hash,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS times,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.hash) AS here
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * (times + (upto - (target - times * source_size) <= (target - times * source_size) - (upto - here))::INT)::BIGINT AS taken
FROM c
"""

URL_SQL = r"""
WITH r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (host, path)
"""

PHRASE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, w[i : i + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 6) t(m) WHERE len(w) >= m)),
f AS (SELECT lang, g, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
s AS (SELECT lang, g[i : i + k - 1] AS g, f FROM (SELECT lang, g, f, k, unnest(range(1, len(g) - k + 2)) AS i FROM f, range(2, 5) t(k) WHERE k < len(g))),
c AS (SELECT f.lang, f.g, f.f AS a FROM f LEFT JOIN (SELECT lang, g, max(f) AS m FROM s GROUP BY ALL) x USING (lang, g) WHERE len(f.g) > 1 AND coalesce(m, 0) < f.f),
k AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c),
z AS (SELECT k.lang, k.g, k.a, x.f AS l, y.f AS r, n.n, k.k, (1000 * k.a * n.n) // (x.f * y.f) AS score
  FROM k JOIN n USING (lang) JOIN f x ON x.lang = k.lang AND x.g = k.g[1 : k.k] JOIN f y ON y.lang = k.lang AND y.g = k.g[k.k + 1 :]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS best FROM z),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM b WHERE best = 1)
SELECT lang, rank, array_to_string(g, ' ') AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""

SQL: dict[str, str] = {"op11_url_filter": URL_SQL, "op13_collocations": PHRASE_SQL, "op1_exact_dedup": EXACT_SQL, "op8_mixing": MIX_SQL}
