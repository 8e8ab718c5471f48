"""Sources and the field as functions of Spark SQL: table functions for streams of symbols, scalar functions for the field.

All bodies are SQL, so Catalyst plans them with the query that calls them; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .field import A, B, C, D0, E0, EPS, EXP_LIMIT, HARD, OFFSET_3, SCALES
from .u64 import FNV_OFFSET, FNV_PRIME

_TWO64 = "18446744073709551616"
#: One step of FNV-1a on unsigned numbers held as DECIMAL(20, 0): XOR touches the lowest byte only.
_STEP = f"CAST((h - h % 256 + (CAST(h % 256 AS BIGINT) ^ b)) * CAST({FNV_PRIME} AS DECIMAL(13,0)) % CAST({_TWO64} AS DECIMAL(20,0)) AS DECIMAL(20,0))"
_BYTES = "transform(regexp_extract_all(hex(data), '..', 0), x -> CAST(conv(x, 16, 10) AS BIGINT))"
_SIGNED = f"CAST(IF(u >= 9223372036854775808, u - CAST({_TWO64} AS DECIMAL(20,0)), u) AS BIGINT)"


def _exp(x: str) -> str:
    return f"exp(least(greatest({x}, -{EXP_LIMIT}D), {EXP_LIMIT}D))"


def _log(x: str) -> str:
    return f"ln(abs({x}) + {EPS}D)"


def _div(a: str, b: str) -> str:
    return f"(({a}) / (IF(({b}) < 0 OR (({b}) = 0 AND CAST(({b}) AS STRING) = '-0.0'), -1D, 1D) * greatest(abs({b}), {EPS}D)))"


def _fin(x: str) -> str:
    return f"coalesce(IF(NOT isnan({x}) AND abs({x}) < {HARD}D, {x}, 0D), 0D)"


_D = f"({D0}D - tanh({D0}D))"
_E = _exp(f"{E0}D")
_WAVE = _log(f"x * cos(cos({_exp('x')}))")
#: The five operators at x.
_K = [
    _fin(f"sin({_exp(_log(f'{A}D'))}) * {_div(f'tanh({B}D)', _exp(_div(f'{A}D - (x + tanh(x))', 'x')))}"),
    _fin(_log(f"{_exp('tanh(cos(x))')} * x")),
    _fin(f"cos({-C}D * {_div(f'cos(sin({_div("x * x", "x")}))', _D)})"),
    _fin(f"tanh({_div(f'sin(cos(x * {_E}))', _exp(_exp('x')))} * {_WAVE})"),
    _fin(f"tanh({_div(f'(x + x * tanh(x)) * {_WAVE}', _D)}) * {_E}"),
]
_MOST = "array_position(transform(k, (v, j) -> {0}), array_max(transform(k, (v, j) -> {0})))"
_SCORE = f"abs(IF(j = 2, v - {OFFSET_3}D, v)) / element_at(array({', '.join(f'{x}D' for x in SCALES)}), j + 1)"

FUNCTIONS = {
    # S2 to S7
    "seq_bytes": f"(data BINARY) RETURNS TABLE (pos BIGINT, symbol BIGINT) RETURN SELECT CAST(p AS BIGINT), s FROM (SELECT posexplode({_BYTES}) AS (p, s))",
    "seq_fnv1a": f"(data BINARY) RETURNS BIGINT RETURN aggregate({_BYTES}, CAST({FNV_OFFSET} AS DECIMAL(20,0)), (h, b) -> {_STEP}, u -> {_SIGNED})",
    "seq_byte_windows": "(data BINARY, width INT, stride INT) RETURNS TABLE (pos BIGINT, symbol BIGINT) RETURN SELECT CAST(s - 1 AS BIGINT), seq_fnv1a(substring(data, s, width)) FROM (SELECT explode(IF(octet_length(data) >= width, sequence(1, octet_length(data) - width + 1, stride), CAST(array() AS ARRAY<INT>))) AS s)",
    "seq_tokens": r"(text STRING) RETURNS TABLE (pos BIGINT, token STRING) RETURN SELECT CAST(p AS BIGINT), w FROM (SELECT posexplode(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+', 0)) AS (p, w))",
    "seq_bin": "(x DOUBLE, low DOUBLE, high DOUBLE, bins INT) RETURNS BIGINT RETURN CAST(CASE WHEN x <= low THEN 0 WHEN x >= high THEN bins - 1 ELSE floor((x - low) * (bins - 1) / (high - low)) END AS BIGINT)",
    "seq_treebank": r"(sentence STRING) RETURNS TABLE (pos BIGINT, form STRING, lemma STRING, upos STRING) RETURN SELECT CAST(p AS BIGINT), split(line, '\\t')[1], split(line, '\\t')[2], split(line, '\\t')[3] FROM (SELECT posexplode(filter(split(sentence, '\\r?\\n'), x -> x RLIKE '^[0-9]+\\t' AND size(split(x, '\\t')) = 10)) AS (p, line))",
    "seq_kmers": "(seq STRING, k INT) RETURNS TABLE (pos BIGINT, kmer STRING, symbol BIGINT) RETURN SELECT CAST(s - 1 AS BIGINT), w, CAST(conv(translate(w, 'ACGT', '0123'), 4, 10) AS BIGINT) FROM (SELECT s, CAST(substring(CAST(seq AS BINARY), s, k) AS STRING) AS w FROM (SELECT explode(IF(octet_length(seq) >= k, sequence(1, octet_length(seq) - k + 1), CAST(array() AS ARRAY<INT>))) AS s)) WHERE w NOT RLIKE '[^ACGT]'",
    # P1 to P3
    "field_operators": f"(x DOUBLE) RETURNS ARRAY<DOUBLE> RETURN array({', '.join(_K)})",
    "field_energy": "(k ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(k, 0D, (a, v) -> a + v * v))",
    "field_lock": "(k ARRAY<DOUBLE>) RETURNS DOUBLE RETURN tanh(field_energy(k) + abs(aggregate(transform(k, (v, j) -> v * (j + 1)), 0D, (a, v) -> a + v) / 5D))",
    "field_raw": f"(k ARRAY<DOUBLE>) RETURNS INT RETURN CAST({_MOST.format('abs(v)')} AS INT)",
    "field_dominant": f"(k ARRAY<DOUBLE>) RETURNS INT RETURN CAST({_MOST.format(_SCORE)} AS INT)",
    "field_score": f"(k ARRAY<DOUBLE>) RETURNS DOUBLE RETURN array_max(transform(k, (v, j) -> {_SCORE}))",
    "field_project": "(symbol DOUBLE, x_min DOUBLE, x_max DOUBLE, source_min DOUBLE, source_max DOUBLE) RETURNS DOUBLE RETURN x_min + least(greatest((symbol - source_min) / (source_max - source_min), 0D), 1D) * (x_max - x_min)",
    "field_state": "(k ARRAY<DOUBLE>) RETURNS INT RETURN field_raw(k) * 1000 + field_dominant(k) * 100 + CAST(floor(field_lock(k) * 20) AS INT)",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL, as temporary ones; their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(FUNCTIONS)
