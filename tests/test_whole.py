"""Queries do the whole job: each test here fails on a form that left a part of its input out."""

from __future__ import annotations

import re

from seqloom.functions.u64 import FNV_OFFSET, FNV_PRIME, signed
from seqloom.plans import QUERIES


def fnv(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME % (1 << 64)
    return signed(h)


def test_every_token_gets_its_symbol(spark, sf):
    got = {r.token: (r["count"], r.symbol) for r in QUERIES["s4c_token_symbols"](spark, sf).collect()}
    words = {r.symbol: r.n for r in QUERIES["s4_tokens_stream"](spark, sf).groupBy("symbol").count().withColumnRenamed("count", "n").collect()}
    assert any(len(w.encode()) > 6 for w in words)
    assert got == {w: (n, fnv(w.encode())) for w, n in words.items()}


def test_hamming_sees_whole_sequences(spark, sf):
    from seqloom.plans.motifs import neighbour_distances

    s = ["ACGTACGTACGTA", "ACGTACGTACGTC", "ACG", "ACT", "ACTG", "", ""]
    got = {r.a: r.distance for r in neighbour_distances(spark.createDataFrame(list(enumerate(s)), "item_id long, seq string")).collect()}
    assert got == {i: max(len(x), len(y)) if len(x) != len(y) else sum(a != b for a, b in zip(x, y)) for i, (x, y) in enumerate(zip(s, s[1:]))}
    ids = {r.item_id for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert QUERIES["p10b_hamming_whole"](spark, sf).count() == sum(i + 1 in ids for i in ids)


def test_pair_null_draws_from_whole_test_streams(spark, sf):
    from pyspark.sql import functions as F

    from seqloom.operators.resample import auto_draws
    from seqloom.plans.models import test_symbols as numbered
    from seqloom.operators.grammar import split_point
    from seqloom.plans.streams import documents, matrix, word_pairs

    sizes = [1, 400, 600, 5000, 50_000, 500_000, 5_000_000]
    assert [r.x for r in spark.createDataFrame([(x,) for x in sizes], "e long").select(auto_draws(F.col("e")).alias("x")).collect()] == [10_000, 10_000, 12_000, 50_000, 200_000, 500_000, 1_000_000]
    symbols, counts = numbered(spark, sf, 7)
    got = {}
    for r in symbols.collect():
        got.setdefault(r.stream, {})[r.at] = r.symbol
    want, edges = {}, {}
    split = documents(spark, sf).filter("n >= 6").withColumn("cut", split_point("n", 0.7))
    last = word_pairs(split).filter("pos >= cut").orderBy("stream", "doc_id", "pos").collect()
    for i, r in enumerate(last):
        ends = i + 1 == len(last) or (last[i + 1].stream, last[i + 1].doc_id) != (r.stream, r.doc_id)
        want.setdefault(r.stream, []).extend([r["from"], r.to] if ends else [r["from"]])
        edges[r.stream] = edges.get(r.stream, 0) + 1
    assert {s: [x[k] for k in range(len(x))] for s, x in got.items()} == want
    assert {r.stream: (r.n, r.edges) for r in counts.collect()} == {s: (len(x), edges[s]) for s, x in want.items()}
    null = QUERIES["n1_pair_null"](spark, sf).collect()
    cells = {(r.row, r.col) for r in matrix(spark, sf).collect()}
    assert {(r.row, r.col, r.mode) for r in null} == {(*c, m) for c in cells for m in ("symbol_shuffle", "rotation", "block_boundary")}
    e = min(edges.values())
    assert {r.samples for r in null} == {max(10_000, min(20 * e, 50_000) if e < 5000 else min(10 * e, 200_000))}


def test_every_skeleton_start_counts(spark, tmp_path):
    texts = ["abab" + "abcd" * 20, "ab" * 6 + "cd" * 6, "none", ""]  # a, b, c, d stand for A, C, G, T
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    from seqloom.plans.motifs import BASES, LETTERS

    seqs = [t.translate(str.maketrans(LETTERS, BASES)) for t in texts]
    want = {i: sum(bool(re.match("AC[ACGT]{4,8}GT", s[p:])) for p in range(len(s))) for i, s in enumerate(seqs)}
    assert {r.item_id: r.hits for r in QUERIES["x4b_skeleton_starts"](spark, str(tmp_path)).collect()} == want
    assert {r.item_id: r.observed for r in QUERIES["n6_gc_matched"](spark, str(tmp_path)).collect()} == {i: n for i, n in want.items() if seqs[i]}
    assert any(n > len(re.findall("AC[ACGT]{4,8}GT", seqs[i])) for i, n in want.items())


def test_entropy_gate_has_a_status(spark, sf):
    from seqloom.plans.models import evidence_gates

    cycle = spark.range(600).selectExpr("id % 3 AS stream", "id div 3 AS pos", "CAST(id div 3 % 4 AS string) AS symbol")
    assert {r.metric: r.status for r in evidence_gates(cycle).collect()} == {"weighted_top1": "pass", "mean_entropy": "pass"}
    noise = cycle.selectExpr("stream", "pos", "CAST(pmod(xxhash64(stream, pos), 4) AS string) AS symbol")
    assert {r.metric: r.status for r in evidence_gates(noise).collect()} == {"weighted_top1": "fail", "mean_entropy": "fail"}
    assert "missing" not in {r.status for r in QUERIES["a32_n8_gates"](spark, sf).collect()}


def test_coarse_variants_and_hashed_places(spark, sf):
    """The coarse hash and the hashed projection, one number at a time."""
    import math

    from seqloom.functions.field import COARSE_SALT
    from seqloom.functions.u64 import MIX_1, MIX_2, signed
    from seqloom.plans.fields import field

    mask = (1 << 64) - 1

    def mix(x: int) -> int:
        x &= mask
        x = (x ^ x >> 30) * MIX_1 & mask
        x = (x ^ x >> 27) * MIX_2 & mask
        return x ^ x >> 31

    got = {(r.stream, r.i): r.variant_hash for r in QUERIES["p4_coarse_variants"](spark, sf).collect()}
    rows = field(spark, sf).select("stream", "i", "raw", "dom", "lock", "dom_score", "k1", "k2", "k3", "k4", "k5").collect()
    near = 0
    for r in rows:
        quantised = [r.lock * 32, math.log1p(abs(r.dom_score)) * 16, math.log1p(abs(r.k1)) * 8, r.k2 * 16, r.k3 * 16, r.k4 * 24, r.k5 * 16]
        h = COARSE_SALT ^ mix(r.raw + 0x11) ^ mix((r.dom << 8) + 0x22)
        for q in quantised:
            h ^= mix(math.floor(q))
        near += got[r.stream, r.i] == signed(h or 1)
    assert len(rows) == len(got) and near >= 0.999 * len(rows)  # a logarithm may fall on the other side of a whole number
    assert len(set(got.values())) < len(rows) / 4
    for r in QUERIES["p2b_project_hash"](spark, sf).filter("i < 50").collect():
        assert abs(r.x - (-2 + (mix(r.i) >> 11) / (1 << 53) * 5)) < 1e-12


def test_rules_use_their_own_path(spark):
    """A rule about a claim looks where its path says, not always in the summary."""
    from pyspark.sql import functions as F

    from seqloom.operators.governance import RULE, policy_error

    body = '{"human_summary":"fine","machine_result":{"args":{"note":"secretly"}}}'
    rules = '[{"kind":"forbidden_claim_contains","path":"%s","contains":"secretly"}]'
    df = spark.createDataFrame([(body, rules % p) for p in ("human_summary", "machine_result.args.note", "machine_result.none")], "body string, rules string")
    got = df.select(policy_error(F.from_json("rules", RULE), F.col("body"), F.lit("low"), F.lit(False))).collect()
    assert [r[0] for r in got] == [None, "response contains a forbidden claim", None]


def test_permutations_are_permutations(spark):
    """Each replicate keeps a group's values; parts of groups and whole groups give the same draws."""
    from pyspark.sql import functions as F

    from seqloom.operators.resample import shuffled

    df = spark.range(300).selectExpr("id AS pos", "id % 3 AS grp", "concat('v', id % 7) AS v")
    plain, dealt = ({(r.replicate, r.pos): (r.grp, r.v) for r in shuffled(df, ["grp"], ["pos"], "v", 4, part=x).collect()} for x in (None, F.floor(F.col("pos") / 32)))
    assert plain == dealt and len(plain) == 1200
    want = sorted((k % 3, f"v{k % 7}") for k in range(300))
    for rep in range(4):
        assert sorted(v for (r, _), v in plain.items() if r == rep) == want
    assert len({tuple(plain[rep, p] for p in range(300)) for rep in range(4)}) == 4


def test_treebank_options(spark, tmp_path):
    """Windows, strides and boundaries of sentences, with keys that leave the sequence."""
    from seqloom.functions.u64 import FNV_OFFSET, FNV_PRIME
    from seqloom.sources.streams import conllu_tokens, treebank_symbols

    def fnv(data: bytes) -> int:
        h = FNV_OFFSET
        for c in data:
            h = (h ^ c) * FNV_PRIME & ((1 << 64) - 1)
        return h

    row = lambda i, form, upos: "\t".join([str(i), form, form.lower(), upos, "_", "_", "0", "x", "_", "_"])
    first = [("Ab", "NOUN"), ("cd", "_"), ("EF", "VERB"), ("gh", "NOUN"), ("ij", "ADJ")]
    text = "# a\n" + "\n".join(row(i, *x) for i, x in enumerate(first, 1)) + "\n\n" + row(1, "kl", "ADP") + "\n"
    (tmp_path / "t.conllu").write_text(text)
    tokens = conllu_tokens(spark, str(tmp_path / "t.conllu"))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = {k: fnv(k.encode()) for k in ("NOUN", "VERB", "ADJ", "ADP", "ab", "cd", "ef", "gh", "ij", "kl")}
    fold = lambda x: (x ^ x >> 32) & 0xFFFFFFFF
    got = lambda **o: sorted((r.pos is None, r.symbol) for r in treebank_symbols(tokens, **o).collect())
    assert got() == sorted((False, fold(h[k])) for k in ("NOUN", "VERB", "NOUN", "ADJ", "ADP"))
    assert got(field="form", stride=2, bits=64) == sorted((False, signed(h[k])) for k in ("ab", "ef", "ij", "kl"))
    pair = lambda a, b: signed(fnv(h[a].to_bytes(8, "little") + h[b].to_bytes(8, "little")))
    assert got(window=2, bits=64, boundary=True) == sorted([(False, pair("NOUN", "VERB")), (False, pair("VERB", "NOUN")), (False, pair("NOUN", "ADJ")), (True, -1), (True, -1)])
