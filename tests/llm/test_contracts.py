"""The numbered queries and the pipeline on given tables."""

from __future__ import annotations

import hashlib
import re
from html import unescape

import brute
import numpy as np
import pytest
from compare import differences

from seqloom.llm import queries as Q
from seqloom.llm.common import table

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, sf, name):
    assert differences(spark, sf, name, Q.QUERIES[name], Q.SQL[name]) == []


def test_op5_op9_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    assert {r["doc_id"]: tuple(r)[1:] for r in Q.op5_suffix_repeats(spark, sf).collect()} == brute.repeats(docs, 400)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in Q.op9_ngram_join(spark, sf).collect()} == brute.near_classes(docs, 3, 90)


def test_op2_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()][:60]
    few = spark.createDataFrame(docs, "doc_id long, text string")
    from seqloom.llm.lines import without_lines

    keep = brute.line_matches(docs, 80)
    assert {r["doc_id"]: r["n_lines"] - r["n_removed"] for r in without_lines(few).collect()} == {d: len(k) for d, k in keep.items()}


def test_op4_is_lossless(spark, sf):
    text = {r["doc_id"]: r["text"].encode() for r in table(spark, sf, "documents").collect()}
    for r in Q.op4_telephony(spark, sf).collect():
        raw = text[r["doc_id"]]
        pay = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest())


def test_op6_same_as_library(spark, sf):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(Q.bpe_file())
    got = {r["doc_id"]: r for r in Q.op6_bpe(spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        ids = lib.encode(r["text"], add_special_tokens=False).ids
        x = got[r["doc_id"]]
        assert (x["n_tokens"], x["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert x["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op7_articles(spark):
    got = {r["page_id"]: r["text"] for r in Q.op7_html(spark, SMALL).collect()}
    same = 0
    for r in table(spark, SMALL, "pages").collect():
        inside = re.sub(r"<[a-zA-Z/!][^>]*\Z", "", r["html"].partition("<article>")[2].partition("</article>")[0])
        parts = (" ".join(unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside))
        same += got[r["page_id"]] == "\n".join(p for p in parts if p)
    assert same >= 0.99 * len(got)


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SMALL, "labels").collect()}
    q = [r for r in Q.op3_quality(spark, SMALL).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in q]) > 0.9
    langs = {r["doc_id"]: r["lang"] for r in table(spark, SMALL, "documents").collect()}
    p = [r for r in Q.op10_language_id(spark, SMALL).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in p]) > 0.95


def test_pipeline_stages(spark, sf, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    docs, names = table(spark, sf, "documents"), table(spark, sf, "documents").columns
    before = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == names
            after = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert set(after) <= set(before)
        if name == "exact dedup":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
            best: dict = {}
            for d, t in before:
                best.setdefault(norm(t), []).append((-len(t or ""), d))
            assert {d for d, _ in after} == {min(g)[1] for g in best.values()}
        if name == "n-gram Jaccard join":
            assert {d for d, _ in after} == {d for d, (_, c) in brute.near_classes(before, 5, 80).items() if d == c}
        if name == "mixing sources":
            assert max(map(after.count, after)) <= 2
        before = after if k < 4 else before
    assert docs.count() == len(before)
