"""Findings of round 3 that were left: the grammar's state, treebank counts."""

from __future__ import annotations

from datetime import datetime, timedelta


def test_grammar_orders_by_microseconds(spark):
    """Rows of one millisecond are in order of their time and not of their ids; keys share buckets."""
    from seqloom.streaming.windows import online_grammar

    at = datetime(2024, 1, 1)
    rows = [(u, at + timedelta(milliseconds=10 * u, microseconds=100 * k), 1000 * u + 9 - k, s) for u in range(50) for k, s in enumerate("abca")]
    df = spark.createDataFrame(rows, "u long, ts timestamp, k long, s string")
    got = {(x["u"], x["from"], x["to"]): x["count"] for x in online_grammar(spark, df, "u", "ts", "k", "s", 3).collect()}
    assert got == {(u, a, b): 1 for u in range(50) for a, b in ("ab", "bc", "ca")}


def test_grammar_state_calls_follow_buckets():
    """A micro-batch of a bucket costs the state store the same calls, however many keys it has."""
    import pandas as pd

    from seqloom.streaming.windows import OrderedTransitions

    class Store(list):
        calls = 0

        def __getattribute__(self, name):
            if name in ("get", "put", "update", "appendValue", "exists", "clear"):
                Store.calls += 1
            return list.__getattribute__(self, name)

        exists = lambda self: len(self) > 0
        appendValue = lambda self, x: self.append(x)  # noqa: E731, N815
        get = lambda self: self[0] if self.value else iter(list(self))
        put = lambda self, xs: self.__setitem__(slice(None), xs)
        update = lambda self, x: self.__setitem__(slice(None), [x])

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            out = Store()
            out.value = True
            return out

        def getListState(self, name, schema):  # noqa: N802
            out = Store()
            out.value = False
            return out

        def registerTimer(self, ms):  # noqa: N802
            Store.calls += 1

    class Timers:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    n, got = 500, []
    p = OrderedTransitions()
    p.init(Handle())
    for part, mark in enumerate((0, 10, 20)):
        rows = [(str(u), (10 * part + 5) * 1000, 0, "xyz"[part]) for u in range(n)]
        got += list(p.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["key", "us", "tie", "symbol"])]), Timers(mark)))
    got += list(p.handleExpiredTimer((0,), Timers(26), None))
    assert sorted(map(tuple, pd.concat(got).to_numpy().tolist())) == sorted((str(u), a, b) for u in range(n) for a, b in ("xy", "yz"))
    assert Store.calls < 50


def test_treebank_counts_without_sentences_moving(spark, tmp_path):
    """Counts equal those of the rows; what moves is windows already counted."""
    from seqloom.sources.streams import conllu_sentences, conllu_tokens, treebank_counts, treebank_symbols

    row = lambda i, form, upos: "\t".join([str(i), form, form.lower(), upos, "_", "_", "0", "x", "_", "_"])
    sentence = lambda k: "\n".join(row(i, f"W{i * k % 5}", ("NOUN", "_", "VERB", "", "ADJ")[(i * k + k) % 5]) for i in range(1, 4 + k % 7))
    text = "\n\n".join(["# only a comment\twith a tab", *map(sentence, range(40)), row("1-2", "range", "X"), row(1, "a", "_")]) + "\n"
    (tmp_path / "t.conllu").write_text(text)
    tokens, sentences = conllu_tokens(spark, str(tmp_path / "t.conllu")), conllu_sentences(spark, str(tmp_path / "t.conllu"))
    for o in ({}, {"boundary": True}, {"window": 2, "stride": 2, "bits": 64}, {"field": "lemma_upos", "window": 3, "boundary": True}, {"field": "form", "window": 30}):
        want = {r["symbol"]: r["count"] for r in treebank_symbols(tokens, **o).groupBy("symbol").count().collect()}
        out = treebank_counts(sentences, **o)
        assert {r["symbol"]: r["count"] for r in out.collect()} == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "collect_list" not in plan


def test_collocation_rows_follow_text_and_not_vocabulary(spark, monkeypatch):
    """Pointers of many words, and of a crowded word with many second ones, are few rows; the phrases are all there."""
    from seqloom.llm import phrases

    made, cut = [], phrases.cut

    def counted(df, tag):
        out = cut(df, tag)
        if tag == "pointers":
            made.append(out.count())
        return out

    monkeypatch.setattr(phrases, "cut", counted)
    monkeypatch.setattr(phrases, "SLOTS", 8)
    rows = [(f"the w{k} of{k % 7}. " * 3, "en") for k in range(600)]
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    f = {r["phrase"]: r["f"] for r in phrases.frequent(df, 3, crowd=1000)[0].collect()}
    want = {"the": 1800, **{f"of{j}": 3 * len(range(j, 600, 7)) for j in range(7)}}
    for k in range(600):
        want |= {p: 3 for p in (f"w{k}", f"the w{k}", f"w{k} of{k % 7}", f"the w{k} of{k % 7}")}
    assert f == want
    assert made[0] <= 2 * 8 + 1
