import math
import re
from collections import Counter

import numpy as np
import pytest

from corpuscope.llm import lm, registry

from .conftest import documents


def brute(texts, backoff=0.4):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    pairs = [Counter(zip([None, *d], d)) for d in docs]
    words = [Counter([None, *d]) if d else Counter() for d in docs]
    all_pairs, all_words, total = sum(pairs, Counter()), sum(words, Counter()), sum(map(len, docs))
    out = {}
    for i, d in enumerate(docs):
        n, s = total - len(d), 0.0
        for v, w in zip([None, *d], d):
            pair, context, single = all_pairs[v, w] - pairs[i][v, w], all_words[v] - words[i][v], all_words[w] - words[i][w]
            s += math.log(pair / context) if pair else math.log(backoff * (single or 0.5) / max(n, 1))
        out[i] = (len(d), s)
    return out


def test_query_equals_brute_force(spark, store, prose):
    texts = [prose(5 + i * 7 % 90, i) for i in range(80)] + [None, "", " \n", "one", "one", "new words only", "w " * 9000, prose(40, 3), prose(40, 3)]
    got = registry.op5_lm_scores(spark, store(documents=documents(spark, texts))).collect()
    expected = brute(texts)
    assert len(got) == len(texts)
    for r in got:
        n, s = expected[r.doc_id]
        assert r.n_words == n and r.score == pytest.approx(s, abs=1e-4)
        assert r.mean is None if n == 0 else r.mean == pytest.approx(s / n, abs=1e-6)


def test_edge_tables(spark):
    assert lm.score(documents(spark, [])).collect() == []
    got = lm.score(documents(spark, [None, ""], doc_id=[None, None]).withColumn("word", documents_text())).collect()
    assert [tuple(r) for r in got] == [(None, 0, 0.0, None)] * 2
    alone = lm.score(documents(spark, ["a b a"])).collect()
    assert alone[0].n_words == 3 and alone[0].score == pytest.approx(3 * math.log(0.2))


def documents_text():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_counts_above_one_entry_and_small_blocks(spark, prose, monkeypatch):
    """Words that occur hundreds of times in a block need several entries; many blocks of one document give the same scores as one."""
    texts = ["w " * 700 + "x", "w x " * 300, "w x y", prose(30, 1), prose(30, 1)]
    expected = brute(texts)
    for size in (1 << 14, 1):
        monkeypatch.setattr(lm, "BLOCK_DOCS", size)
        monkeypatch.setattr(lm, "HELD", 100)
        got = {r.doc_id: (r.n_words, r.score) for r in lm.score(documents(spark, texts)).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
        assert all(got[k][1] == pytest.approx(expected[k][1], abs=1e-6) for k in got)


def test_ngrams_are_sorted_by_one_number(spark, monkeypatch):
    """The gram comes before its bucket in the sort of the join, and a bucket's rows stay together."""
    plans, before = [], lm.materialize
    monkeypatch.setattr(lm, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or before(df, label))
    lm.score(spark.createDataFrame([(1, "a b a"), (2, "a b c")], "doc_id long, text string")).collect()
    assert any("Join [gram#" in p for p in plans) and not any("Join [bucket#" in p for p in plans)


def test_sorted_ngrams_are_short_and_spread(spark, monkeypatch):
    """The join sorts five numbers a row, in more partitions than other shuffles have."""
    plans, before = [], lm.materialize
    monkeypatch.setattr(lm, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or before(df, label))
    lm.score(spark.createDataFrame([(1, "a b a"), (2, "a b c")], "doc_id long, text string")).collect()
    plan = next(p for p in plans if "Join [gram#" in p)
    above, below = plan.split("Join [gram#", 1)
    assert "origin#" not in above and " AS place#" in below
    parts = re.findall(r"hashpartitioning\(bucket#\d+, (\d+)\)", below)
    assert parts and min(map(int, parts)) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_counts_are_hashed_while_partitions_are_small(spark, prose, monkeypatch):
    """Small partitions are joined without a sort, large ones by a sort that can spill; scores are the same."""
    plans, before = [], lm.materialize
    monkeypatch.setattr(lm, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or before(df, label))
    texts = ["w " * 700 + "x", "w x y", None, *(prose(60, i % 9) for i in range(20))]
    expected = brute(texts)
    for words, join in ((lm.HASHED_WORDS, "ShuffledHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(lm, "HASHED_WORDS", words)
        monkeypatch.setattr(lm, "BLOCK_DOCS", 3)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            got = {r.doc_id: (r.n_words, r.score) for r in lm.score(documents(spark, texts)).collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
        assert all(got[k][1] == pytest.approx(expected[k][1], abs=1e-6) for k in got)
        plan = plans.pop()
        assert re.findall(r"(\w+Join) \[gram#", plan) == [join] and ("Sort [" in plan) == (join == "SortMergeJoin")


def test_a_words_own_counts_are_found_at_once():
    """Own counts of the word before and of the word, as by plain search; the begin mark counts once."""
    doc, before, word, count = (np.array(x) for x in ([0, 0, 0, 1, 1], [3, 0, 1, 3, 2], [0, 1, 0, 2, 0], [1, 2, 1, 1, 4]))
    own = lambda d, w: sum(c for e, v, c in zip(doc, word, count) if (e, v) == (d, w)) or 1
    got = lm._own(doc, before, word, count, 4)
    assert [list(x) for x in got] == [[own(d, w) for d, w in zip(doc, side)] for side in (before, word)]
    none = np.empty(0, int)
    assert [len(x) for x in lm._own(none, none, none, none, 0)] == [0, 0]
