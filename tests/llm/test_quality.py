import re
from collections import Counter

from corpuscope.llm import quality, registry

from .conftest import documents


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_query_equals_brute_force(spark, store, prose):
    a, b = prose(12, 1), prose(9, 2)
    texts = [None, "", " \t\n\x0b\f\r ", "é 𝒳 x", prose(40, 3), f"{a} {prose(30, 4)} {a} {prose(20, 5)} {b} {b}", "x " * 5000, f"{a}\n{a}\n \n\n{b}\n{a}\r\n", "#*$%&|<> " * 30, "w" * 50_000, prose(20_000, 6), "a b c d e f g h", "a b c d e f g h " * 2, prose(200, 7) * 2, "same", "same"]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    got = registry.op6_quality_rules(spark, store(documents=documents(spark, texts), labels=labels)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:7] == brute(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_rules_reject_junk_and_keep_clean(spark, prose):
    texts = [prose(60 + i % 50, i) if i % 4 else " ".join(w + "***" for w in prose(60, i).split()) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), None) for i in range(0, 400) if i % 3] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, texts)
    stats = quality.statistics(docs)
    rules = quality.learn(stats, labels)
    assert rules
    got = quality.judge(docs.withColumn("n_words", docs.source), labels).collect()
    assert all(r.kept == bool(r.doc_id % 4) for r in got)


def test_without_labels(spark, prose):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(documents(spark, [prose(50, 1), "x"]), none).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(0, True), (1, False)]
    assert quality.judge(documents(spark, []), none).collect() == []
