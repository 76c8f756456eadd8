import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpuscope.llm import neardup, registry

from .conftest import documents


def roots_of(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(texts, threshold=0.8):
    bags = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    df = Counter(s for b in bags for s in b)
    n = len(texts)
    weight = [{s: c * (1 + math.log1p(n / df[s]) / math.log1p(n)) for s, c in b.items()} for b in bags]
    pairs = {}
    for i in range(n):
        for j in range(i):
            least = sum(min(x, weight[j].get(s, 0)) for s, x in weight[i].items())
            if least:
                pairs[i, j] = least / (sum(weight[i].values()) + sum(weight[j].values()) - least)
    return pairs, roots_of(n, [p for p, s in pairs.items() if s >= threshold])


@pytest.fixture
def texts(prose):
    rng, out = random.Random(3), [None, "", "  \n", "a b", "a b", "a b c d e", "a b c d e f", "w " * 4000, "w " * 4001]
    shared = prose(40, 500)
    for i in range(12):
        base = prose(100 + 15 * i, i).split()
        for k in range(1 + i % 5):
            copy = list(base)
            for _ in range(k * i // 3):
                copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
            out.append(" ".join(copy))
    out += [f"{shared} {prose(80, 600 + i)}" for i in range(15)] + [prose(120, 700)] * 20
    half = prose(100, 800).split()  # equal but for shingles that no other document has: 5 words each, and 13 words each
    out += [" ".join(half[:50] + [f"only{i}x"] + half[51:]) for i in (1, 2)] + [" ".join(half[1:40] + [f"only{i}y", *half[41:45], f"only{i}z", *half[50:90]]) for i in (1, 2)]
    return out


def test_query_equals_brute_force(spark, store, texts):
    pairs, roots = brute(texts)
    assert not any(0.795 < s < 0.8005 for s in pairs.values())
    got = registry.op10_near_duplicates(spark, store(documents=documents(spark, texts))).collect()
    assert len(got) == len(texts)
    size = Counter(roots)
    assert {r.doc_id: (r.class_id, r.class_size) for r in got} == {i: (roots[i], size[roots[i]]) for i in range(len(texts))}


def test_small_blocks_buckets_and_salts_change_nothing(spark, texts, monkeypatch):
    docs = documents(spark, texts).repartition(3)
    expected = sorted(map(tuple, neardup.near_duplicates(docs).collect()))
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 5)
    monkeypatch.setattr(neardup, "PER_SALT", 2)
    monkeypatch.setattr(neardup, "_CHUNK", 64)
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect())) == expected


def test_edge_rows(spark, prose):
    text = prose(60, 1)
    docs = documents(spark, [text, text, text, text, prose(70, 2), prose(70, 2), "x"], doc_id=[4, 4, None, 9, None, None, 4]).withColumn("node", lit_text()).withColumn("n", lit_text())
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(4, 4, 4), (4, 4, 4), (None, 4, 4), (9, 4, 4), (None, None, 2), (None, None, 2), (4, 4, 1)], key=str)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "None", "None", "None"]
    assert neardup.near_duplicates(documents(spark, [])).collect() == []


def lit_text():
    from pyspark.sql import functions as F

    return F.lit("clash")


def shuffled_rows(plan):
    """Rows that the exchanges of a plan without adaptive execution have written."""
    written, children = plan.metrics().get("shuffleRecordsWritten"), plan.children()
    return (written.get().value() if written.isDefined() else 0) + sum(shuffled_rows(children.apply(i)) for i in range(children.size()))


@pytest.mark.parametrize("most_bits", [1 << 26, 1])
def test_only_texts_that_may_be_dropped_are_shuffled(spark, prose, monkeypatch, most_bits):
    monkeypatch.setattr(neardup, "MOST_BITS", most_bits, raising=False)
    texts = [prose(60, i) for i in range(400)] + [prose(60, 1), prose(60, 2), prose(60, 3), prose(60, 3), None, None]
    ids = [*range(400), 1, None, -3, -3, 1, None]
    docs = documents(spark, texts, doc_id=ids).withColumn("bucket", lit_text()).withColumn("__bitmap", lit_text())
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        kept = neardup.keep_rows(docs)
        rows = kept.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert kept.columns == docs.columns
    expected = [(i, texts[i]) for i in range(400) if i != 3] + [(-3, texts[3]), (1, None), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(expected, key=str)
    assert most_bits == 1 or shuffled_rows(kept._jdf.queryExecution().executedPlan()) < 200


def test_samples_agree_as_often_as_bags_are_alike():
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    a, b = (hashes[:300], rng.uniform(1, 2, 300).astype("f4")), (hashes[100:], rng.uniform(1, 2, 300).astype("f4"))
    bags = [(*x, float(x[1].sum())) for x in (a, b)]
    agree = np.mean(neardup.samples(*a, 2000) == neardup.samples(*b, 2000))
    assert abs(agree - neardup.similarity(*bags)) < 0.05


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    n = 120
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(40, n), rng.randrange(40, n)) for _ in range(60)] + [(35, i) for i in range(31, 40)]
    root = roots_of(n, edges)
    frame = spark.createDataFrame([(a, b) for a, b in edges], "a long, b long")
    got = {r.node: r.root for r in neardup.components(frame).collect()}
    expected = defaultdict(int, {i: root[i] for i in range(n) if root[i] != i})
    assert got == dict(expected)


def test_a_node_is_linked_to_every_leader_that_is_like_it():
    x = np.arange(100, dtype=np.uint64)
    left, right = np.sort(np.append(x[10:], x[:10] + np.uint64(1000))), np.sort(np.append(x[:90], x[90:] + np.uint64(2000)))
    rows = [(0, 7, node, h.tobytes(), np.ones(100, "f4").tobytes(), 100.0) for node, h in ((b"a", left), (b"b", right), (b"c", x))]
    batch = neardup._arrow(rows, "band int, key long, node binary, hashes binary, weights binary, weight double")
    found = [tuple(r.values()) for out in neardup._among_rest(0.8)([batch]) for r in out.to_pylist()]
    assert found == [(b"c", b"a"), (b"c", b"b")]


@pytest.mark.parametrize("side", [500, 1])
def test_pairs_of_a_key_without_its_first_node_are_verified(spark, prose, monkeypatch, side):
    """A chain of texts, each like the next only, in one key: whichever node is first, most links are between others."""

    def one_key(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([0] * batch.num_rows, pa.int32()), pa.array([7] * batch.num_rows, pa.int64())], ["node", "band", "key"])

    words = prose(400, 9).split()
    texts = [" ".join(words[12 * i : 12 * i + 140]) for i in range(12)] + [" ".join(reversed(words[12 * i : 12 * i + 140])) for i in range(5)]
    _, roots = brute(texts)
    assert set(roots) == {0, 12}
    monkeypatch.setattr(neardup, "_keys", one_key)
    monkeypatch.setattr(neardup, "SIDE", side, raising=False)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert got == dict(enumerate(roots))


def test_blocks_and_buckets_grow_with_the_root_of_the_input():
    assert neardup.growth(0) == neardup.growth(30 * 10**9) == 1.0
    for n in (10**12, 10**14, 10**16):
        grown = neardup.growth(n)
        buckets = n / (neardup.BUCKET_BYTES * grown)
        assert neardup.BLOCK_SHINGLES * grown / buckets >= neardup.PER_ROW / 2  # shingles of a row
    assert neardup.growth(10**14) == pytest.approx(31, abs=1)
