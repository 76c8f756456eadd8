import re
from collections import Counter, defaultdict

import pytest

from corpuscope.llm import mixing, registry

from .conftest import documents


def filled(sizes, share=1.5, repeats=2.0):
    """Targets by repeated sharing of the excess."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, rest, open_ = {s: 0.0 for s in order}, share * sum(sizes.values()), set(order)
    while rest > 1e-9 and open_:
        total, over = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += rest * weight[s] / total
            if target[s] >= repeats * sizes[s]:
                over += target[s] - repeats * sizes[s]
                target[s] = repeats * sizes[s]
                open_.discard(s)
        rest = over
    return target


@pytest.fixture
def rows(prose):
    texts = [prose(20 + 37 * (i % 23), i) for i in range(300)] + [None, "", " \n", prose(5000, 1), "one", "same text", "same text"]
    source = ["a"] * 130 + ["é"] * 60 + ["b", "c", "𝒳", "ｚ"] * 25 + [None] * 10 + ["b"] * 6 + ["tiny"]
    return texts, source


def test_query_near_targets(spark, store, rows):
    texts, source = rows
    docs = documents(spark, texts, source=source)
    path = store(documents=docs)
    got = registry.op2_source_mixing(spark, path).collect()
    assert sorted(got) == sorted(registry.op2_source_mixing(spark, path).collect())
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    sizes = Counter()
    for s, n in zip(source, size):
        sizes[s] += n
    target, taken = filled(sizes), defaultdict(int)
    assert len(got) == len(texts)
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 4 * mixing.BLOCK


def test_stream_is_consistent(spark, rows):
    texts, source = rows
    docs = documents(spark, texts, source=source, doc_id=[i // 2 for i in range(len(texts))])
    stream = mixing.mix(docs).collect()
    by_slot = defaultdict(int)
    for r in stream:
        by_slot[r.slot] += r.word_to - r.word_from
    assert all(0 < n <= mixing.BLOCK for n in by_slot.values())
    assert sum(by_slot.values()) == sum(r.taken for r in mixing.taken_words(docs).collect())


def test_mixed_documents_hold_the_words_taken(spark, rows):
    texts, source = rows
    docs = documents(spark, texts, source=source)
    extra = docs.withColumn("size", docs.doc_id).withColumn("pass", docs.source)
    got = mixing.mixed_documents(extra)
    assert got.columns == extra.columns
    words = defaultdict(int)
    for r in got.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert {r.doc_id: r.taken for r in mixing.taken_words(docs).collect() if r.taken} == dict(words)


def test_empty_and_wordless(spark):
    assert mixing.taken_words(documents(spark, [])).collect() == []
    got = mixing.taken_words(documents(spark, [None, ""], source=[None, "a"])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_mixed_documents_equal_sql(spark, rows, tmp_path):
    """What the pipeline's stage gives, against the query's SQL over the same documents: the first words of each, in whole passes and one part."""
    import duckdb

    from corpuscope.llm import oracles

    texts, source = rows
    docs = documents(spark, texts, source=source)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    at = con.sql(oracles.SOURCE_MIXING).columns
    taken = {r[at.index("doc_id")]: r[at.index("taken")] for r in con.sql(oracles.SOURCE_MIXING).fetchall()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in enumerate(texts)}
    got = defaultdict(list)
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id].append(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert {k: sum(map(len, v)) for k, v in got.items()} == {k: n for k, n in taken.items() if n}
    assert all(part == words[k][: len(part)] for k, parts in got.items() for part in parts)
