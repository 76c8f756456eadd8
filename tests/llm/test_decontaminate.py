import hashlib
import re

from corpuscope.llm import decontaminate, registry

from .conftest import documents


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            m = min(10, len(b))
            for window in {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if b else ():
                for s in range(len(w) - m + 1):
                    if tuple(w[s : s + m]) == window:
                        hit |= set(range(s, s + m))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def cases(prose):
    item = [prose(30, 900 + i) for i in range(12)]
    items = [*enumerate(item), (12, "solo"), (13, "two Words"), (14, ""), (15, None), (16, item[0]), (17, "É x É x É x É x É x É x"), (18, "--")]
    docs = [
        None, "", " .,; ", item[0], item[0].upper() + "!", prose(80, 1) + " " + item[3] + " " + prose(50, 2), "a solo b two, words two",
        " ".join(item[5].split()[4:14]), " ".join(item[5].split()[4:13]), item[1] + " " + item[1] + " " + item[2], "é x " * 40, "É x " * 3000, "SOLO " * 20_000,
    ]
    return docs, items


def test_query_equals_brute_force(spark, store, prose):
    texts, items = cases(prose)
    docs = documents(spark, texts)
    got = registry.op9_decontamination(spark, store(documents=docs, benchmark=spark.createDataFrame(items, "item_id long, text string"))).collect()
    assert sorted(map(tuple, got)) == brute(list(enumerate(texts)), items)


def test_many_passes_equal_one(spark, prose):
    texts, items = cases(prose)
    docs, bench = documents(spark, [*texts, texts[3]]), spark.createDataFrame(items, "item_id long, text string")
    one = decontaminate.find_contamination(docs, bench).collect()
    many = decontaminate.find_contamination(docs, bench, words_per_pass=60).collect()
    assert sorted(one) == sorted(many)
    clean = decontaminate.drop_contaminated(docs.withColumn("hits", docs.doc_id), bench, words_per_pass=60)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in one if not r.hits)
    assert clean.columns == [*docs.columns, "hits"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(documents(spark, []), none).collect() == []
    assert [tuple(r) for r in decontaminate.find_contamination(documents(spark, ["a b"]), none).collect()] == [(0, 2, [], [])]
