from zlib import crc32

from corpuscope.llm import langid, registry

from .conftest import documents

STEMS = {"en": "the ing th ation of and wh ly ed er", "de": "der sch ung und ein keit ich pf en ß", "fr": "le eau oi ment et é aux que è tion", "es": "el ción ñ que os ar mente ll rr í"}


def text(lang, seed):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choices(STEMS[lang].split(), k=rng.randint(1, 3))) for _ in range(40))


def test_held_out_accuracy(spark, store):
    langs = [list(STEMS)[i % 4] for i in range(200)]
    docs = documents(spark, [text(la, i) for i, la in enumerate(langs)], lang=langs)
    got = registry.op8_language_id(spark, store(documents=docs)).collect()
    assert len(got) == 200 and all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_edge_rows(spark):
    langs = ["en", "de", "fr", "es"] * 10
    model = langid.fit(documents(spark, [text(la, i) for i, la in enumerate(langs)] + [None, "123"], lang=[*langs, "en", "xx"]))
    docs = documents(spark, [None, "", "12 !", text("de", 5), text("fr", 1) * 300, "É"], doc_id=[None, 1, 1, 2, 3, 4], lang=[None] * 6)
    got = langid.predict(docs.withColumn("score", docs.doc_id), model, ["doc_id", "score"][:1]).collect()
    assert [r.lang_pred for r in got[:5]] == ["und", "und", "und", "de", "fr"] and got[5].lang_pred != "und"
    kept = langid.drop_undetermined(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == 3
    assert langid.predict(documents(spark, []), model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(documents(spark, []))).collect()} == {"und"}
    one = langid.fit(documents(spark, [text("en", 1)]))
    assert {r.lang_pred for r in langid.predict(docs, one).collect()} == {"und", "en"}
