import corpus_pipeline

from .conftest import documents
from .test_langid import text
from .test_tokens import expected


def test_stages(spark, store):
    langs = ["en", "de", "fr", "es"]
    texts = [text(langs[i % 4], i) for i in range(80)]
    bench = text("en", 999)
    texts += [texts[0], texts[5] + " extra", "1234 !!", None, text("en", 500) + " " + bench + " " + text("en", 501)]
    docs = documents(spark, texts, lang=[langs[i % 4] for i in range(len(texts))], source=["ab"[i % 2] for i in range(len(texts))])
    path = store(documents=docs, benchmark=spark.createDataFrame([(1, bench)], "item_id long, text string"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, path), "test")
        kept[name] = docs.collect()
        if name != "token_output":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in kept["language"]} == set(range(85)) - {82, 83}
    assert {r.doc_id for r in kept["near_duplicates"]} == set(range(80)) | {84}
    assert {r.doc_id for r in kept["decontamination"]} == set(range(80))
    assert [tuple(r) for r in sorted(kept["token_output"], key=lambda r: r.start)] == expected([(r.doc_id, r.text) for r in kept["mix_sources"]])
    assert sorted(corpus_pipeline.run(spark, path).collect()) == sorted(kept["token_output"])
