import pytest
from pyspark.sql import functions as F

from corpuscope.llm import common, langid, neardup, pii, quality

from .conftest import documents


@pytest.mark.parametrize("n", [10, 3000, 10**6, 10**11, 10**15])
def test_a_sample_never_falls_to_nothing(spark, n):
    """Keys whose hashes are spread evenly: the share that is picked follows n, also where n is far larger than any table here."""
    share = min(1.0, 3000 / n)
    got = spark.range(200_000).where(common.place_of("id") < common.share_of(n, 3000)).count() / 200_000
    assert got == pytest.approx(share, rel=0.1) if share > 0.001 else got <= 0.01
    assert common.share_of(n, 3000) > 0 and common.share_of(n, 3000, 5) > 5
    assert langid.shares({"a": n}, 3000)["a"] == pytest.approx(share * 2**62, rel=1e-6)
    assert langid.shares({"a": n}, 3000)["a"] > 0


def test_rare_languages_are_learned_in_full():
    got = langid.shares({"en": 10**9, "de": 10**6, "xx": 7}, 3000)
    assert got["xx"] == 1 << 62
    assert [round(got[k] / 2**62 * n) for k, n in (("en", 10**9), ("de", 10**6))] == pytest.approx([1497, 1496], abs=2)


def test_copies_of_one_row_are_learned_from(spark, prose):
    """Whichever share their hash stands above, some are picked; also where all rows are copies."""
    for i in range(4):
        docs = documents(spark, [f"{prose(9, i)} a{i}@b.cd 12 of 3"] * 30, doc_id=[i] * 30)
        assert langid.fit(docs, max_train=2) is not None
        assert pii.fit(docs, max_train=2) is not None
        assert common.picked(docs, ["doc_id"], 2).count() == 30
        labels = spark.createDataFrame([(i, 0, 0)] * 30, "doc_id long, quality int, toxic int")
        assert quality.judge(docs, labels).count() == 30
    assert common.picked(documents(spark, []), ["doc_id"], 2).count() == 0


def test_field_learns_from_some_tokens_of_every_document(spark, prose):
    texts = [f"{prose(20, i)} x{i}@mail.example.com {prose(9, i)} 12 of {i}" for i in range(60)] + [" ".join(map(str, range(5000)))]
    docs = documents(spark, texts, doc_id=[None] * 30 + list(range(31)))
    a, b = (pii.fit(d, max_tokens=2000) for d in (docs, docs.repartition(5, "text")))
    assert a is not None and (a.unary == b.unary).all() and (a.chain == b.chain).all()


def test_rows_that_share_a_doc_id(spark, prose):
    a, b = prose(80, 1), prose(80, 2)
    docs = documents(spark, [a, a, b], doc_id=[1, 5, 5])
    assert sorted((r.doc_id, r.text) for r in neardup.keep_rows(docs).collect()) == [(1, a), (5, b)]
    ids = [4, 4, None, 9, None, None, 4, None]
    texts = [a, a, a, a, b, b, "x", None]
    extra = documents(spark, texts, doc_id=ids).withColumn("key", F.lit(1)).withColumn("__key", F.lit(2)).withColumn("digest", F.lit("c"))
    got = neardup.keep_rows(extra)
    assert got.columns == extra.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted([("4", a), ("None", b), ("4", "x"), ("None", "None")])
    assert neardup.keep_rows(documents(spark, [])).collect() == []


def test_language_stage_with_clashing_columns(spark):
    docs = documents(spark, ["the thing of wheather", None, "12"]).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("s")).withColumn("__text", F.lit(2))
    model = langid.fit(docs)
    got = langid.drop_undetermined(docs, model, 0.0)
    assert got.columns == docs.columns and [r.doc_id for r in got.collect()] == [0]
    assert langid.drop_undetermined(docs, None, 0.0).collect() == []


def test_batches_are_bounded_by_bytes(spark):
    common.small_batches(spark)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    found = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000)).mapInArrow(sizes, "n long").collect()
    assert max(r.n for r in found) < 3 * common.BATCH["spark.sql.execution.arrow.maxBytesPerBatch"]
