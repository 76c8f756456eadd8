import json

import pytest
from pyspark.sql import functions as F

from corpuscope import models, schemas
from corpuscope.cql import analysis
from corpuscope.cql.syntax import parse
from corpuscope.functions import columns
from corpuscope.operators import dataset
from corpuscope.plans import learning, serving
from corpuscope.sources import logs, scratch
from corpuscope.streaming import monitoring


@pytest.fixture
def corpora(spark):
    return spark.createDataFrame([("c_en", 1_000_000_000, "en", "alt")], schemas.CORPORA)


def test_ensemble_from_settings(spark, corpora, tmp_path):
    models.create("ym", 0.9).save(str(tmp_path / "ym"))
    members = [{"modelType": "ym", "modelPath": str(tmp_path / "ym"), "voteThreshold": 0.75}, {"modelType": "ym", "voteThreshold": 0.5}, {"modelType": "rf", "modelPath": "/nowhere", "voteThreshold": 0.5, "disabled": True}]
    (tmp_path / "conf.json").write_text(json.dumps({"rfEnsemble": members}))
    ensemble = models.load_ensemble(spark, logs.Config.load(str(tmp_path / "conf.json")).models)
    assert [(m.kind, m.threshold) for _, m in ensemble] == [("ym", 0.75), ("ym", 0.5)]
    requests = spark.createDataFrame([("[]", "c_en", None, None)], monitoring.REQUESTS)
    assert serving.evaluate_queries(requests, ensemble, corpora).first()["isSlowQuery"] is True
    with pytest.raises(ValueError, match="not 'rf'"):
        models.load_ensemble(spark, [{"modelType": "rf", "modelPath": str(tmp_path / "ym")}])
    with pytest.raises(ValueError, match="modelPath"):
        models.load_ensemble(spark, [{"modelType": "nn"}])


def test_constant_models_are_saved_by_training(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("q"), "id").alias("uniq_key"), F.concat(F.lit("q"), "id").alias("q"), F.lit(20.0).alias("corpusSize"), F.col("id").cast("double").alias("procTime"), F.array(*[F.lit(0.0)] * 50).alias("features"))
    result = learning.train(rows, models.create("zero"), path=str(tmp_path / "zero"))
    assert result.sweep is None
    back = models.load(spark, str(tmp_path / "zero"), 0.3)
    assert (back.kind, back.threshold, back.slow_time, back.inference_only) == ("zero", 0.3, result.midpoint, True)
    assert learning.train(rows, models.create("ym"), path=str(tmp_path / "ym")).sweep.count() == 50
    assert models.load(spark, str(tmp_path / "ym")).kind == "ym"


def test_training_defaults_are_the_published_ones():
    assert models.create("nn").epochs == 800 and models.create("xg").rounds == 200 and models.create("rf").trees == 100


def test_simple_queries_end_to_end(spark, corpora):
    requests = spark.createDataFrame([(["word", "lc"], "x", "c_en", None, None)], "attributes array<string>, value string, corpus string, corpusSize long, lang string")
    ensemble = [("ym", models.AlwaysSlow())]
    strict, loose = (serving.evaluate_simple(requests, ensemble, corpora, s).first() for s in (True, False))
    assert (strict.q, strict.status) == ('word="x" | lc="x"', 500) and (loose.q, loose.status) == ('[word="x" | lc="x"]', 200)


def test_stream_of_a_log_equals_the_whole(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ['{"corpus":"c","query":"q[]","timeProc":1.5}', "not json", "", '{"corpus":"c","corpusSize":"x"}', "[1]", '{"query":"q[]","isSynthetic":true}']
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines) + "\n")
    stream = monitoring.stream_query_log(spark, str(tmp_path / "in"))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    whole = logs.read_query_log(spark, str(tmp_path / "in"), with_obligatory=False).drop("line_no")
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select(*whole.columns).collect()) == sorted(whole.collect())


def test_too_long_a_line_ends_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"query":"' + "x" * (1 << 20) + '"}\n')
    query = monitoring.stream_query_log(spark, str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="too long"):
        query.awaitTermination(120)


def test_prompts(tmp_path):
    (tmp_path / "sysprompt.txt").write_text("default")
    assert logs.save_prompt(str(tmp_path), "own", "mine", "2026-01-02") == "mine.2026-01-02.txt"
    assert logs.load_prompt(str(tmp_path)) == "default" and logs.load_prompt(str(tmp_path), "mine.2026-01-02.txt") == "own"
    with pytest.raises(ValueError, match="empty"):
        logs.save_prompt(str(tmp_path), "")
    with pytest.raises(FileNotFoundError):
        logs.load_prompt(str(tmp_path), "none.txt")


@pytest.mark.parametrize(("query", "bounds"), [('"ab{2}"', (2, -1)), ('"ab{2,}"', (2, -1)), ('"ab{2,30}"', (2, 30))])
def test_numeric_range(query, bounds):
    assert [analysis.numeric_range(n) for n in parse(query).walk() if n.rule == "RgRange"] == [bounds]


def test_big_structures():
    found = [n for n in parse('"a" within <s /> within <doc />').walk() if n.rule == "Structure"]
    assert [analysis.is_big_structure(n) for n in found] == [True, False]


def test_mean_character_value_of_odd_texts(spark):
    rows = spark.createDataFrame([("", "en"), ("ab", "en"), ("A.", "en"), ("é", "xx"), (None, "cs"), ("řa𝒳", "cs")], "t string, lang string")
    got = [r[0] for r in rows.select(columns.mean_character_value("t", "lang")).collect()]
    assert got[0] != got[0] and got[1] == pytest.approx((8.2 + 1.5) / 2) and got[2] == pytest.approx(0.1 / 26) and got[3] == pytest.approx(1 / 30) and got[4] is None
    assert got[5] == pytest.approx((1.186 + 6.698 + 0.1 / 41) / 3)


def test_deduplicate_many_groups(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("key"), F.pmod(F.xxhash64("id"), F.lit(50)).cast("double").alias("procTime"), "id", F.lit("x").alias("other"))
    by_key = {}
    for r in rows.collect():
        by_key.setdefault(r.key, []).append((r.procTime, r.id))
    expected = {k: (min(v)[1], sorted(t for t, _ in v)[-(-len(v) // 2)]) for k, v in by_key.items()}
    got = dataset.deduplicate(rows, "key")
    assert got.columns == rows.columns and {r.key: (r.id, r.procTime) for r in got.collect()} == expected


def test_tables_on_the_way_need_a_shared_folder(spark, monkeypatch):
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert scratch.shared_dir(Session).startswith("file://")
