import json

import pytest
from pyspark.sql import functions as F

from corpuscope import models, schemas
from corpuscope.functions import columns, cql
from corpuscope.operators import dataset, evaluation, normalize, ranking
from corpuscope.plans import featurize, learning, serving
from corpuscope.sources import logs
from corpuscope.streaming import monitoring

LINES = """{"corpus":"c_en","corpusSize":1000000000,"subcorpusSize":0,"timeProc":1.5,"query":"aword,[word=\\"moto[a-z]\\"]"}
{"corpus":"c_en","corpusSize":0,"timeProc":2.0,"query":"q[lemma=\\"a\\" | word=\\"b\\"]","isSynthetic":true}
{"corpus":"unknown","corpusSize":0,"timeProc":2.0,"query":"q[]"}
{"corpus":"c_en","corpusSize":1000000000,"timeProc":0,"query":"q[word=\\"x\\"]"}
not json

{"corpus":"c_en","corpusSize":1000000000,"timeProc":3.0,"query":"q[word=\\"broken"}
"""


@pytest.fixture
def corpora(spark):
    return spark.createDataFrame([("c_en", 1_000_000_000, "en", "alt"), ("syn_v13", 6_400_899_055, "cs", "")], schemas.CORPORA)


@pytest.fixture
def log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text(LINES)
    return logs.read_query_log(spark, str(tmp_path / "log.jsonl"))


def test_scan_and_counters(log, corpora):
    assert log.count() == 15
    assert tuple(normalize.counters(log, corpora).first()) == (13, 2)
    rows, stats = featurize.featurize(log, corpora, 1.5)
    kept = {r.q: r for r in rows.collect()}
    assert len(kept) == 12 and kept['[lemma="a" | word="b"]'].procTime == 3.0
    assert stats.first()["dedup_ratio"] == pytest.approx(12 / 13)
    one = kept['[word="moto[a-z]"]'].features
    assert len(one) == 50 and one[4:9] == pytest.approx([4.0, 6.625, 1.0, 0.0, 10.0]) and one[46] == pytest.approx(3.031257022584175)
    assert "AvgCharProb: 6.6" in rows.where("q LIKE '%moto%'").select(columns.show_evaluation().alias("s")).first()["s"]


def test_too_long_a_line_is_an_error(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"query":"' + "x" * (1 << 20) + '"}\n')
    with pytest.raises(Exception, match="too long"):
        logs.read_query_log(spark, str(tmp_path / "log.jsonl")).collect()


def test_json_lines_round_trip(spark, log, tmp_path):
    logs.write_json_lines(log, str(tmp_path / "out"))
    back = logs.read_query_log(spark, str(tmp_path / "out"), with_obligatory=False)
    assert sorted(back.drop("line_no").collect()) == sorted(log.drop("line_no").collect())
    text = spark.read.text(str(tmp_path / "out"))
    assert text.where("value LIKE '%flaggedAsSlow%'").count() == 0 and text.where("value LIKE '%isSynthetic%'").count() == 1


@pytest.mark.parametrize(("times", "median"), [([5], 5), ([1, 3], 2), ([1, 2, 9], 9), ([1, 2, 3, 4], 3), ([1, 2, 3, 4, 5], 4)])
def test_group_median(spark, times, median):
    rows = spark.createDataFrame([("k", float(t), i) for i, t in enumerate(times)], "key string, procTime double, id long")
    assert [tuple(r) for r in dataset.deduplicate(rows, "key").collect()] == [("k", float(median), 0)]


def test_rank_with_one_hot_value(spark):
    rows = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("v"), F.col("id"))
    ranked = ranking.with_rank(rows, ["v", "id"]).collect()
    assert [r.rank for r in sorted(ranked, key=lambda r: (r.v, r.id))] == list(range(3000))
    assert ranking.with_rank(rows.limit(0), ["v"]).collect() == []


def test_knee_of_few_rows(spark):
    one = spark.createDataFrame([(3.0, 1)], "procTime double, id long")
    assert tuple(dataset.knee(dataset.sorted_by_time(one)).first())[:2] == (3.0, 100)
    assert dataset.knee(dataset.sorted_by_time(one.limit(0))).collect() == []


def test_precision_without_retrieved_rows(spark):
    rows = spark.createDataFrame([(True, False)] * 3, "t boolean, p boolean")
    r = evaluation.precision_recall(rows, F.col("t"), F.col("p")).first()
    assert r.precision != r.precision and r.recall == 0 and r.f_beta == 0
    assert len(evaluation.THRESHOLDS) == 50 and 0.99 < evaluation.THRESHOLDS[49] < 0.99 + 1e-12


def test_classification_report(spark):
    rows = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 5 + [(0, 1)], "label int, predicted_class int")
    got = {r["class"]: (r.precision, r.recall, r.support) for r in evaluation.classification_report(rows).collect()}
    assert got == {1: (0.75, 0.75, 4), 0: (5 / 6, 5 / 6, 6)}


def test_strings(spark):
    row = spark.createDataFrame([(99_999, 121_826_797, 6_400_000_000, "cql_features.v7.144.nonzero.msgpack", "'v1.2'", ["word", "lc"])], "a long, b long, c long, f string, v string, l array<string>")
    got = row.select(columns.rough_size("a"), columns.rough_size("b"), columns.rough_size("c"), columns.model_base_name("f"), columns.clean_version("v"), columns.simple_query("l", F.lit("x")), columns.simple_query("l", F.lit("x"), strict=False)).first()
    assert tuple(got) == ("~0", "121.8M", "6.4G", "cql_features.v7.144", "1.2", 'word="x" | lc="x"', '[word="x" | lc="x"]')


def test_sql_functions(spark):
    cql.register(spark)
    assert spark.sql("""SELECT cql_validate('[word="x"]') AS a, cql_validate('[') LIKE 'invalid: %' AS b, cql_json('[') AS c""").first() == ("valid", True, None)
    rows = spark.sql("""SELECT * FROM cql_nodes('[word="x"]')""").collect()
    assert rows[0].rule == "Query" and rows[0].parent_id is None and rows[1].parent_id == 0
    assert spark.sql("""SELECT p.name FROM (SELECT inline(cql_props('[word="x"] within <s>')) AS (structure, name, value)) p ORDER BY 1""").count() == 2
    kinds = spark.sql("""SELECT explode(cql_props('[word="x"] within <s a="b">')) AS p""").select(columns.property_kind("p").alias("k")).collect()
    assert sorted(r.k for r in kinds) == ["posattr", "structattr", "structure"]


@pytest.fixture(scope="module")
def training(spark):
    x = F.array(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100)) / 100.0).alias(str(i)) for i in range(49)], F.lit(1.0))
    rows = spark.range(600).withColumn("features", x).withColumn("procTime", F.when(F.col("features")[1] > 0.8, 200 + F.col("id") % 90).otherwise(F.col("features")[2] * 5).cast("double"))
    return rows.select(F.concat(F.lit("q"), "id").alias("uniq_key"), F.concat(F.lit("q"), "id").alias("q"), F.lit(20.0).alias("corpusSize"), "procTime", "features").cache()


@pytest.mark.parametrize("kind", ["rf", "nn", "xg"])
def test_train_save_load_report(spark, training, tmp_path, kind):
    how = {"rf": {"trees": 10, "depth": 5}, "nn": {"epochs": 15, "copies": 1}, "xg": {"rounds": 5, "depth": 3}}[kind]
    result = learning.train(training, models.create(kind, 0.5, **how), path=str(tmp_path / "m"))
    sweep = result.sweep.collect()
    assert len(sweep) == 50 and max(r.f_beta for r in sweep) > (0.5 if kind == "nn" else 0.9)
    back = models.load(spark, str(tmp_path / "m"))
    assert back.kind == kind and back.slow_time == result.midpoint
    a, b = (m.score(training).select("uniq_key", "predicted_class").collect() for m in (result.model, back))
    assert sorted(a) == sorted(b)
    logs.write_sweep(result.sweep, str(tmp_path / "sweep"))
    logs.write_misclassified(result.misclassified, str(tmp_path / "wrong"))
    assert spark.read.csv(str(tmp_path / "sweep"), sep=";", header=True).count() == 50
    if kind == "rf":
        assert len(models.importances(result.model)) == 10
        assert models.pr_auc(result.model.score(dataset.labelled(training, result.midpoint))) > 0.8


def test_balanced_sample_and_splits(spark, training):
    ranked = dataset.sorted_by_time(training, tie="uniq_key")
    got = dataset.balanced_sample(ranked, 500, 600)
    assert got.where("rank >= 500").count() == 100 and got.where("rank < 500").count() == 200
    assert dataset.balanced_sample(ranked, 0, 600).count() == 600
    train, test = dataset.stratified_split(dataset.labelled(training, 100.0), ["uniq_key"])
    assert train.count() + test.count() == 600 and abs(train.where("label = 1").count() - 0.8 * training.where("procTime >= 100").count()) < 1


def test_serving_batch_equals_stream(spark, corpora, tmp_path):
    rows = [("[]", "c_en", None, None), ("[", "c_en", None, None), ('[word="x"]', "nowhere", None, None), ('[word="x"]', "c_en", 5, "en"), ('[word="x"]', None, None, "cs"), (None, "", 0, None)]
    requests = spark.createDataFrame(rows, monitoring.REQUESTS)
    params = [0.0] * 50
    params[1], params[49] = 1.0, -5.0
    ensemble = [("linear", models.LinearScore(params)), ("ym", models.AlwaysSlow()), ("again", models.LinearScore(params))]
    answers = serving.evaluate_queries(requests, ensemble, corpora)
    got = {(r.q, r.corpus): (r.status, r.isSlowQuery, r.altCorpus) for r in answers.collect()}
    assert got == {("[]", "c_en"): (200, True, "alt"), ("[", "c_en"): (500, None, "alt"), ('[word="x"]', "nowhere"): (404, None, ""), ('[word="x"]', "c_en"): (400, None, "alt"), ('[word="x"]', None): (200, False, ""), (None, ""): (500, None, "")}
    assert json.loads(serving.response(answers).where("q = '[]'").first()["response"])["isSlowQuery"] is True
    requests.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(monitoring.REQUESTS).json(str(tmp_path / "in"))
    monitoring.answer_stream(stream, ensemble, corpora, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    columns_ = ["votes_for", "votes_against", "corpus", "num_errors"]
    batch, streamed = serving.vote_reports(answers), spark.read.parquet(str(tmp_path / "out"))
    assert sorted(batch.select(*columns_).collect()) == sorted(streamed.select(*columns_).collect())
    assert monitoring.roll_up(streamed).agg(F.sum("n")).first()[0] == 6
    monitoring.discard(batch)


def test_measure_leaves_out_errors(spark, corpora, log):
    rows = normalize.missing(log)

    def client(corpus, cql):
        if "x" in cql:
            return 2.5
        raise RuntimeError

    got = normalize.measure(rows, corpora, client).collect()
    assert [(r.query, r.timeProc, r.isSynthetic) for r in got] == [('q[word="x"]', 2.5, True)]


def test_config_and_files(spark, tmp_path):
    (tmp_path / "conf.json").write_text(json.dumps({"corporaProps": {"b": {"size": 2, "lang": "cs"}, "a": {"size": 1, "altCorpus": "b"}}, "syntheticRecordsTimeCorrection": 1.1}))
    config = logs.Config.load(str(tmp_path / "conf.json"))
    assert config.synthetic_time_correction == 1.0 and [r.corpus for r in config.corpora_frame(spark).collect()] == ["a", "b"]
    logs.save_params([float(i) for i in range(50)], str(tmp_path / "p.json"))
    assert logs.load_params(str(tmp_path / "p.json"))[49] == 49.0
    (tmp_path / "m.metadata.json").write_text('{"objective":"binary","metric":["auc"],"max_depth":6}')
    assert logs.read_metadata(spark, str(tmp_path / "m.txt.gz")).first()["max_depth"] == 6
    assert logs.read_metadata(spark, str(tmp_path / "none.txt")) is None
    (tmp_path / "reg").mkdir()
    (tmp_path / "reg" / "syn").write_text('NAME "x"\nATTRIBUTE word\n  ATTRIBUTE "lemma" {\n}\nSTRUCTURE doc {\n ATTRIBUTE id\n}\n')
    assert logs.read_registry(spark, str(tmp_path / "reg")).first()["attributes"][:2] == ["word", "lemma"]
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / logs.prompt_name("", "2026-01-02")).write_text("x")
    assert [r.name for r in logs.list_prompts(spark, str(tmp_path / "prompts")).collect()] == ["update.2026-01-02.txt"]


def test_repl(spark, capsys):
    from corpuscope.__main__ import repl

    repl(spark, models.AlwaysSlow(), ["setup", "set vote 0.5", "set lang en", '[word="x"]', "[", "exit", "never"])
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "corpussize: 6400000000, vote: 0.85, lang: cs" and out[1].startswith("slow") and len(out) == 3


def test_reports_are_in_order(spark):
    log = spark.createDataFrame([(c, 0.0) for c in ["b", "a", "a", "c", "c", "d"]] + [("a", 1.0)], "corpus string, timeProc double")
    assert [tuple(r) for r in normalize.zero_by_corpus(log).collect()] == [("a", 2), ("c", 2), ("b", 1), ("d", 1)]
    corpora = spark.createDataFrame([("x", 2 * 10**8, "", ""), ("small", 10**8, "", ""), ("y", 3 * 10**8, "", ""), ("a", 2 * 10**8, "", "")], schemas.CORPORA)
    assert [r.corpus for r in dataset.large_corpora(corpora).collect()] == ["y", "a", "x"]
    rows = spark.createDataFrame([("once", 0.505, 200.0), ("often", 0.9, 1.0), ("some", 0.7, 1.0)], "key string, score double, procTime double")
    report = evaluation.report_order(evaluation.misclassified(rows, "key", "score", "procTime", 100.0, 100.0)).collect()
    assert [r.key for r in report] == sorted((r.key for r in report), key=lambda k: next((-r.num_repeat, -r.error_size) for r in report if r.key == k))
    assert len({r.num_repeat for r in report}) == 3
