"""Further queries with their SQL: whole plans, files that are written and read back, models, and texts of reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope import models
from corpuscope.cql.letters import FALLBACK
from corpuscope.functions import columns, cql
from corpuscope.operators import dataset, evaluation, ranking
from corpuscope.plans import catalog, learning, serving
from corpuscope.plans import featurize as featurizing
from corpuscope.sources import logs, scratch

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _path(spark: SparkSession, label: str) -> str:
    return f"{scratch.shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


# -- whole plans -------------------------------------------------------------------------------------
#: Each valid row of the log with its language, word and case of query: wildcards stand behind words, not lemmas.
_VALID = f"""SELECT id, corpus AS w, id % 4 != 0 AS wild, lang, size2 AS size, CASE WHEN "isSynthetic" THEN "timeProc" * 1.0 ELSE "timeProc" END AS t,
 CASE WHEN id % 4 = 0 THEN '[lemma="' || corpus || '"]' ELSE '[word="' || corpus || '.*"]' END AS q FROM ({catalog._REPAIRED}) WHERE known AND "timeProc" > 0"""
_CHANCE = f"""SELECT w, lang, sum(coalesce(p.v, CASE lang WHEN 'cs' THEN 0.1 / 41 WHEN 'en' THEN 0.1 / 26 WHEN 'de' THEN 0.1 / 30 ELSE {FALLBACK!r} END)) / count(*) AS chance
 FROM (SELECT w, lang, unnest(string_split(w, '')) AS ch FROM (SELECT DISTINCT w, lang FROM v)) LEFT JOIN {catalog._LETTER_ROWS} USING (lang, ch) GROUP BY w, lang"""
_VECTORS = f"""WITH v AS MATERIALIZED ({_VALID}), c AS ({_CHANCE}),
 u AS (SELECT q || '-' || printf('%.5f', ln(size)) AS uniq_key, any_value(w) AS w, any_value(lang) AS lang, any_value(wild) AS wild, any_value(size) AS size,
  CASE WHEN count(*) <= 2 THEN avg(t) ELSE list_sort(list(t))[CAST(ceil(count(*) / 2) AS INT) + 1] END AS t FROM v GROUP BY uniq_key),
 p AS (SELECT unnest(range(50)) AS place)
 SELECT uniq_key, round(t, 6) AS "procTime", CAST(place AS INT) AS place, round(CASE place WHEN 1 THEN CASE WHEN wild THEN 20.0 ELSE 0.0 END WHEN 4 THEN length(w) WHEN 5 THEN chance WHEN 6 THEN 1.0 WHEN 46 THEN ln(ln(size)) WHEN 49 THEN 1.0 ELSE 0.0 END, 6) AS value
 FROM u JOIN c USING (w, lang), p"""


@query(_VECTORS)
def featurized_vectors(spark, sf_dir):
    rows, _ = featurizing.featurize(catalog.log(spark, sf_dir), catalog.corpora(spark))
    return catalog.rounded(rows.select("uniq_key", "procTime", F.posexplode("features").alias("place", "value")), 6, "procTime", "value")


@query(f"WITH v AS ({_VALID}) SELECT count(*) AS num_processed, (SELECT count(*) FROM ({catalog.LOG_SQL})) - count(*) AS num_failed, count(DISTINCT q || '-' || printf('%.5f', ln(size))) AS num_features, round(count(DISTINCT q || '-' || printf('%.5f', ln(size))) / count(*), 9) AS dedup_ratio FROM v")
def featurized_stats(spark, sf_dir):
    _, stats = featurizing.featurize(catalog.log(spark, sf_dir), catalog.corpora(spark))
    return catalog.rounded(stats.select("num_processed", "num_failed", "num_features", "dedup_ratio"), 9, "dedup_ratio")


_SLOW = "1 / (1 + exp(-CASE WHEN l.id % 4 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END))"


@query(f"""SELECT l.id, CASE WHEN c.corpus IS NULL THEN 404 ELSE 200 END AS status, CASE WHEN c.corpus IS NULL THEN 'corpus not found' WHEN l.id % 4 = 0 THEN 'false' ELSE 'true' END AS answer, CASE WHEN c.corpus IS NULL THEN 0 WHEN l.id % 4 = 0 THEN 1 ELSE 2 END AS votes_for,
 CASE WHEN c.corpus IS NULL THEN 'nan'::DOUBLE ELSE round((1 - {_SLOW}) / 2, 6) END AS avg_certainty, c."altCorpus" FROM ({catalog.LOG_SQL}) l LEFT JOIN ({catalog.CORPORA_SQL}) c ON l.corpus = c.corpus""")
def served_votes(spark, sf_dir):
    params = [0.0] * 50
    params[1], params[49] = 0.1, -1.0
    requests = catalog.log(spark, sf_dir).select("id", columns.strip_prefix("query").alias("q"), "corpus", F.lit(None).cast("long").alias("corpusSize"), F.lit(None).cast("string").alias("lang"))
    answers = serving.response(serving.evaluate_queries(requests, [("linear", models.LinearScore(params)), ("ym", models.AlwaysSlow())], catalog.corpora(spark)))
    reports = serving.vote_reports(answers.withColumn("corpus", F.col("id").cast("string"))).select(F.col("corpus").cast("long").alias("id"), "votes_for", "avg_certainty")
    said = F.coalesce(F.get_json_object("response", "$.isSlowQuery"), F.get_json_object("response", "$.error"))
    return catalog.rounded(answers.select("id", "status", said.alias("answer"), F.get_json_object("response", "$.altCorpus").alias("altCorpus")).join(reports, "id"), 6, "avg_certainty")


@query(f"SELECT id, CASE WHEN l.corpus IN ('click', 'view', 'purchase', 'signup', 'error') THEN 1 ELSE 0 END AS n_votes FROM ({catalog.LOG_SQL}) l")
def served_by_loaded_ensemble(spark, sf_dir):
    """An ensemble of one enabled constant model that was saved, and a disabled one that isn't there."""
    path = _path(spark, "ensemble")
    models.create("ym", 0.9).save(path)
    ensemble = models.load_ensemble(spark, [{"modelType": "ym", "modelPath": path, "voteThreshold": 0.75}, {"modelType": "rf", "modelPath": "/nowhere", "disabled": True}])
    requests = catalog.log(spark, sf_dir).select("id", columns.strip_prefix("query").alias("q"), "corpus", F.lit(None).cast("long").alias("corpusSize"), F.lit(None).cast("string").alias("lang"))
    return serving.evaluate_queries(requests, ensemble, catalog.corpora(spark)).select("id", F.size("votes").alias("n_votes"))


@query("SELECT p_partkey AS id, 500 AS strict_status, 200 AS status FROM part")
def served_simple(spark, sf_dir):
    """A word in either of two attributes; as the first implementation builds the query, none is accepted."""
    requests = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.array(F.lit("word"), F.lit("lc")).alias("attributes"), F.concat(F.lit("w"), F.translate("p_brand", "#", "")).alias("value"), F.lit("").alias("corpus"), F.lit(0).cast("long").alias("corpusSize"), F.lit("en").alias("lang"))
    ask = lambda strict: serving.evaluate_simple(requests, [("ym", models.AlwaysSlow())], catalog.corpora(spark), strict)
    return ask(True).select("id", F.col("status").alias("strict_status")).join(ask(False).select("id", "status"), "id")


# -- the parser over generated queries -----------------------------------------------------------------
#: Cases by number: text around a word, then what the features of its first position are: range, alternatives, repetition, negation, times the word counts.
CASES = [
    ('[word="', '"]', 0, 1, 0.0, 0, 1.0), ('"', '"', 0, 1, 0.0, 0, 1.0), ('[word!="', '"]', 0, 1, 0.0, 1, 1.0), ('[word="', '"]{2,5}', 0, 1, 5.0, 0, 1.0), ('[word="', '"]+', 0, 1, 100.0, 0, 1.0),
    ('[lemma="', '"]{3}', 0, 1, 100.0, 0, 1.0), ('[word="', 'b{2,3}"]', 1, 1, 0.0, 0, 1.0), ('[word="', '"] & 1.word = 2.word', 0, 1, 0.0, 0, 1.0),
]
BROKEN = [('[word="', ""), ("[word=", '"]'), ('[word="', '"] within 5'), ('[word="a&', '"]')]
_WORDS = "SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS w FROM part"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.regexp_replace(F.lower("p_name"), "[^a-z]", "").alias("w"))


def _around(cases) -> F.Column:
    n = F.col("id") % len(cases)
    out = F.concat(F.lit(cases[0][0]), "w", F.lit(cases[0][1]))
    for i, case in enumerate(cases):
        out = F.when(n == i, F.concat(F.lit(case[0]), "w", F.lit(case[1]))).otherwise(out)
    return out


_CASE_ROWS = "(VALUES " + ", ".join(f"({i}, {r}, {alts}, {rep}::DOUBLE, {neg}, {'true' if 'b{' in tail else 'false'}, {'true' if '&' in tail else 'false'})" for i, (_, tail, r, alts, rep, neg, _) in enumerate(CASES)) + ") AS k(k, has_range, alternatives, repetition, negation, b, n_glob)"


@query(f"""WITH d AS (SELECT id, w || CASE WHEN b THEN 'b' ELSE '' END AS w, k.* FROM ({_WORDS}) JOIN {_CASE_ROWS} ON id % {len(CASES)} = k.k WHERE length(w) > 0),
 c AS (SELECT id, sum(p.v) / count(*) AS chance FROM (SELECT id, unnest(string_split(w, '')) AS ch FROM d) JOIN (SELECT * FROM {catalog._LETTER_ROWS} WHERE lang = 'en') p USING (ch) GROUP BY id)
 SELECT id, true AS valid, CAST(has_range AS DOUBLE) AS has_range, CAST(length(w) AS DOUBLE) AS chars, round(chance, 6) AS chance, CAST(alternatives AS DOUBLE) AS alternatives, repetition, CAST(negation AS DOUBLE) AS negation, CAST(n_glob AS INT)::DOUBLE AS n_glob FROM d JOIN c USING (id)""")
def generated_queries(spark, sf_dir):
    rows = _words(spark, sf_dir).where("w != ''").withColumn("q", _around(CASES))
    f = cql.once(rows.select("id", "q"), {"__q": "q"}, valid=cql.cql_validate("__q") == "valid", f=cql.cql_features("__q", F.lit("en"), F.lit(1_000_000_000), F.lit(0)))
    at = lambda i, name: F.col("f")[i].alias(name)
    return catalog.rounded(f.select("id", "valid", at(2, "has_range"), at(4, "chars"), at(5, "chance"), at(6, "alternatives"), at(7, "repetition"), at(9, "negation"), at(40, "n_glob")), 6, "chance")


@query(f"SELECT id, false AS valid FROM ({_WORDS}) WHERE length(w) > 0")
def generated_faults(spark, sf_dir):
    rows = _words(spark, sf_dir).where("w != ''").withColumn("q", _around(BROKEN))
    return cql.once(rows.select("id", "q"), {"__q": "q"}, valid=cql.cql_validate("__q") == "valid").select("id", "valid")


@query(f"""SELECT id, unnest(['', '', 'doc', 'doc']) AS structure, unnest(['word', 'tag', 'kind', '']) AS name, unnest([w, 'N.*', w || 'x', '']) AS value, unnest(['posattr', 'posattr', 'structattr', 'structure']) AS kind FROM ({_WORDS}) WHERE length(w) > 0""")
def generated_properties(spark, sf_dir):
    rows = _words(spark, sf_dir).where("w != ''").select("id", F.concat(F.lit('[word="'), "w", F.lit('" & tag="N.*"] within <doc kind="'), "w", F.lit('x" />')).alias("q"))
    return cql.once(rows, {"__q": "q"}, props=cql.cql_props("__q")).select("id", F.explode("props").alias("p")).select("id", "p.*", columns.property_kind("p").alias("kind"))


# -- files written and read back -----------------------------------------------------------------------
@query(f"""SELECT corpus, "corpusSize", "subcorpusSize", "timeProc", query, "isSynthetic", "flaggedAsSlow", count(*) AS n FROM ({catalog.LOG_SQL}) GROUP BY ALL""")
def json_lines_read_back(spark, sf_dir):
    path = _path(spark, "log")
    logs.write_json_lines(catalog.log(spark, sf_dir), path)
    back = logs.read_query_log(spark, path, with_obligatory=False).drop("line_no")
    return back.groupBy(*back.columns).agg(F.count("*").alias("n"))


@query(f"SELECT corpus, count(*) AS n FROM ({catalog.LOG_SQL}) GROUP BY corpus UNION ALL SELECT 'syn_v13', 10")
def log_with_obligatory(spark, sf_dir):
    path = _path(spark, "log")
    logs.write_json_lines(catalog.log(spark, sf_dir), path)
    return logs.read_query_log(spark, path).groupBy("corpus").agg(F.count("*").alias("n"))


@query(f'SELECT id, "procTime", score, (SELECT count(*) FROM events) AS n FROM ({catalog.TIMES_SQL})')
def features_read_back(spark, sf_dir):
    path, rows = _path(spark, "features"), catalog.times(spark, sf_dir).drop("key")
    logs.write_features(rows, rows.agg(F.count("*").alias("n")), path)
    back, stats = logs.read_features(spark, path)
    return back.crossJoin(stats)  # one row on the right


@query(f"SELECT id, [value - 100, CAST(user_id AS DOUBLE), 7.0, 0.0][1] AS first, CAST(value >= 100 AS INT) AS label FROM (SELECT event_id AS id, * FROM events)")
def matrix_read_back(spark, sf_dir):
    path = _path(spark, "matrix")
    rows = catalog._features(spark, sf_dir).join(catalog.times(spark, sf_dir).select("id", "procTime"), "id")
    held = dataset.labelled(rows, 100.0).withColumn("features", F.concat("features", F.array(F.col("id").cast("double"))))
    logs.write_matrix(held, path)
    return logs.read_matrix(spark, path).select(F.col("features")[4].cast("long").alias("id"), F.col("features")[0].alias("first"), "label")


# -- data sets -----------------------------------------------------------------------------------------
@query(f"SELECT id, 4::BIGINT AS n FROM ({catalog.TIMES_SQL})")
def replicated_rows(spark, sf_dir):
    return dataset.replicated(catalog.times(spark, sf_dir), 4).groupBy("id").agg(F.count("*").alias("n"))


@query(f'SELECT CAST("procTime" >= 100 AS INT) AS label, CAST(floor(count(*) * 0.8) AS BIGINT) AS n_train, count(*) - CAST(floor(count(*) * 0.8) AS BIGINT) AS n_test, 0::BIGINT AS n_both FROM ({catalog.TIMES_SQL}) GROUP BY label')
def stratified_split_sizes(spark, sf_dir):
    rows = dataset.labelled(catalog.times(spark, sf_dir), 100.0)
    train, test = dataset.stratified_split(rows, ["id"])
    both = train.select("id", "label", F.lit(1).alias("train"), F.lit(0).alias("test")).unionByName(test.select("id", "label", F.lit(0).alias("train"), F.lit(1).alias("test")))
    each = both.repartition(ranking.tasks_for(rows), "id", "label").groupBy("id", "label").agg(F.sum("train").alias("train"), F.sum("test").alias("test"))
    return each.groupBy("label").agg(F.sum("train").alias("n_train"), F.sum("test").alias("n_test"), F.sum(((F.col("train") > 0) & (F.col("test") > 0)).cast("long")).alias("n_both"))


@query("SELECT count(*) AS n, count(*) AS n_ids, true AS near_half FROM events")
def split_halves(spark, sf_dir):
    first, second = dataset.split(catalog.times(spark, sf_dir))
    both = first.select("id", F.lit(1).alias("half")).unionByName(second.select("id", F.lit(0).alias("half")))
    n = F.count("*")
    return both.agg(n.alias("n"), F.count_distinct("id").alias("n_ids"), (F.abs(F.sum("half") - n / 2) < 4 * F.sqrt(n)).alias("near_half"))


@query("SELECT least(count(*), 25) AS n FROM events")
def sampled_rows(spark, sf_dir):
    return dataset.sample_rows(catalog.times(spark, sf_dir), 25).agg(F.count("*").alias("n"))


# -- models ----------------------------------------------------------------------------------------------
def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows whose time follows from two features, so that any learner can tell slow ones."""
    noise = F.array(*[(F.pmod(F.xxhash64("event_id", F.lit(i)), F.lit(100)) / 100.0).alias(f"f{i}") for i in range(48)])
    slow = F.col("user_id") % 5 == 0
    events = catalog._events(spark, sf_dir).select("event_id", "user_id")
    dealt = events.repartition(ranking.tasks_for(events))  # features take many times the bytes of an event, and a file of events may be one task
    rows = dealt.select(F.col("event_id").cast("string").alias("uniq_key"), F.col("event_id").cast("string").alias("q"), F.lit(20.0).alias("corpusSize"), F.when(slow, 300 + F.col("event_id") % 97).otherwise((F.col("event_id") % 97) / 97.0).cast("double").alias("procTime"), F.concat(F.array(F.when(slow, 1.0).otherwise(0.0), F.lit(1.0)), noise).alias("features"))
    return rows


SMALL = {"rf": {"trees": 5, "depth": 4}, "nn": {"epochs": 20, "copies": 1}, "xg": {"rounds": 3, "depth": 3}}


@query("SELECT kind, count(*) AS n, count(*) AS n_same, 50::BIGINT AS n_thresholds FROM events, (VALUES ('rf'), ('nn'), ('xg')) AS k(kind) GROUP BY kind")
def models_saved_and_loaded(spark, sf_dir):
    """For each kind that learns: rows on which the saved model, loaded again, says the same; and rows of the sweep on all data."""
    rows = scratch.written(_training(spark, sf_dir), "training")
    prepared, out = learning.prepare(rows), []
    for kind, how in SMALL.items():
        path = _path(spark, f"model-{kind}")
        result = learning.train(prepared, models.create(kind, **how), path=path)
        a = result.model.score(rows).select("features", F.col("predicted_class").alias("a"))
        same = models.load(spark, path).score(a).withColumnRenamed("predicted_class", "b").agg(F.count("*").alias("n"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("n_same"))
        out.append(same.select(F.lit(kind).alias("kind"), "n", "n_same").crossJoin(result.sweep.agg(F.count("*").alias("n_thresholds"))))  # one row each
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""SELECT count(*) FILTER (user_id % 5 = 0) AS hits, count(*) FILTER (user_id % 5 = 0) AS retrieved, count(*) FILTER (user_id % 5 = 0) AS relevant, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f_beta FROM events""")
def boosted_trees_tell_slow_rows(spark, sf_dir):
    """Boosted trees, trained on balanced rows around the knee, over all rows: one feature tells slow ones for certain."""
    rows = scratch.written(_training(spark, sf_dir), "training")
    model = learning.train(rows, models.create("xg", rounds=5, depth=3)).model
    return evaluation.precision_recall(model.score(rows), F.col("procTime") >= 300, F.col("predicted_class") == 1)


@query("SELECT kind, threshold, info, n_votes, cls FROM (VALUES ('ym', 0.9::DOUBLE, 'ym, threshold 0.90', 2, 1), ('zero', 0.25::DOUBLE, 'zero, threshold 0.25', 0, 0)) AS t(kind, threshold, info, n_votes, cls)")
def constant_models_saved(spark, sf_dir):
    out = []
    for kind, threshold in (("ym", 0.9), ("zero", 0.25)):
        path = _path(spark, f"model-{kind}")
        models.create(kind, threshold).save(path)
        back = models.load(spark, path)
        row = spark.range(1).select(F.lit(back.kind).alias("kind"), F.lit(back.threshold).alias("threshold"), F.lit(back.info()).alias("info"))
        out.append(back.score(row).select("kind", "threshold", "info", F.size("votes").alias("n_votes"), F.col("predicted_class").alias("cls")))
    return out[0].unionByName(out[1])


# -- texts of reports ------------------------------------------------------------------------------------
@query("""SELECT event_id AS id, event_type || '-' || printf('%.5f', ln(1000.0 + event_id)) AS uniq_key, CASE WHEN event_id % 2 = 0 THEN 'fast' ELSE 'slow' END AS speed, (event_id % 7) || '.' || (event_id % 3) AS version,
 substr(repeat(event_type, 20), 1, 80) AS short, 'numProcessed: ' || event_id || ', numFailed: ' || user_id || ', deduplicationRatio: 0.50' AS comment, 'word="' || event_type || '" | lc="' || event_type || '"' AS simple, 'features.v1.' || (event_id % 10) AS base FROM events""")
def report_texts(spark, sf_dir):
    e, n, w = catalog._events(spark, sf_dir), F.col("event_id"), F.col("event_type")
    version = F.concat(F.lit("'v"), (n % 7).cast("string"), F.lit("."), (n % 3).cast("string"), F.lit("'"))
    name = F.concat(F.lit("features.v1."), (n % 10).cast("string"), F.lit(".nonzero.msgpack"))
    return e.select(
        n.alias("id"), columns.evaluation_key(w, F.ln(1000.0 + n)).alias("uniq_key"), columns.fast_or_slow(n % 2).alias("speed"), columns.clean_version(version).alias("version"), columns.short_error(F.repeat(w, F.lit(20))).alias("short"),
        columns.stats_comment(n, F.col("user_id"), F.lit(0.5)).alias("comment"), columns.simple_query(F.array(F.lit("word"), F.lit("lc")), w).alias("simple"), columns.model_base_name(name).alias("base"),
    )


@query("SELECT doc_id, round(length(text) / len(regexp_extract_all(text, '\\p{Lu}')), 6) AS ratio FROM documents WHERE regexp_matches(text, '\\p{Lu}')")
def uppercase_ratios(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").rlike(r"\p{Lu}"))
    return catalog.rounded(docs.select("doc_id", columns.uppercase_ratio("text").alias("ratio")), 6, "ratio")


@query("SELECT event_id AS id, CAST(place AS INT) AS place, value * place AS value FROM events, (SELECT unnest(range(50)) AS place)")
def params_there_and_back(spark, sf_dir):
    values = F.array(*[F.col("value") * i for i in range(50)])
    held = catalog._events(spark, sf_dir).select("event_id", columns.params_struct(values, columns.PARAM_NAMES).alias("p"))
    return held.select(F.col("event_id").alias("id"), F.posexplode(columns.params_array("p", columns.PARAM_NAMES)).alias("place", "value"))
