"""Named queries over the driver's tables, and the same in SQL.

No table is a query log, so one is derived from events: corpus from event_type, time from value. Sizes
and languages of the corpora, and the cases of the language, stand here as values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope import schemas
from corpuscope.cql.letters import FALLBACK, TABLES
from corpuscope.functions import columns, cql
from corpuscope.models import AlwaysSlow, LinearScore
from corpuscope.operators import dataset, evaluation, normalize, ranking, voting
from corpuscope.plans import featurize as featurizing
from corpuscope.plans import serving

CORPORA = [("click", 1_500_000_000, "en", "click_alt"), ("view", 4_000_000_000, "cs", ""), ("purchase", 90_000_000, "de", ""), ("signup", 250_000_000, "fr", ""), ("error", 6_400_899_055, "en", "error_small")]
LOG_SQL = """SELECT event_id AS id, event_id AS line_no, event_type AS corpus,
 CASE WHEN event_id % 6 = 0 THEN 0 ELSE 1000000 * (1 + user_id % 7) END AS "corpusSize", CAST(0 AS BIGINT) AS "subcorpusSize",
 CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE value END AS "timeProc",
 CASE WHEN event_id % 4 = 0 THEN 'q[lemma="' || event_type || '"]' ELSE 'aword,[word="' || event_type || '.*"]' END AS query,
 event_id % 10 = 0 AS "isSynthetic", false AS "flaggedAsSlow" FROM events"""
CORPORA_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {s}, '{la}', '{a}')" for c, s, la, a in CORPORA) + ') AS t(corpus, size, lang, "altCorpus")'

ACCEPT = ['[word="rose[a-z]"]', '"cats|dogs"', '[lemma="von|-|"]', '[word="^[[:digit:]]{9}$"]', '[morph="Case=Nom" & pos="NOUN"]', '(meet [lemma="a"][lemma="b"] 0 15)', '[word="x"] within <s>', "[]", '[word="a"]{2,5} & 1.word = 2.word', '1:[word="x"] 2:[] & f(1.word) > 10', '<doc id="a|b" /> []{1,3} </doc>', '[word=="abc" | !(tag="N.*")]']
REJECT = ["", '[word="x"] ', '[word="a&b"]', '[word="x"] within 5', '[word=="a.b"]', 'word="x"', '[word="x"', "(())", '[word="[z"]']
PROPS = [('[word="up|down"] [lemma="town" & tag="V.*"] within <book title="a: b" & kind="x,yz">', [("", "word", "up|down"), ("", "lemma", "town"), ("", "tag", "V.*"), ("book", "title", "a: b"), ("book", "kind", "x,yz"), ("book", "", "")]), ('[tag="Q@.+"]', [("", "tag", "Q@.+")]), ('[word="x"] within <s>', [("", "word", "x"), ("s", "", "")]), ('"name.*"', [("", "", "name.*")])]
#: query, then non-zero places of its vector on an English corpus of 1e9 tokens, besides 46 and 49.
VECTORS = [
    ("[]", {0: 1.0, 1: 500.0, 6: 1.0}), ('[tag="N.*"]', {1: 20.0, 3: 500.0, 4: 1.0, 5: 0.1 / 26, 6: 1.0}), ('[word="rose[a-z]"]', {4: 4.0, 5: 8.125, 6: 1.0, 8: 10.0}), ('"cats|dogs"', {4: 8.0, 5: 5.8125, 6: 1.0}),
    ('[word="a"]{2}', {4: 1.0, 5: 8.2, 6: 1.0, 7: 100.0}), ('[word!="a"]', {4: 1.0, 5: 8.2, 6: 1.0, 9: 1.0}), ('[word="x"] within <text group="A|B" />', {4: 1.0, 5: 0.15, 6: 1.0, 43: 1.0, 44: 1.0}),
    ('(union [lemma="a"] [lemma="b"])', {4: 1.0, 5: 9.7, 6: 2.0, 14: 2.0, 15: 17.9, 16: 1.0, 24: 3.0, 25: 19.4, 26: 1.0, 41: 1.0}), ('[word="a"] & 1.word = 2.word', {4: 1.0, 5: 8.2, 6: 1.0, 40: 1.0}), ('[word="[^abc]"]', {4: 3.0, 5: 12.5 / 3, 6: 1.0, 8: 15.0}),
]
SIZES = [99_999, 121_826_797, 6_400_000_000, 100_000, 999_999_999, 1_000_000_000]
OPTIONS = ["*", "+", "?", "{2}", "{2,}", "{2,5}"]


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = _events(spark, sf_dir), F.col("event_id")
    return e.select(
        n.alias("id"), n.alias("line_no"), F.col("event_type").alias("corpus"), F.when(n % 6 == 0, 0).otherwise(1_000_000 * (1 + F.col("user_id") % 7)).cast("long").alias("corpusSize"), F.lit(0).cast("long").alias("subcorpusSize"),
        F.when(n % 9 == 0, 0.0).otherwise(F.col("value")).alias("timeProc"), F.when(n % 4 == 0, F.concat(F.lit('q[lemma="'), "event_type", F.lit('"]'))).otherwise(F.concat(F.lit('aword,[word="'), "event_type", F.lit('.*"]'))).alias("query"),
        (n % 10 == 0).alias("isSynthetic"), F.lit(False).alias("flaggedAsSlow"),
    )


def corpora(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CORPORA, schemas.CORPORA)


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations with id, procTime and a score of their own."""
    score = F.round(F.pmod(F.col("event_id") * 37 + F.col("user_id") * 11, F.lit(101)) / 101.0, 6)
    return _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("value").alias("procTime"), score.alias("score"))


TIMES_SQL = "SELECT event_id AS id, event_type || '/' || user_id AS key, value AS \"procTime\", round(((event_id * 37 + user_id * 11) % 101) / 101.0, 6) AS score FROM events"


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_STRIP = "CASE WHEN query[1] = 'q' THEN query[2:] WHEN contains(query, ',') THEN regexp_replace(query, '^[^,]*,', '') ELSE query END"
_REPAIRED = f"""SELECT l.*, CASE WHEN l."corpusSize" = 0 THEN coalesce(c.size, 0) ELSE l."corpusSize" END AS size2, coalesce(c.lang, '') AS lang, l."corpusSize" != 0 OR c.corpus IS NOT NULL AS known FROM ({LOG_SQL}) l LEFT JOIN ({CORPORA_SQL}) c ON l.corpus = c.corpus"""


@query(f"SELECT id, {_STRIP} AS cql FROM ({LOG_SQL})")
def log_strip_prefix(spark, sf_dir):
    return log(spark, sf_dir).select("id", columns.strip_prefix("query").alias("cql"))


@query(f'SELECT id, size2 AS "corpusSize", lang, known FROM ({_REPAIRED})')
def log_repair_size(spark, sf_dir):
    return normalize.repair_size(log(spark, sf_dir), corpora(spark)).select("id", "corpusSize", "lang", "known")


@query(f'SELECT id, CASE WHEN "isSynthetic" THEN "timeProc" * 1.5 ELSE "timeProc" END AS "timeProc", {_STRIP} AS cql FROM ({_REPAIRED}) WHERE known AND "timeProc" > 0')
def log_valid_rows(spark, sf_dir):
    return normalize.valid_rows(log(spark, sf_dir), corpora(spark), 1.5).select("id", "timeProc", "cql")


@query(f'SELECT count(*) FILTER (known AND "timeProc" > 0) AS num_processed, count(*) FILTER (NOT (known AND "timeProc" > 0)) AS num_failed FROM ({_REPAIRED})')
def log_counters(spark, sf_dir):
    return normalize.counters(log(spark, sf_dir), corpora(spark))


@query(f'SELECT id, corpus, "timeProc" FROM ({LOG_SQL}) WHERE "timeProc" > 0')
def remove_zero(spark, sf_dir):
    return normalize.remove_zero(log(spark, sf_dir)).select("id", "corpus", "timeProc")


@query(f"SELECT corpus, count(*) AS count FROM ({LOG_SQL}) WHERE \"timeProc\" <= 0 AND corpus IN ('click', 'view', 'error') GROUP BY corpus")
def zero_by_corpus(spark, sf_dir):
    installed = spark.createDataFrame([("click",), ("view",), ("error",)], "corpus string")
    return normalize.zero_by_corpus(log(spark, sf_dir), installed)


_MISSING = f"""SELECT * FROM (SELECT *, "corpusSize" || '/' || "subcorpusSize" || '/' || query AS uniq_key, row_number() OVER (PARTITION BY "corpusSize", "subcorpusSize", query ORDER BY line_no) AS n FROM ({LOG_SQL}) WHERE ("timeProc" = 0 OR "corpusSize" = 0) AND corpus IN ('click', 'view', 'purchase')) WHERE n = 1"""


@query(f"SELECT id, uniq_key FROM ({_MISSING})")
def missing_first_wins(spark, sf_dir):
    return normalize.missing(log(spark, sf_dir), ["click", "view", "purchase"]).select("id", "uniq_key")


@query(f"SELECT id, uniq_key FROM ({_MISSING}) ORDER BY uniq_key LIMIT 7 OFFSET 3")
def missing_batch(spark, sf_dir):
    return normalize.batch(normalize.missing(log(spark, sf_dir), ["click", "view", "purchase"]), 3, 7).select("id", "uniq_key")


@query(f"""SELECT id, uniq_key, CASE WHEN id % 2 = 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS "timeProc", true AS "isSynthetic" FROM ({_MISSING}) WHERE "timeProc" <= 0""")
def missing_measured(spark, sf_dir):
    rows = normalize.missing(log(spark, sf_dir), ["click", "view", "purchase"])
    measured = normalize.measure(rows, corpora(spark), lambda corpus, cql: 1.0)
    return measured.select("id", "uniq_key", F.when(F.col("id") % 2 == 0, F.col("timeProc") / 4).otherwise(F.col("timeProc") / 2).alias("timeProc"), "isSynthetic")


_GROUPS = f"""SELECT key, min_by(id, ("procTime", id)) AS id, CASE WHEN count(*) <= 2 THEN avg("procTime") ELSE list_sort(list("procTime"))[CAST(ceil(count(*) / 2) AS INT) + 1] END AS t FROM ({TIMES_SQL}) GROUP BY key"""


@query(f'SELECT key, id, round(t, 6) AS "procTime" FROM ({_GROUPS})')
def dedup_median(spark, sf_dir):
    return rounded(dataset.deduplicate(times(spark, sf_dir), "key").select("key", "id", "procTime"), 6, "procTime")


@query(f"SELECT round(count(DISTINCT key) / count(*), 9) AS dedup_ratio FROM ({TIMES_SQL})")
def dedup_ratio(spark, sf_dir):
    t = times(spark, sf_dir)
    n = dataset.deduplicate(t, "key").agg(F.count("*").alias("n"))
    return n.join(t.agg(F.count("*").alias("m"))).select(F.round(F.col("n") / F.col("m"), 9).alias("dedup_ratio"))


_SORTED = f'SELECT id, score, key, least("procTime", 450.0) AS "procTime", row_number() OVER (ORDER BY "procTime", id) - 1 AS rank FROM ({TIMES_SQL})'
_KNEE = f"""WITH s AS ({_SORTED}), e AS (SELECT count(*) AS n, min_by("procTime", rank) AS y1, max_by("procTime", rank) AS y2 FROM s),
 d AS (SELECT s.*, n, abs((y2 - y1) * rank - (n - 1) * "procTime" + (n - 1) * y1) / sqrt((y2 - y1) * (y2 - y1) + (n - 1) * (n - 1)) AS d FROM s, e)
 SELECT "procTime" AS threshold, rank AS idx, n, rank / n AS slow_percentile FROM d ORDER BY d DESC, rank LIMIT 1"""


@query(_SORTED.replace("score, key, ", ""))
def cap_sort(spark, sf_dir):
    return dataset.sorted_by_time(times(spark, sf_dir)).select("id", "procTime", "rank")


@query(f"SELECT round(threshold, 6) AS threshold, idx, n FROM ({_KNEE})")
def knee(spark, sf_dir):
    return rounded(dataset.knee(dataset.sorted_by_time(times(spark, sf_dir))).select("threshold", "idx", "n"), 6, "threshold")


@query(f"SELECT round(slow_percentile, 9) AS slow_percentile FROM ({_KNEE})")
def slow_percentile(spark, sf_dir):
    return rounded(dataset.knee(dataset.sorted_by_time(times(spark, sf_dir))).select("slow_percentile"), 9, "slow_percentile")


@query(f'SELECT id, CAST("procTime" >= 100 AS INT) AS label FROM ({TIMES_SQL})')
def binary_label(spark, sf_dir):
    return dataset.labelled(times(spark, sf_dir), 100.0).select("id", "label")


@query(f'SELECT count(*) FILTER ("procTime" >= 100) AS n_positive, count(*) FILTER ("procTime" < 100) AS n_negative, round(count(*) FILTER ("procTime" < 100) / count(*) FILTER ("procTime" >= 100), 9) AS scale_pos_weight FROM ({TIMES_SQL})')
def class_weights(spark, sf_dir):
    return rounded(dataset.class_weights(dataset.labelled(times(spark, sf_dir), 100.0)), 9, "scale_pos_weight")


@query(f'SELECT CAST("procTime" >= 100 AS INT) AS label, count(*) AS count FROM ({TIMES_SQL}) GROUP BY 1')
def class_distribution(spark, sf_dir):
    return dataset.class_distribution(dataset.labelled(times(spark, sf_dir), 100.0))


@query(f"WITH k AS ({_KNEE}) SELECT n - idx AS n_positive, 2 * (n - idx) AS n_drawn FROM k")
def balanced_counts(spark, sf_dir):
    ranked = dataset.sorted_by_time(times(spark, sf_dir))
    k = dataset.knee(ranked).first()
    drawn = dataset.balanced_sample(ranked, k["idx"], k["n"])
    return drawn.agg(F.sum((F.col("rank") >= k["idx"]).cast("long")).alias("n_positive"), F.sum((F.col("rank") < k["idx"]).cast("long")).alias("n_drawn"))


@query(f'SELECT count(*) AS n, min("procTime") AS min_time, max("procTime") AS max_time FROM ({TIMES_SQL})')
def time_statistics(spark, sf_dir):
    return dataset.time_statistics(times(spark, sf_dir))


def _features(spark, sf_dir):
    return _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.array(F.col("value") - 100, F.col("user_id").cast("double"), F.lit(7.0), F.lit(0.0)).alias("features"))


_FEATURES = "SELECT event_id AS id, [value - 100, CAST(user_id AS DOUBLE), 7.0, 0.0] AS f FROM events"
_RANGES = f"SELECT pos - 1 AS pos, least(min(v), 0.0) AS low, greatest(max(v), 0.0) AS high FROM (SELECT unnest(f) AS v, unnest([1, 2, 3, 4]) AS pos FROM ({_FEATURES})) GROUP BY pos"


@query(_RANGES)
def feature_minmax(spark, sf_dir):
    return dataset.feature_ranges(_features(spark, sf_dir))


@query(f"""SELECT id, pos, round(CASE WHEN high = low THEN v ELSE (v - low) / (high - low) END, 9) AS v FROM (SELECT id, unnest(f) AS v, unnest([0, 1, 2, 3]) AS pos FROM ({_FEATURES})) JOIN ({_RANGES}) r USING (pos)""")
def feature_norm(spark, sf_dir):
    rows = _features(spark, sf_dir)
    out = dataset.normalised(rows, dataset.ranges_list(dataset.feature_ranges(rows)))
    return rounded(out.select("id", F.posexplode("features").alias("pos", "v")), 9, "v")


_F = "CASE WHEN hits > 0 THEN 2 * (hits / retrieved) * (hits / relevant) / (hits / retrieved + hits / relevant) ELSE 0.0 END"
_MEASURES = f"hits, retrieved, relevant, round(CASE WHEN retrieved = 0 THEN 'nan'::DOUBLE ELSE hits / retrieved END, 9) AS precision, round(CASE WHEN relevant = 0 THEN 'nan'::DOUBLE ELSE hits / relevant END, 9) AS recall, round({_F}, 9) AS f_beta"


@query(f'SELECT {_MEASURES} FROM (SELECT count(*) FILTER ("procTime" >= 100 AND score > 0.6) AS hits, count(*) FILTER (score > 0.6) AS retrieved, count(*) FILTER ("procTime" >= 100) AS relevant FROM ({TIMES_SQL}))')
def precision_recall(spark, sf_dir):
    return rounded(evaluation.precision_recall(times(spark, sf_dir), F.col("procTime") >= 100, F.col("score") > 0.6), 9, "precision", "recall", "f_beta")


_THRESHOLDS = "(VALUES " + ", ".join(f"({t!r}::DOUBLE)" for t in evaluation.THRESHOLDS) + ") AS t(threshold)"


@query(f'SELECT round(threshold, 9) AS threshold, {_MEASURES} FROM (SELECT threshold, count(*) FILTER ("procTime" >= 100 AND score > threshold) AS hits, count(*) FILTER (score > threshold) AS retrieved, count(*) FILTER ("procTime" >= 100) AS relevant FROM ({TIMES_SQL}), {_THRESHOLDS} GROUP BY threshold)')
def threshold_sweep(spark, sf_dir):
    return rounded(evaluation.threshold_sweep(times(spark, sf_dir), "score", F.col("procTime") >= 100), 9, "threshold", "precision", "recall", "f_beta")


@query(f"""SELECT key, round(avg(score), 6) AS ml_output, count(*) AS num_repeat, round(min(threshold), 9) AS threshold, CASE WHEN count(DISTINCT type) > 1 THEN '*' ELSE min(type) END AS type, round(abs(avg(score) - min(threshold)), 6) AS error_size FROM
 (SELECT *, CASE WHEN "procTime" >= 100 AND score < threshold THEN 'FN' WHEN "procTime" < 100 AND score >= threshold THEN 'FP' ELSE '' END AS type FROM ({TIMES_SQL}), {_THRESHOLDS} WHERE (score > threshold) != ("procTime" >= 100)) GROUP BY key""")
def misclassified(spark, sf_dir):
    out = evaluation.misclassified(times(spark, sf_dir), "key", "score", "procTime", 100.0, 100.0)
    return rounded(rounded(out, 6, "ml_output", "error_size"), 9, "threshold")


_VOTES = "SELECT id, score, CAST(score > 0.4 AS INT) + CAST(score > 0.6 AS INT) + CAST(score > 0.8 AS INT) AS n FROM (" + TIMES_SQL + ")"


def _voted(spark, sf_dir):
    one = lambda t: voting.vote(f"m{t}", F.array(1 - F.col("score"), F.col("score")), F.col("score") > t)
    return times(spark, sf_dir).withColumn("votes", F.array(one(0.4), one(0.6), one(0.8)))


@query(f'SELECT id, n > floor(3 / 2) AS "isSlowQuery", n AS votes_for, 3 - n AS votes_against, round(1 - score, 6) AS avg_certainty FROM ({_VOTES})')
def ensemble_vote(spark, sf_dir):
    v = F.col("votes")
    return rounded(_voted(spark, sf_dir).select("id", voting.is_slow(v).alias("isSlowQuery"), voting.votes_for(v).alias("votes_for"), voting.votes_against(v).alias("votes_against"), voting.certainty(v).alias("avg_certainty")), 6, "avg_certainty")


@query(f"""SELECT id, CAST(1 AS INT) AS votes_for, CAST(0 AS INT) AS votes_against, 0.0 AS avg_certainty, corpus, CAST(0 AS INT) AS num_errors FROM ({LOG_SQL}) WHERE corpus IN ('click', 'view', 'purchase', 'signup', 'error')
 UNION ALL SELECT id, 0, 0, 'nan'::DOUBLE, corpus, 1 FROM ({LOG_SQL}) WHERE corpus NOT IN ('click', 'view', 'purchase', 'signup', 'error')""")
def vote_report(spark, sf_dir):
    requests = log(spark, sf_dir).select("id", columns.strip_prefix("query").alias("q"), "corpus", F.lit(None).cast("long").alias("corpusSize"), F.lit(None).cast("string").alias("lang"))
    answers = serving.evaluate_queries(requests, [("ym", AlwaysSlow())], corpora(spark))
    v = F.col("votes")
    return answers.select("id", voting.votes_for(v).alias("votes_for"), voting.votes_against(v).alias("votes_against"), voting.certainty(v).alias("avg_certainty"), "corpus", (F.col("status") != 200).cast("int").alias("num_errors"))


_STATUS = "CASE WHEN known THEN 200 ELSE 404 END"


@query(f"""SELECT l.id, CASE WHEN c.corpus IS NULL THEN 404 WHEN l.id % 5 = 0 THEN 400 ELSE 200 END AS status, c.size AS size, coalesce(c."altCorpus", '') AS "altCorpus" FROM ({LOG_SQL}) l LEFT JOIN ({CORPORA_SQL}) c ON l.corpus = c.corpus""")
def corpus_resolution(spark, sf_dir):
    requests = log(spark, sf_dir).select("id", "corpus", F.when(F.col("id") % 5 == 0, 10).cast("long").alias("corpusSize"), F.lit("en").alias("lang"))
    return serving.resolve(requests, corpora(spark)).select("id", "status", "size", "altCorpus")


_LETTER_ROWS = "(VALUES " + ", ".join(f"('{la}', {_quote(c)}, {v!r}::DOUBLE)" for la, t in TABLES.items() for c, v in sorted(t.items())) + ") AS p(lang, ch, v)"


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 'cs' ELSE lang END AS lang, text FROM documents WHERE length(text) > 0),
 c AS (SELECT doc_id, lang, ch, count(*) AS n FROM (SELECT doc_id, lang, unnest(string_split(text, '')) AS ch FROM d) GROUP BY ALL)
 SELECT doc_id, round(sum(n * coalesce(p.v, CASE lang WHEN 'cs' THEN 0.1 / 41 WHEN 'en' THEN 0.1 / 26 WHEN 'de' THEN 0.1 / 30 ELSE {FALLBACK!r} END)) / sum(n), 6) AS mean_value FROM c LEFT JOIN {_LETTER_ROWS} USING (lang, ch) GROUP BY doc_id""")
def char_prob(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.char_length("text") > 0).withColumn("lang", F.when(F.col("lang") == "es", "cs").otherwise(F.col("lang")))
    return docs.select("doc_id", F.round(columns.mean_character_value("text", "lang"), 6).alias("mean_value"))


_TEMPLATE = """SELECT event_id AS id, event_type AS w, 1000000000.0 AS size FROM events"""


@query(f"""WITH t AS ({_TEMPLATE}), l AS (SELECT id, sum(coalesce(p.v, 0.1 / 26)) / count(*) AS chance FROM (SELECT id, unnest(string_split(w, '')) AS ch FROM t) LEFT JOIN (SELECT * FROM {_LETTER_ROWS} WHERE lang = 'en') p USING (ch) GROUP BY id)
 SELECT id, 20.0 AS wildcards, CAST(length(w) AS DOUBLE) AS chars, round(chance, 9) AS chance, round(ln(ln(1000000000.0)), 9) AS size, 1.0 AS bias FROM t JOIN l USING (id)""")
def cql_template_features(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.concat(F.lit('[word="'), "event_type", F.lit('.*"]')).alias("cql"), F.lit("en").alias("lang"), F.lit(1_000_000_000).alias("corpusSize"), F.lit(0).alias("subcorpusSize"), F.col("value").alias("timeProc"))
    out = featurizing.evaluate(rows).withColumn("f", columns.feature_vector())
    return rounded(out.select("id", F.col("f")[1].alias("wildcards"), F.col("f")[4].alias("chars"), F.col("f")[5].alias("chance"), F.col("f")[46].alias("size"), F.col("f")[49].alias("bias")), 9, "chance", "size")


@query("SELECT * FROM (VALUES " + ", ".join(f"({_quote(q)}, {v})" for v, qs in (("true", ACCEPT), ("false", REJECT)) for q in qs) + ") AS t(q, valid)")
def cql_accept(spark, sf_dir):
    rows = spark.createDataFrame([(q,) for q in ACCEPT + REJECT], "q string")
    return rows.select("q", (cql.cql_validate("q") == "valid").alias("valid"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({_quote(q)}, {i}, {_quote(s)}, {_quote(n)}, {_quote(v)})" for q, ps in PROPS for i, (s, n, v) in enumerate(ps)) + ") AS t(q, place, structure, name, value)")
def cql_props(spark, sf_dir):
    rows = spark.createDataFrame([(q,) for q, _ in PROPS], "q string")
    return rows.select("q", F.posexplode(cql.cql_props("q")).alias("place", "p")).select("q", "place", "p.*")


@query("SELECT q, place, round(value, 9) AS value FROM (VALUES " + ", ".join(f"({_quote(q)}, {i}, {(v | {46: 3.031257022584175, 49: 1.0}).get(i, 0.0)!r}::DOUBLE)" for q, v in VECTORS for i in range(50)) + ") AS t(q, place, value)")
def cql_vectors(spark, sf_dir):
    rows = spark.createDataFrame([(q, "en", 1_000_000_000, 0) for q, _ in VECTORS], "q string, lang string, size long, sub long")
    return rounded(rows.select("q", F.posexplode(cql.cql_features("q", "lang", "size", "sub")).alias("place", "value")), 9, "value")


@query("SELECT id, round(20.0 * 0.5 + length(w) * 0.25 + 2.0 * ln(ln(1000000000.0)) + 3.0 * ln(ln(5000.0)) - 4.0, 6) AS cost FROM (" + _TEMPLATE + ")")
def linear_cost(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.concat(F.lit('[word="'), "event_type", F.lit('.*"]')).alias("cql"), F.lit("en").alias("lang"), F.lit(1_000_000_000).alias("corpusSize"), F.lit(5000).alias("subcorpusSize"), F.col("value").alias("timeProc"))
    params = [0.0] * 50
    params[1], params[4], params[46], params[47], params[48], params[49] = 0.5, 0.25, 2.0, 3.0, 9.0, -4.0
    out = featurizing.evaluate(rows).withColumn("f", columns.feature_vector())
    return rounded(out.select("id", columns.linear_cost("f", F.array(*map(F.lit, params))).alias("cost")), 6, "cost")


@query("SELECT n, CASE WHEN n < 100000 THEN '~0' WHEN n >= 1000000000 THEN printf('%.1fG', n / 1e9) ELSE printf('%.1fM', n / 1e6) END AS shown FROM (VALUES " + ", ".join(f"({n}::BIGINT)" for n in SIZES) + ") AS t(n)")
def rough_size(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in SIZES], "n long").select("n", columns.rough_size("n").alias("shown"))


@query("SELECT doc_id, CAST(20 * ((length(text) - length(replace(text, '.*', ''))) // 2 + (length(text) - length(replace(text, '.+', ''))) // 2) AS DOUBLE) AS score FROM documents")
def wildcard_score(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", columns.wildcard_score("text").alias("score"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{o}', {s}::DOUBLE)" for o, s in zip(OPTIONS, (100, 100, 0, 100, 100, 5), strict=True)) + ") AS t(o, score)")
def rep_score(spark, sf_dir):
    return spark.createDataFrame([(o,) for o in OPTIONS], "o string").select("o", columns.repetition_score("o").alias("score"))


@query(f"SELECT corpus, size FROM ({CORPORA_SQL}) WHERE size > 100000000")
def large_corpora(spark, sf_dir):
    return dataset.large_corpora(corpora(spark)).select("corpus", "size")


@query(f"SELECT id, row_number() OVER (PARTITION BY 1 ORDER BY key, id) - 1 AS rank FROM ({TIMES_SQL})")
def global_rank(spark, sf_dir):
    return ranking.with_rank(times(spark, sf_dir), ["key", "id"]).select("id", "rank")


@query(None)
def featurize_log(spark, sf_dir):
    rows, _ = featurizing.featurize(log(spark, sf_dir), corpora(spark))
    return rows.select("uniq_key", "procTime", "q", "corpusSize", "features")


@query(None)
def serve_log(spark, sf_dir):
    params = [0.0] * 50
    params[1], params[49] = 0.1, -1.0
    requests = log(spark, sf_dir).select("id", columns.strip_prefix("query").alias("q"), "corpus", F.lit(None).cast("long").alias("corpusSize"), F.lit(None).cast("string").alias("lang"))
    return serving.response(serving.evaluate_queries(requests, [("linear", LinearScore(params)), ("ym", AlwaysSlow())], corpora(spark))).select("id", "status", "isSlowQuery", "response")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log featurized, ranked and labelled at its knee."""
    rows, _ = featurizing.featurize(log(spark, sf_dir), corpora(spark))
    ranked = dataset.sorted_by_time(rows, tie="uniq_key")
    knee_at = dataset.knee(ranked).select("threshold")
    return ranked.join(knee_at).withColumn("label", (F.col("procTime") >= F.col("threshold")).cast("int")).select("uniq_key", "procTime", "rank", "label", "features")
