"""Commands: python -m corpuscope <verb>."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

VERSION = "0.1.0"


def _session() -> SparkSession:
    return SparkSession.builder.appName("corpuscope").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpuscope", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    verbs.add_parser("version", help="show the version")
    one = verbs.add_parser("featurize", help="turn a query log into feature rows")
    one.add_argument("config"), one.add_argument("log"), one.add_argument("out"), one.add_argument("--debug", action="store_true")
    one = verbs.add_parser("remove-zero", help="write the log's rows that have a time, and count the others by corpus")
    one.add_argument("config"), one.add_argument("log"), one.add_argument("out"), one.add_argument("--server")
    one = verbs.add_parser("learn", help="train a model on feature rows and report on it")
    one.add_argument("features"), one.add_argument("out"), one.add_argument("--num-trees", type=int, default=100), one.add_argument("--model", default="rf", choices=["rf", "nn", "xg"]), one.add_argument("--vote-threshold", type=float, default=0.5), one.add_argument("--misclassed-query-log")
    one = verbs.add_parser("evaluate", help="report on a saved model")
    one.add_argument("features"), one.add_argument("model"), one.add_argument("out"), one.add_argument("--misclassed-query-log")
    one = verbs.add_parser("benchmark-missing", help="measure queries without a time by asking a server")
    one.add_argument("config"), one.add_argument("log"), one.add_argument("server"), one.add_argument("out"), one.add_argument("--corpora", default=""), one.add_argument("--batch-size", type=int, default=0), one.add_argument("--batch-offset", type=int, default=0)
    one = verbs.add_parser("repl", help="ask a model about queries one by one")
    one.add_argument("config"), one.add_argument("model")
    one = verbs.add_parser("serve", help="answer requests (JSONL) by the ensemble of the settings")
    one.add_argument("config"), one.add_argument("requests"), one.add_argument("out")
    return top


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.verb == "version":
        print(VERSION)
        return 0
    spark = _session()
    from corpuscope import models
    from corpuscope.functions.columns import show_evaluation
    from corpuscope.operators import normalize
    from corpuscope.plans import featurize, learning
    from corpuscope.sources import logs

    config = logs.Config.load(args.config) if hasattr(args, "config") else None
    if args.verb == "featurize":
        rows, stats = featurize.featurize(logs.read_query_log(spark, args.log), config.corpora_frame(spark), config.synthetic_time_correction)
        if args.debug:
            rows.select(show_evaluation().alias("evaluation")).show(1000, truncate=False)
        logs.write_features(rows, stats, args.out)
    elif args.verb == "remove-zero":
        log = logs.read_query_log(spark, args.log)
        logs.write_json_lines(normalize.remove_zero(log), args.out)
        installed = logs.read_installed(spark, _corpora_of(args.server)) if args.server else None
        normalize.zero_by_corpus(log, installed).show(1000, truncate=False)
    elif args.verb in ("learn", "evaluate"):
        rows, _ = logs.read_features(spark, args.features)
        if args.verb == "learn":
            how = {"trees": args.num_trees} if args.model == "rf" else {}
            result = learning.train(rows, models.create(args.model, args.vote_threshold, **how), path=f"{args.out}/model")
        else:
            result = learning.evaluate(rows, models.load(spark, args.model))
        if result.sweep is not None:
            logs.write_sweep(result.sweep, f"{args.out}/sweep")
        if args.misclassed_query_log and result.misclassified is not None:
            logs.write_misclassified(result.misclassified, args.misclassed_query_log)
    elif args.verb == "benchmark-missing":
        rows = normalize.missing(logs.read_query_log(spark, args.log), [c for c in args.corpora.split(",") if c])
        batch = normalize.batch(rows, args.batch_offset, args.batch_size)
        logs.write_json_lines(normalize.measure(batch, config.corpora_frame(spark), normalize.http_client(args.server)), args.out)
    elif args.verb == "serve":
        from corpuscope.plans import serving
        from corpuscope.streaming.monitoring import REQUESTS

        ensemble = models.load_ensemble(spark, config.models)
        requests = spark.read.schema(REQUESTS).json(args.requests)
        serving.response(serving.evaluate_queries(requests, ensemble, config.corpora_frame(spark))).select("q", "corpus", "status", "response").write.json(args.out)
    elif args.verb == "repl":
        return repl(spark, models.load(spark, args.model), sys.stdin)
    return 0


def _corpora_of(server: str):
    def fetch() -> list[str]:
        import json
        from urllib.request import urlopen

        with urlopen(f"{server.rstrip('/')}/corplist", timeout=60) as answer:
            held = json.load(answer)
        return [c if isinstance(c, str) else c.get("id") or c.get("corpname") for c in (held.get("corpora", held) if isinstance(held, dict) else held)]

    return fetch


def _features(found: dict) -> str:
    """The features of a query's positions and of the whole query, in one line."""
    positions = [f"[{p['index']}] wildcards={p['regexp']['wildcardScore']:.2f}, range={p['regexp']['hasRange']}, smallCard={p['hasSmallCardAttr']}, concreteChars={p['regexp']['numConcreteChars']:.2f}, alternatives={p['numAlternatives']}" for p in found["positions"]]
    whole = f"glob={found['numGlobConditions']}, meet={found['containsMeet']}, union={found['containsUnion']}, within={found['containsWithin']}, containing={found['containsContaining']}"
    return "; ".join([*positions, whole])


def repl(spark: SparkSession, model, lines) -> int:
    """Queries and `set corpussize|vote|lang <value>`, `setup`, `exit`, line by line."""
    from corpuscope import schemas
    from corpuscope.cql.batch import evaluated
    from corpuscope.plans.serving import evaluate_queries

    size, lang = 6_400_000_000, "cs"
    model.threshold = 0.85
    for line in map(str.strip, lines):
        words = line.split()
        if not words:
            continue
        if line == "exit":
            break
        if line == "setup":
            print(f"corpussize: {size}, vote: {model.threshold}, lang: {lang}")
        elif words[0] == "set" and len(words) == 3 and words[1] in ("corpussize", "vote", "lang"):
            if words[1] == "corpussize":
                size = int(float(words[2]))
            elif words[1] == "vote":
                model.threshold = float(words[2])
            else:
                lang = words[2]
        else:
            request = spark.createDataFrame([(line, None, size, lang)], "q string, corpus string, corpusSize long, lang string")
            answer = evaluate_queries(request, [(model.kind, model)], spark.createDataFrame([], schemas.CORPORA)).first()
            print(answer["error"] or ("slow" if answer["isSlowQuery"] else "fast") + f" {[round(v, 2) for v in answer['votes'][0]['votes']]}; " + _features(evaluated(line, lang)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
