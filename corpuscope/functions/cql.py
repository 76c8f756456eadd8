"""SQL functions over CQL queries. The parser runs in Arrow batches; each worker remembers recent queries."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.cql import batch
from corpuscope.schemas import NODES, PARSED, PROPERTIES

_KINDS = {"cql_parse": (batch.parse, PARSED), "cql_validate": (batch.validate, "string"), "cql_props": (batch.props, PROPERTIES), "cql_node_array": (batch.node_array, NODES), "cql_json": (batch.as_json, "string")}


@functools.cache
def _udf(name: str):
    function, kind = _KINDS[name]
    # conditions, as explode has one, stay above what isn't deterministic: below the distinct keys of once they would parse each row
    return F.pandas_udf(function, kind).asNondeterministic()


def cql_parse(query: Column | str, lang: Column | str) -> Column:
    """The features of a query with its language's letters, or the error."""
    return _udf("cql_parse")(query, lang)


def cql_validate(query: Column | str) -> Column:
    """`valid`, or `invalid: ` and why."""
    return _udf("cql_validate")(query)


def cql_props(query: Column | str) -> Column:
    """Properties of a query; null if it can't be parsed."""
    return _udf("cql_props")(query)


def cql_node_array(query: Column | str) -> Column:
    """The nodes of a query's tree, parents first; null if it can't be parsed."""
    return _udf("cql_node_array")(query)


def cql_json(query: Column | str) -> Column:
    """The tree as JSON; null if the query can't be parsed."""
    return _udf("cql_json")(query)


def cql_nodes():
    """The table function (node_id, parent_id, depth, rule, text) of a query."""
    return F.udtf(batch.NodeTable, returnType="node_id int, parent_id int, depth int, rule string, text string")


def cql_features(query: Column | str, lang: Column | str, corpus_size: Column | str, subcorpus_size: Column | str) -> Column:
    """The 50 features of a query on a corpus, from columns; null if it can't be parsed."""
    from corpuscope.functions.columns import log_scaled

    parsed = cql_parse(query, lang)
    rows = F.transform(F.array(F.struct(parsed.alias("p"), log_scaled(corpus_size).alias("corpusSize"), log_scaled(subcorpus_size).alias("namedSubcorpusSize"))), _vector)
    return F.element_at(rows, 1)


def once(rows: DataFrame, key: dict[str, Column | str], **found: Column) -> DataFrame:
    """rows with further columns that the parser finds from the key's columns, by their names in key. Each distinct key meets the
    parser once, however often it occurs; in a stream each row does."""
    held = rows.withColumns({k: F.col(c) if isinstance(c, str) else c for k, c in key.items()})
    if rows.isStreaming:
        return held.withColumns(found).drop(*key)
    of = {k: f"{k}of" for k in key}
    parsed = held.select(*key).distinct().withColumns(found).withColumnsRenamed(of)
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(o)) for k, o in of.items()])
    return held.join(parsed, same).drop(*key, *of.values())


def _vector(row: Column) -> Column:
    from corpuscope.functions.columns import log_scaled

    p = row["p"]
    out = []
    for i in range(4):
        at = F.get(p["positions"], F.lit(i))
        r = at["regexp"]
        own = (r["startsWithWildCard"], r["wildcardScore"], r["hasRange"], at["hasSmallCardAttr"], r["numConcreteChars"], r["avgCharProb"], at["numAlternatives"], at["posRepetition"], r["charClasses"], at["hasNegation"])
        out += [F.coalesce(c.cast("double"), F.lit(0.0)) for c in own]
    out += [p[k].cast("double") for k in ("numGlobConditions", "containsMeet", "containsUnion", "containsWithin", "adhocSubcorpus", "containsContaining")]
    out += [log_scaled(row["corpusSize"]), log_scaled(row["namedSubcorpusSize"]), p["alignedPart"].cast("double"), F.lit(1.0)]
    return F.when(p["error"].isNull(), F.array(*out))


def register(spark: SparkSession) -> None:
    """Makes the functions available to SQL by their names."""
    for name in _KINDS:
        spark.udf.register(name, _udf(name))
    spark.udtf.register("cql_nodes", cql_nodes())
