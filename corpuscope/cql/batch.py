"""The parser over batches of queries, as workers run it. Nothing here needs a session."""

from __future__ import annotations

import functools
import json

import pandas as pd

from corpuscope.cql import analysis, letters, syntax

_NONE = dict.fromkeys(("positions", "numGlobConditions", "containsMeet", "containsUnion", "containsWithin", "adhocSubcorpus", "containsContaining", "alignedPart"))


@functools.lru_cache(20_000)
def evaluated(query: str, lang: str | None) -> dict:
    try:
        return {"error": None, **analysis.evaluate(syntax.parse(query), *letters.provider(lang))}
    except syntax.SyntaxFault as e:
        return {"error": str(e), **_NONE}


def tree(query: str | None) -> syntax.Node | None:
    try:
        return syntax.parse(query or "")
    except syntax.SyntaxFault:
        return None


def parse(query: pd.Series, lang: pd.Series) -> pd.DataFrame:
    rows = [evaluated(q or "", la) for q, la in zip(query, lang, strict=True)]
    return pd.DataFrame({k: pd.Series([r[k] for r in rows], dtype=object) for k in ("error", *_NONE)})


def validate(query: pd.Series) -> pd.Series:
    def one(q):
        try:
            syntax.parse(q or "")
        except syntax.SyntaxFault as e:
            return f"invalid: {e}"
        return "valid"

    return pd.Series([one(q) for q in query], dtype=object)


def _listed(query: pd.Series, read, keys: tuple[str, ...]) -> pd.Series:
    return pd.Series([None if (t := tree(q)) is None else [dict(zip(keys, x, strict=True)) for x in read(t)] for q in query], dtype=object)


def props(query: pd.Series) -> pd.Series:
    return _listed(query, analysis.properties, ("structure", "name", "value"))


def node_array(query: pd.Series) -> pd.Series:
    return _listed(query, analysis.nodes, ("id", "parent_id", "depth", "rule", "text"))


def as_json(query: pd.Series) -> pd.Series:
    return pd.Series([None if (t := tree(q)) is None else json.dumps(t.to_dict(), ensure_ascii=False) for q in query], dtype=object)


class NodeTable:
    """The table function: a row for each node."""

    def eval(self, query: str):
        found = tree(query)
        if found is not None:
            yield from analysis.nodes(found)
