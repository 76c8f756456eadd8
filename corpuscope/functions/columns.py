"""Functions of columns that Catalyst runs itself."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.cql.letters import FALLBACK, TABLES
from corpuscope.schemas import N_FEATURES

Name = str | Column


def _c(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_prefix(query: Name) -> Column:
    """The query of a log entry `q<query>` or `a<attribute>,<query>`; entries without either form are taken as they are."""
    q = _c(query)
    return F.when(q.startswith("q"), F.substr(q, F.lit(2))).when(F.instr(q, ",") > 0, F.regexp_replace(q, r"^[^,]*,", "")).otherwise(q)


def log_key(corpus_size: Name, subcorpus_size: Name, query: Name) -> Column:
    return F.concat_ws("/", _c(corpus_size).cast("string"), _c(subcorpus_size).cast("string"), _c(query))


def evaluation_key(q: Name, corpus_size: Name) -> Column:
    return F.format_string("%s-%.5f", _c(q), _c(corpus_size))


def log_scaled(value: Name) -> Column:
    """Natural logarithm of values from 1 on, else 0."""
    v = _c(value).cast("double")
    return F.when(v >= 1, F.ln(v)).otherwise(F.lit(0.0))


def character_value(character: Name, lang: Name) -> Column:
    """Probability (in percent) of a character by the language's table; a tenth of an even share if the table lacks it; 1/30 without a table."""
    out = F.when(F.lit(False), F.lit(0.0))
    for name, table in TABLES.items():
        pairs = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
        out = out.when(_c(lang) == name, F.coalesce(F.try_element_at(pairs, _c(character)), F.lit(0.1 / len(table))))
    return out.otherwise(F.lit(FALLBACK))


def mean_character_value(text: Name, lang: Name) -> Column:
    """Mean character value over a text; NaN for an empty one. Each letter of the table is counted by what the text loses without it, and its count weighed; all other characters have one value."""
    t = _c(text)
    size = F.char_length(t)
    total = F.when(F.lit(False), F.lit(0.0))
    for name, table in TABLES.items():
        other = 0.1 / len(table)
        known = functools.reduce(lambda a, b: a + b, [(size - F.char_length(F.replace(t, F.lit(c), F.lit("")))) * F.lit(v) for c, v in sorted(table.items())])
        total = total.when(_c(lang) == name, known + F.char_length(F.translate(t, "".join(table), "")) * F.lit(other))
    return F.when(size == 0, F.lit(float("nan"))).otherwise(total.otherwise(size * F.lit(FALLBACK)) / size)


def starts_with_wildcard(pattern: Name) -> Column:
    return _c(pattern).rlike(r"^\.[*+]")


def is_small_attribute(name: Name) -> Column:
    from corpuscope.cql.analysis import SMALL_ATTRIBUTES

    return F.lower(_c(name)).isin(*SMALL_ATTRIBUTES)


def wildcard_score(plain: Name, n_questions: Name | int = 0) -> Column:
    """20 for each `.*` and `.+` of a plain part of a regular expression, and 1 for each of its question marks."""
    n = F.lit(n_questions) if isinstance(n_questions, int) else _c(n_questions)
    return (20 * F.regexp_count(_c(plain), F.lit(r"\.\*")) + 20 * F.regexp_count(_c(plain), F.lit(r"\.\+")) + n).cast("double")


def repetition_score(option: Name) -> Column:
    """Score of `*`, `+`, `?`, `{n}`, `{n,}`, `{n,m}`: 100 without an upper bound and for {n}, else the bound; 0 for `?`."""
    o = _c(option)
    most = F.regexp_extract(o, r"^\{[0-9]+,([0-9]+)\}$", 1)
    return F.when(o.isin("*", "+") | o.rlike(r"^\{[0-9]+,?\}$"), F.lit(100.0)).when(most != "", most.cast("double")).otherwise(F.lit(0.0))


def feature_vector() -> Column:
    """The 50 features of an evaluation row: ten for each of the first four positions, then those of the whole query."""
    p = lambda i: F.get("positions", F.lit(i))
    out = []
    for i in range(4):
        r = p(i)["regexp"]
        own = (r["startsWithWildCard"], r["wildcardScore"], r["hasRange"], p(i)["hasSmallCardAttr"], r["numConcreteChars"], r["avgCharProb"], p(i)["numAlternatives"], p(i)["posRepetition"], r["charClasses"], p(i)["hasNegation"])
        out += [F.coalesce(c.cast("double"), F.lit(0.0)) for c in own]
    whole = ("numGlobConditions", "containsMeet", "containsUnion", "containsWithin", "adhocSubcorpus", "containsContaining")
    out += [F.col(c).cast("double") for c in whole]
    out += [log_scaled("corpusSize"), log_scaled("namedSubcorpusSize"), F.col("alignedPart").cast("double"), F.lit(1.0)]
    return F.array(*out)


def linear_cost(features: Name, params: Name) -> Column:
    """Cost by a linear model of 50 coefficients. The two sizes enter by their plain second logarithm, so a subcorpus size of 0 gives minus infinity (NaN with coefficient 0); the aligned part doesn't count."""
    f, w = _c(features), _c(params)
    product = F.zip_with(f, w, lambda a, b: a * b)
    known = F.aggregate(F.filter(product, lambda x, i: ~i.isin(46, 47, 48)), F.lit(0.0), lambda a, x: a + x)
    size = lambda name, i: w[i] * F.when(F.col(name) > 0, F.ln(F.col(name))).otherwise(F.lit(float("-inf")))
    return known + size("corpusSize", 46) + size("namedSubcorpusSize", 47)


def params_array(params: Name, names: list[str]) -> Column:
    """A struct of coefficients as an array, in the given order of its fields."""
    return F.array(*[_c(params)[n].cast("double") for n in names])


def params_struct(values: Name, names: list[str]) -> Column:
    return F.struct(*[_c(values)[i].alias(n) for i, n in enumerate(names)])


#: Names of the coefficients by place in the vector.
PARAM_NAMES = [f"{n}{i}" for i in range(4) for n in ("wildcardPrefix", "wildcards", "rangeOp", "smallCardAttr", "concreteChars", "avgCharProb", "numPosAlts", "posRepetition", "charClasses", "hasNegation")] + [
    "globCond", "meet", "union", "within", "adhocSubcorpus", "containing", "corpusSize", "namedSubcorpusSize", "alignedPart", "bias",
]
assert len(PARAM_NAMES) == N_FEATURES


def fast_or_slow(predicted_class: Name) -> Column:
    return F.when(_c(predicted_class) == 0, F.lit("fast")).otherwise(F.lit("slow"))


def rough_size(n: Name) -> Column:
    v = _c(n)
    return F.when(v < 100_000, F.lit("~0")).when(v >= 1_000_000_000, F.format_string("%.1fG", v / F.lit(1e9))).otherwise(F.format_string("%.1fM", v / F.lit(1e6)))


def simple_query(attributes: Name, value: Name, strict: bool = True) -> Column:
    """The query that looks for a value in any of several attributes. strict: as the first implementation writes it, without brackets, which the language doesn't accept."""
    joined = F.array_join(F.transform(_c(attributes), lambda a: F.concat(a, F.lit('="'), _c(value), F.lit('"'))), " | ")
    return joined if strict else F.concat(F.lit("["), joined, F.lit("]"))


def clean_version(version: Name) -> Column:
    return F.ltrim(F.trim(_c(version), F.lit("'")), F.lit("v"))


def short_error(message: Name) -> Column:
    return F.substring(_c(message), 1, 80)


def model_base_name(path: Name) -> Column:
    """The part of a feature file's name up to its version, on which models' names build."""
    return F.regexp_replace(_c(path), r"^(.+\.v\d+\.\d+).*$", "$1")


MODEL_SUFFIXES = {"rf": ".model.rf.json", "nn": ".model.nn.json", "xg": ".feats.xg.msgpack"}


def stats_comment(processed: Name, failed: Name, ratio: Name) -> Column:
    return F.format_string("numProcessed: %d, numFailed: %d, deduplicationRatio: %.2f", _c(processed), _c(failed), _c(ratio))


def property_kind(prop: Name) -> Column:
    """structure, structattr or posattr of a property; null for a bare regular expression."""
    p = _c(prop)
    has = lambda k: p[k] != ""
    return F.when(has("structure") & ~has("name") & ~has("value"), "structure").when(has("structure") & has("name"), "structattr").when(~has("structure") & has("name"), "posattr")


def show_evaluation() -> Column:
    """A readable text of an evaluation row."""
    position = lambda p: F.format_string(
        "position %d:\n    HasSmallCardAttr: %d\n    NumAlternatives: %d\n    PosRepetition: %.2f\n    HasNegation: %d\n        regexp:    \n            StartsWithWildCard: %d\n            NumConcreteChars: %.2f\n            AvgCharProb: %.2f\n            WildcardScore: %.2f\n            HasRange: %d\n            CharClasses: %.2f\n",
        p["index"], p["hasSmallCardAttr"], p["numAlternatives"], p["posRepetition"], p["hasNegation"], p["regexp"]["startsWithWildCard"], p["regexp"]["numConcreteChars"], p["regexp"]["avgCharProb"], p["regexp"]["wildcardScore"], p["regexp"]["hasRange"], p["regexp"]["charClasses"],
    )
    whole = F.format_string(
        "NumGlobConditions: %d\nContainsMeet: %d\nContainsUnion: %d\nContainsWithin: %d\nAdhocSubcorpus: %.2f\nContainsContaining: %d\nCorpusSize: %.2f\nNamedSubcorpusSize: %.2f\nAlignedPart: %d\n",
        "numGlobConditions", "containsMeet", "containsUnion", "containsWithin", "adhocSubcorpus", "containsContaining", "corpusSize", "namedSubcorpusSize", "alignedPart",
    )
    return F.concat(F.array_join(F.transform("positions", position), ""), whole)


def uppercase_ratio(text: Name) -> Column:
    """All characters divided by upper-case ones: infinite without any."""
    n = F.regexp_count(_c(text), F.lit(r"\p{Lu}"))
    return F.when(n == 0, F.lit(float("inf"))).otherwise(F.char_length(_c(text)) / n)
