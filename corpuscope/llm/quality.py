"""Quality rules: a decision list learned by sequential covering, in DataFrame functions only.

Statistics of each text are computed in its row. From labelled statistics, rules "these thresholds
together mean junk" are learned one after another: a rule grows by the threshold that best raises
its precision, drops the conditions that a held-back part of the rows does not support, and is
kept if it stays precise; the rows it covers are taken away and the next one is learned. The
result is an ordered list, emitted as one Spark conditional expression.

Learning works on counts of rows by feature and threshold, which Spark sums; the driver sees only
these tables of a fixed size.

Defined results: null and empty texts have no word and all counts 0, and so fail the base rule.
Repeated rows give a row each. Without labels, or with labels of one kind, the list is empty and
keeps everything. Documents labelled more than once count once for each label. Extra columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import materialize, picked

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: Shares that the rules use; each needs n_words > 0.
FEATURES = {
    "symbol_share": "n_symbols / word_chars",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "mean_word": "word_chars / n_words",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "mark_share": "n_marks / word_chars",
    "log_words": "ln(n_words)",
}
#: Labelled rows learned from, at most; thresholds for each feature; rules; conditions of a rule; precision and share of junk a rule must reach.
MAX_TRAIN, CUTS, MAX_RULES, MAX_CONDITIONS, LEAST_PRECISION, LEAST_COVER = 20_000, 24, 8, 3, 0.97, 0.01


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: windows with an equal neighbour in sorted order, then the union of their spans."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def union(marked):
        ordered = F.array_sort(F.transform(marked, lambda p: p["i"]))
        return _let(ordered, lambda at: F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"]))

    def marked(s):
        same = lambda p, j: F.coalesce(F.get(s, j)["h"] == p["h"], F.lit(False))
        return F.filter(s, lambda p, j: same(p, j - 1) | same(p, j + 1))

    return _let(pairs, lambda s: union(marked(s)))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and further counts that rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("words")
    window = lambda own: F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(own, i + j) for j in range(WINDOW)]))
    hashes = F.when(n >= WINDOW, _let(F.transform("words", lambda w: F.xxhash64(w)), window)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("doc_id", "text", words.alias("words"), lines.alias("lines")).withColumn("hashes", hashes)
    repeat = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), _covered(F.col("hashes"))).otherwise(0)
    count = lambda chars: F.regexp_count("text", F.lit(chars))
    long = lambda c, name: c.cast("long").alias(name)
    return rows.select(
        "doc_id",
        long(n, "n_words"),
        long(F.char_length(F.array_join("words", "")), "word_chars"),
        long(count(SYMBOLS), "n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        long(repeat, "n_repeat_words"),
        long(F.size("lines"), "n_lines"),
        long(count("[A-ZÄÖÜÀÂÇÉÈÊËÎÏÔÙÛÁÍÓÚÑ]"), "n_upper"),
        long(count("[0-9]"), "n_digits"),
        long(count(r"[!?;:=_@/\\{}\[\]()~^]"), "n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.cut if self.above else value <= self.cut

    def __str__(self):
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.cut!r}"


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _counts(rows: DataFrame, grid: dict[str, list[float]]) -> dict:
    """For each condition of the grid: covered junk and good labels. One aggregation: rows are counted by feature and interval, then summed up."""
    bins = []
    for f, cuts in grid.items():
        place = F.lit(0)
        for cut in cuts:
            place = place + (F.expr(FEATURES[f]) > cut).cast("int")
        bins.append(F.struct(F.lit(f).alias("feature"), place.alias("bin")))
    table = rows.select("junk", "n", F.explode(F.array(*bins)).alias("b")).groupBy("b.feature", "b.bin").agg(F.sum("junk").alias("bad"), F.sum("n").alias("n")).collect()
    out = {}
    for f, cuts in grid.items():
        own = {r["bin"]: (r["bad"], r["n"] - r["bad"]) for r in table if r["feature"] == f}
        for i, cut in enumerate(cuts):
            for above in (True, False):
                held = [v for b, v in own.items() if (b > i) == above]
                out[Condition(f, above, cut)] = (sum(v[0] for v in held), sum(v[1] for v in held))
    return out


def _value(junk: int, good: int) -> float:
    return (junk + 1) / (junk + good + 2)


def learn(stats: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> list[tuple[Condition, ...]]:
    """The ordered rules for junk. labels: doc_id, quality (0: junk). Learned from at most about max_train rows that pass the base rule, picked by the hash of doc_id."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", (F.col("quality") == 0).cast("int").alias("junk"))
    known = picked(known, ["doc_id"], max_train).groupBy("doc_id").agg(F.sum("junk").alias("junk"), F.count("*").alias("n"))
    usable = stats.where("n_words > 0 AND n_lines > 0").where(~base_failed())
    rows = usable.join(known, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)))
    rows = materialize(rows, "quality-labelled")
    grid = {}
    shares = [(i + 0.5) / CUTS for i in range(CUTS)]
    found = rows.agg(*[F.percentile(F.expr(e), shares, F.col("n")).alias(f) for f, e in FEATURES.items()]).first()
    for f in FEATURES:
        grid[f] = sorted(set(found[f] or []))
    total = rows.agg(F.sum("junk")).first()[0] or 0
    rules: list[tuple[Condition, ...]] = []
    left = rows
    while total and len(rules) < MAX_RULES:
        grow, check = left.where("part > 0"), left.where("part = 0")
        rule: list[Condition] = []
        best = (0, 1)
        while len(rule) < MAX_CONDITIONS:
            found = _counts(grow.where(_all(rule)), grid)
            enough = {c: v for c, v in found.items() if v[0] >= max(3, LEAST_COVER * total)}
            if not enough:
                break
            c = max(enough, key=lambda c: (_value(*enough[c]), enough[c][0], str(c)))
            if rule and _value(*enough[c]) <= _value(*best):
                break
            rule.append(c)
            best = enough[c]
            if best[1] == 0:
                break
        if not rule:
            break
        held = check.agg(*[F.struct(F.sum(F.when(_all(rule[:k]), F.col("junk")).otherwise(0)).alias("bad"), F.sum(F.when(_all(rule[:k]), F.col("n") - F.col("junk")).otherwise(0)).alias("good")).alias(f"k{k}") for k in range(1, len(rule) + 1)]).first()
        worth = {k: (held[f"k{k}"]["bad"] or 0, held[f"k{k}"]["good"] or 0) for k in range(1, len(rule) + 1)}
        k = max(worth, key=lambda k: (_value(*worth[k]), -k))
        bad, good = worth[k]
        if bad + good == 0 or bad / (bad + good) < LEAST_PRECISION:
            break
        rules.append(_centred(left, rule[:k]))
        left = rows.where(~covered_by(rules))
    return rules


def _centred(rows: DataFrame, rule: list[Condition]) -> tuple[Condition, ...]:
    """The rule with each threshold moved half-way to the values of nearly all junk it covers, so that it doesn't touch the clean side."""
    shares = [F.percentile(F.expr(FEATURES[c.feature]), 0.05 if c.above else 0.95, F.col("junk")).alias(f"c{i}") for i, c in enumerate(rule)]
    edge = rows.where(_all(rule) & (F.col("junk") > 0)).agg(*shares).first()
    return tuple(Condition(c.feature, c.above, (c.cut + edge[i]) / 2 if edge[i] is not None else c.cut) for i, c in enumerate(rule))


def covered_by(rules) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | F.coalesce(_all(rule), F.lit(False))
    return out


def verdict(rules) -> Column:
    """The list as one expression: false at the first rule that holds, else true."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        out = out.when(_all(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of docs with base_failed and kept: a row for each row of docs."""
    stats = materialize(statistics(docs), "quality-statistics")
    rules = learn(stats, labels)
    failed = base_failed()
    return stats.withColumn("base_failed", failed).withColumn("kept", F.when(failed, F.lit(False)).otherwise(verdict(rules)))
