"""Language identification by hierarchical discrimination.

A first linear support vector machine for each family tells the language family (one against the
rest); then, within the family, one-versus-one linear machines vote between its languages. All are
trained here, on hashed character bigrams and trigrams of a bounded sample of labelled documents.

Defined results: `und` with score 0 if text is null, empty or has no letter, or if nothing could be
learned. With one learned language every text with a letter gets it. Repeated rows each get the same
answer; extra columns are passed over.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import place_of, share_of, small_batches

#: Families by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("cs", "sk", "pl", "ru", "uk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
}
#: Width of the hashed feature vector; labelled documents learned from, at most; languages learned, at most (the most frequent ones).
DIMS = 4096
MAX_TRAIN, MAX_LANGS = 3000, 200
_CHUNK = 1 << 16


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


def features(text: str) -> np.ndarray:
    """Square roots of the counts of hashed character bigrams and trigrams, as a unit vector; over the whole text."""
    counts = np.zeros(DIMS)
    codes = np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), "<u2")
    for at in range(0, len(codes), _CHUNK):
        c = codes[max(0, at - 2) : at + _CHUNK].astype(np.uint32)
        pairs = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        triples = pairs[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
        counts += np.bincount((pairs[min(at, 1) :] >> np.uint32(20)).astype(np.intp), minlength=DIMS)
        counts += np.bincount((triples >> np.uint32(20)).astype(np.intp), minlength=DIMS)
    np.sqrt(counts, out=counts)
    norm = np.linalg.norm(counts)
    return counts / norm if norm else counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights and, last, the bias of a linear support vector machine (squared hinge loss), by accelerated gradient steps; y is -1 or 1, classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = v = np.zeros(x.shape[1] + 1)
    rate = 1.0 / (1.0 / c + 4.0)
    for t in range(steps):
        slope = weight * np.maximum(0.0, 1.0 - y * (x @ v[:-1].astype(x.dtype) + v[-1])) * y
        step = v - rate * (v / c - 2.0 * np.append(slope.astype(x.dtype) @ x, slope.sum()))
        v = step + t / (t + 3) * (step - w)
        w = step
    return w


class LanguageModel:
    """families: names; of: the languages of each; outer: weights by family (one row for two families); inner: weights by (family, a, b)."""

    def __init__(self, langs: list[str], x: np.ndarray, y: list[str]):
        y = np.array(y, dtype=object)
        kin = np.array([family_of(lang) for lang in y], dtype=object)
        self.families = sorted({family_of(lang) for lang in langs})
        self.of = {f: sorted(lang for lang in langs if family_of(lang) == f) for f in self.families}
        self.outer = np.array([fit_svm(x, np.where(kin == f, 1.0, -1.0)) for f in self.families]) if len(self.families) > 1 else None
        self.inner = {}
        for f, members in self.of.items():
            for a, b in itertools.combinations(members, 2):
                rows = (y == a) | (y == b)
                self.inner[f, a, b] = fit_svm(x[rows], np.where(y[rows] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        x = np.append(x, 1.0)
        family, sure = self.families[0], 1.0
        if self.outer is not None:
            margins = self.outer @ x
            best = int(np.argmax(margins))
            family, sure = self.families[best], _chance(margins[best])
        members = self.of[family]
        if len(members) == 1:
            return members[0], sure
        votes = dict.fromkeys(members, 0.0)
        for a, b in itertools.combinations(members, 2):
            p = _chance(self.inner[family, a, b] @ x)
            votes[a] += p
            votes[b] += 1.0 - p
        best = max(members, key=lambda lang: (votes[lang], lang))
        return best, sure * votes[best] / (len(members) - 1)


def _chance(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-4.0 * margin)))


def shares(counts: dict[str, int], max_train: int, least: dict[str, int] | None = None) -> dict[str, int]:
    """What part of each language's rows is learned from, in steps of share_of. Languages get equal parts of max_train; what one lacks goes to those with more. least: where each language's first row stands."""
    out, left = {}, max_train
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        quota = max(1, min(n, left // (len(counts) - i)))
        out[lang], left = share_of(n, quota, least and least[lang]), max(0, left - quota)
    return out


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN) -> LanguageModel | None:
    """Learns from text and lang of rows with both, where text has a letter: of about max_train rows at most, in equal parts by language, picked by the hash of doc_id and text."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    place = place_of("doc_id", "text")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("least")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return None
    part = shares({r["lang"]: r["n"] for r in counts}, max_train, {r["lang"]: r["least"] for r in counts})
    labelled = labelled.where(place < F.try_element_at(F.create_map(*[F.lit(x) for pair in part.items() for x in pair]), F.col("lang")))
    small_batches(labelled.sparkSession)

    def vectors(batches):
        for batch in batches:
            rows = [(d.as_py(), lang.as_py(), t.as_py()) for d, lang, t in zip(*batch.columns, strict=True)]
            x = [features(t).astype("<f2").tobytes() if has_letter(t) else None for _, _, t in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(x, pa.binary())], ["doc_id", "lang", "x"])

    rows = labelled.mapInArrow(vectors, "doc_id long, lang string, x binary").limit(2 * max_train + len(counts)).collect()
    rows = sorted((r for r in rows if r["x"]), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["lang"], r["x"]))
    if not rows:
        return None
    x = np.empty((len(rows), DIMS), np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r["x"], "<f2")
    y = [r["lang"] for r in rows]
    del rows
    return LanguageModel(sorted(set(y)), x, y)


def predict(docs: DataFrame, model: LanguageModel | None, columns: list[str] | None = None) -> DataFrame:
    """The given columns of docs (doc_id) with lang_pred and score; only text enters the prediction."""
    small_batches(docs.sparkSession)
    columns = columns or ["doc_id"]
    docs = docs.select(*columns, F.col("text").alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        for batch in batches:
            found = [own.predict(features(t)) if own and has_letter(t) else ("und", 0.0) for t in (x.as_py() for x in batch.column(len(columns)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*columns, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def drop_undetermined(docs: DataFrame, model: LanguageModel | None, min_score: float) -> DataFrame:
    """docs without rows whose language can't be told (`und`, or a score below min_score); columns and other rows are untouched."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def told(text: str | None) -> bool:
        return has_letter(text) and sent.value.predict(features(text))[1] >= min_score

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([sent.value is not None and told(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
