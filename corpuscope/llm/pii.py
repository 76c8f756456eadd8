"""Personal data by patterns and a skip-chain conditional random field.

Base patterns find e-mail addresses, network addresses, card and phone numbers, in time that grows with
the text's length only. The random field then labels the tokens that hold a digit or an `@`
(no kind lacks both; all other tokens are fixed as no entity). Its unary potentials see a token's shape
and its neighbours'; chain potentials join tokens that follow each other closely; skip potentials join
each token to the next one of the same or similar writing, however far. Tokens under base spans are
held to the label of their span, and so are evidence for the others. Loopy message passing, in sweeps
forth and back over the document until no message changes any more, gives marginals, and so labels that
agree across the document. The potentials are learned piecewise here, from
the base patterns' own findings in a sample of documents. Tokens labelled with enough certainty
outside all base spans become further spans, named crf_<kind>.

Defined results: null text counts as empty. A document without candidates has base spans only.
Repeated rows give a row each. Without any finding to learn from, nothing is added. Extra columns are passed over.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import materialize, picked, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Documents learned from, about; tokens learned from, at most; least marginal of an added span; hashed features.
MAX_TRAIN, MAX_TOKENS, SURE, DIMS = 3000, 100_000, 0.9, 4096
#: Messages have converged when none changes by more than this; sweeps after which steps are halved, again and again, where loops keep them from settling.
TOLERANCE, SWEEPS = 1e-4, 30

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile("[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def emails(text: str):
    """From each `@` outwards: the local part reaches back over its characters, but not into an earlier match or over another `@`."""
    done, at = 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            before = text[done:at]
            local = len(before) - len(before.rstrip(_LOCAL))
            if local:
                yield at - local, m.end()
                done, at = m.end(), text.find("@", m.end())
                continue
        done, at = at + 1, text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns' matches that hold, sorted."""
    if not _HINT.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= len(m[0]) <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, number among all words, text) of words with a digit or an `@`, without marks at their ends."""
    out = []
    for i, m in enumerate(_WORD.finditer(text)):
        word = m[0]
        if _HINT.search(word):
            core = word.strip(".,;:!?\"'<>[]{}|")
            start = m.start() + len(word) - len(word.lstrip(".,;:!?\"'<>[]{}|"))
            if core:
                out.append((start, start + len(core), i, core))
    return out


def _shape(word: str) -> str:
    return re.sub("[0-9]+", lambda m: "9" * min(4, len(m[0])), re.sub(r"[^\W\d_]+", "a", word))


def _bucket(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % DIMS


def features(tokens: list) -> list[list[int]]:
    """Hashed features of each token: its shape, counts in it, and shapes of candidates that follow or precede it directly."""
    shapes = [_shape(t[3]) for t in tokens]
    out = []
    for i, (_, _, n, word) in enumerate(tokens):
        last = shapes[i - 1] if i and tokens[i - 1][2] == n - 1 else "-"
        following = shapes[i + 1] if i + 1 < len(tokens) and tokens[i + 1][2] == n + 1 else "-"
        digits = sum(map(str.isdigit, word))
        names = ("bias", f"s:{shapes[i]}", f"d:{min(digits, 20)}", f"@:{'@' in word}", f"dots:{min(word.count('.'), 5)}", f"l:{last}", f"n:{following}", f"sl:{shapes[i]}:{last}", f"sn:{shapes[i]}:{following}", f"len:{min(len(word), 30) // 3}")
        out.append([_bucket(x) for x in names])
    return out


def edges(tokens: list) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges (next candidate within two words), skip edges to the next same word, skip edges to the next similar word (same digits, or same local part or domain)."""
    chain = [(i - 1, i) for i in range(1, len(tokens)) if tokens[i][2] - tokens[i - 1][2] <= 2]
    same, alike, last, near = [], [], {}, {}
    for i, (_, _, _, word) in enumerate(tokens):
        word = word.lower()
        if word in last:
            same.append((last[word], i))
        last[word] = i
        digits = "".join(c for c in word if "0" <= c <= "9")
        for key in [f"d{digits}"] * (len(digits) >= 6) + [f"p{p}" for p in word.split("@")[:2] if "@" in word and len(p) >= 4]:
            if key in near and near[key] != last.get(word, -1) and tokens[near[key]][3].lower() != word:
                alike.append((near[key], i))
            near[key] = i
    return chain, same, alike


def silver(tokens: list, spans: list) -> list[int]:
    """The label of each token: 0, or 1 + the kind of the first base span that overlaps it. Spans of one kind don't overlap each other."""
    by_kind = [[s for s in spans if s[1] == k] for k in range(len(KINDS))]
    starts = [[s[0] for s in own] for own in by_kind]
    out = []
    for start, end, _, _ in tokens:
        last = [own[i - 1] for own, s in zip(by_kind, starts, strict=True) if (i := bisect.bisect_left(s, end))]
        out.append(min((s for s in last if s[2] > start), default=(0, -1, 0))[1] + 1)
    return out


#: Log potential of a label that a token can't have.
_NEVER = -60.0


class SkipChain:
    """unary: weights by feature and label; chain, same, alike: log potentials by pair of labels."""

    def __init__(self, unary, chain, same, alike):
        self.unary, self.chain, self.same, self.alike = unary, chain, same, alike

    def marginals(self, tokens: list, held: list[int] | None = None) -> np.ndarray:
        """A row of chances of labels for each token. held: labels that are known, and 0 for the others."""
        local = np.array([self.unary[f].sum(axis=0) for f in features(tokens)])
        local -= local.max(axis=1, keepdims=True)
        for i, label in enumerate(held or ()):
            if label:
                local[i] = _NEVER
                local[i, label] = 0.0
        pairs, tables = [], []
        for some, table in zip(edges(tokens), (self.chain, self.same, self.alike), strict=True):
            pairs += some
            tables += [np.exp(table)] * len(some)
        belief = local
        if pairs:
            belief = self._passed(local, np.array(pairs), np.array(tables))
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)

    @staticmethod
    def _passed(local: np.ndarray, pairs: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Log beliefs when messages have converged. A sweep sends each token's messages on once all that reach it from before (or, backwards, from behind) are new, so evidence crosses the whole document in it."""
        n = len(local)
        low, high = pairs.min(axis=1), pairs.max(axis=1)
        sums = [np.zeros((len(pairs), local.shape[1])) for _ in range(2)]  # log messages forth and back
        belief = local.copy()
        ways = []
        for source, target, table in ((low, high, tables), (high, low, tables.transpose(0, 2, 1))):
            order = np.argsort(source, kind="stable")
            edge = np.searchsorted(source[order], np.arange(n + 1))
            ways.append((target, table, [order[edge[i] : edge[i + 1]] for i in range(n)]))
        sweep = 0
        while True:
            share, change = 0.5 ** (sweep // SWEEPS), 0.0
            for way, (target, table, out) in enumerate(ways):
                own, back = sums[way], sums[1 - way]
                for i in range(n) if way == 0 else range(n - 1, -1, -1):
                    e = out[i]
                    if not len(e):
                        continue
                    log = belief[i] - back[e]
                    fresh = np.log(np.einsum("el,elm->em", np.exp(log - log.max(axis=1, keepdims=True)), table[e]))
                    fresh -= fresh.max(axis=1, keepdims=True)
                    step = share * (fresh - own[e])
                    change = max(change, float(np.abs(step).max()))
                    np.add.at(belief, target[e], step)
                    own[e] += step
            sweep += 1
            if change <= TOLERANCE:
                return belief

    def added(self, text: str, spans: list) -> list[tuple[int, int, int]]:
        """Spans beyond the base ones, with kinds from len(KINDS) on; neighbours with one label join."""
        tokens = candidates(text)
        if not tokens:
            return []
        taken = silver(tokens, spans)
        if all(taken):
            return []
        found = self.marginals(tokens, taken)
        best = found.argmax(axis=1)
        out: list[tuple[int, int, int]] = []
        last = -9
        for i, (start, end, n, _) in enumerate(tokens):
            if taken[i] or best[i] == 0 or found[i, best[i]] < SURE:
                continue
            kind = int(best[i]) - 1 + len(KINDS)
            if out and last == n - 1 and out[-1][1] == kind:
                out[-1] = (out[-1][0], kind, end)
            else:
                out.append((start, kind, end))
            last = n
        return out


def _association(counts: dict[tuple[int, int], int], n: int) -> np.ndarray:
    """Log of how much more often labels meet on an edge than apart, from counts with one more everywhere."""
    joint = np.ones((n, n))
    for pair, often in counts.items():
        joint[pair] += often
    joint = joint + joint.T
    joint /= joint.sum()
    side = joint.sum(axis=0)
    return np.clip(np.log(joint / np.outer(side, side)), -3, 3)


def _learn(tokens: list[list[int]], labels: np.ndarray, pairs: list[dict[tuple[int, int], int]]) -> SkipChain | None:
    if not len(labels) or not labels.any():
        return None
    n = len(KINDS) + 1
    x, weights = np.array(tokens), np.zeros((DIMS, n))
    truth = np.eye(n)[labels]
    for step in range(200):
        score = weights[x].sum(axis=1)
        chance = np.exp(score - score.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        slope = (truth - chance) / len(labels)
        grad = np.zeros_like(weights)
        for j in range(x.shape[1]):
            np.add.at(grad, x[:, j], slope)
        weights += 3.0 / (1 + step / 100) * (grad - 1e-4 * weights)
    return SkipChain(weights, *[_association(p, n) for p in pairs])


def fit(docs: DataFrame, max_train: int = MAX_TRAIN, max_tokens: int = MAX_TOKENS) -> SkipChain | None:
    """Learns from what the base patterns find in about max_train documents with a digit or `@`, picked by the hash of doc_id and text.

    All edges of these documents are counted by label; of their tokens, those of copies once, about max_tokens at most are learned from, picked by the hash of document and place.
    """
    hinted = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            kinds, keys, values = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens, spans = candidates(text), base_spans(text)
                labels = silver(tokens, spans)
                kinds += [0] * len(tokens)
                keys += [key + i for i in range(len(tokens))]
                values += [[y, *f] for f, y in zip(features(tokens), labels, strict=True)]
                for k, some in enumerate(edges(tokens)):
                    kinds += [k + 1] * len(some)
                    keys += [0] * len(some)
                    values += [[labels[a], labels[b]] for a, b in some]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(values, pa.list_(pa.int32()))], ["kind", "key", "value"])

    key = F.shiftright(F.xxhash64("doc_id", "text"), 1).alias("key")
    rows = picked(hinted, ["doc_id", "text"], max_train).select(key, "text").mapInArrow(run, "kind int, key long, value array<int>")
    rows = materialize(rows, "pii-tokens")
    counts = rows.where("kind > 0").groupBy("kind", "value").count().collect()
    tokens = rows.where("kind = 0").select("key", "value").distinct()  # copies of a document have its keys
    own = sorted(r["value"] for r in picked(tokens, ["key"], max_tokens).collect())
    pairs = [{tuple(r["value"]): r["count"] for r in counts if r["kind"] == k} for k in (1, 2, 3)]
    return _learn([v[1:] for v in own], np.array([v[0] for v in own], int), pairs)


def find_pii(docs: DataFrame, model: SkipChain | None) -> DataFrame:
    """doc_id and spans, an array of (start, kind, end) with kinds by name, sorted by start, then kind: a row for each row of docs."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [*KINDS, *(f"crf_{k}" for k in KINDS)]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(batches):
        own = sent.value
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                spans = base_spans(text)
                if own and _HINT.search(text):
                    spans = sorted(spans + own.added(text, spans))
                out.append([{"start": a, "kind": names[k], "end": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:int,kind:string,end:int>>")
