import hashlib
import random
from collections import Counter

import pytest

from corpuscope.llm import registry, substrings

from .conftest import documents


def brute(texts, n=200):
    docs = [(t or "").encode() for t in texts]
    often = Counter(d[i : i + n] for d in docs for i in range(len(d) - n + 1))
    out = []
    for k, d in enumerate(docs):
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if often[d[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((k, len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


@pytest.fixture
def texts(prose):
    rng = random.Random(2)
    passage, other = prose(60, 100), prose(45, 101)
    out = [None, "", "short", "x" * 199, "x" * 200, "y" * 200, "y" * 201, "ab" * 300, "abc" * 150 + prose(30, 1)]
    for i in range(25):
        body = prose(rng.randint(20, 90), 200 + i)
        at = rng.randint(0, len(body))
        cut = rng.randint(0, 150)
        out.append(body[:at] + passage[cut : cut + rng.randint(190, 320)] + body[at:] + (other if i % 3 else "é" + other[: rng.randint(150, 260)]))
    base = prose(150, 300)
    for _ in range(6):
        edited = list(base)
        for _ in range(rng.randint(1, 4)):
            edited[rng.randrange(len(edited))] = rng.choice("xyzé𝒳")
        out.append("".join(edited))
    inside = prose(40, 301)
    return [*out, base, base, base[:500], f"{inside} {prose(9, 302)} {inside}", "same text " * 30, "same text " * 30]


def test_query_equals_brute_force(spark, store, texts):
    got = registry.op4_repeated_strings(spark, store(documents=documents(spark, texts))).collect()
    assert sorted(map(tuple, got)) == brute(texts)


def test_salts_blocks_and_cuts_change_nothing(spark, texts, monkeypatch):
    monkeypatch.setattr(substrings, "PER_SALT", 3)
    monkeypatch.setattr(substrings, "BLOCK", 1000)
    monkeypatch.setattr(substrings, "BUFFER", 700)
    ids = [i // 2 if i % 5 else None for i in range(len(texts))]
    docs = documents(spark, texts, doc_id=ids).withColumn("row", documents_text()).withColumn("spans", documents_text())
    got = substrings.remove_repeats(docs).collect()
    expected = [(ids[k], n, removed, digest) for k, n, removed, _, digest in brute(texts)]
    assert sorted(((r.doc_id, r.n_bytes, sum(s["to"] - s["from"] for s in r.removed), r.kept_sha256) for r in got), key=str) == sorted(expected, key=str)


def documents_text():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_empty_table(spark):
    assert substrings.remove_repeats(documents(spark, [])).collect() == []


def test_a_hot_anchor_is_split(spark, store, prose, monkeypatch):
    """Many documents share a line of 100 bytes, of 198 bytes or of 230 bytes in differing surroundings: one anchor, many distinct pieces."""
    monkeypatch.setattr(substrings, "PER_SALT", 4)
    line = prose(60, 1)
    texts = [f"{prose(40, 10 + i)} {line[: (100, 198, 230)[i % 3]]} {prose(40, 100 + i)}" for i in range(40)]
    texts += [texts[0][:250] + "!" + texts[0][251:], texts[2]]
    got = registry.op4_repeated_strings(spark, store(documents=documents(spark, texts))).collect()
    assert sorted(map(tuple, got)) == brute(texts)
