import hashlib
import random
import re

from corpuscope.llm import pii, registry

from .conftest import documents


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


BASE = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
)


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (p, fits) in enumerate(BASE) for m in re.finditer(p, text or "") if fits(m))


TEXTS = [
    None, "", "no data", "é𝒳 write to a.b%c+d-e@mail-1.example.com, or a@b@c.d.e@f.g", "x@y z@.q @a.b a@b.-c .@x.y a@@b.c", "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0004 1.2.3", "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111-4 0000 0000 0000",
    "+1 (988) 555-2485, +49.30.1234567. +12345678 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +1--------2", "call +1 (988) 555-2485 or (988) 555-2485 twice (988) 555-2485", "9" * 20_000, "a" * 30_000 + "@", "1." * 9000, "a@b" * 5000, "+1" + " " * 9000 + "x" + "+2(" * 3000,
    "4141@10.0.0.1.com +4111111111111111", "same a@b.cd", "same a@b.cd",
]


def test_query_equals_brute_force(spark, store):
    rng = random.Random(4)
    noise = ["".join(rng.choice("a1@.+- ()\n9é") for _ in range(200)) for _ in range(60)]
    texts = TEXTS + noise
    got = registry.op7_personal_data(spark, store(documents=documents(spark, texts))).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = brute(texts[r.doc_id])
        shown = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert tuple(r)[1:6] == (*(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(shown.encode()).hexdigest()), texts[r.doc_id][:99]
        assert [s for s in r.spans.split(",") if s and not s.startswith("crf_")] == [s for s in shown.split(",") if s]


def test_field_adds_consistent_labels(spark, prose):
    rng = random.Random(1)
    texts = [f"{prose(30, i)} x{i}.{i}@mail{i % 9}.example.com {prose(20, i + 1)} +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} {prose(9, i)} {i} items, 3.5 of {rng.randint(1, 9999)}" for i in range(200)]
    model = pii.fit(documents(spark, texts))
    clean = f"{prose(30, 1)} 12 items, 3.5 of 77 {prose(20, 2)}"
    docs = documents(spark, [clean, f"{prose(9, 3)} +1 (222) 555-1234 {prose(40, 4)} (222) 555-1234 {prose(40, 5)}", None], doc_id=[1, None, 1]).withColumn("spans", spark_null())
    got = [r.spans for r in pii.find_pii(docs, model).collect()]
    assert got[0] == [] and got[2] == []
    assert {s.kind for s in got[1]} == {"phone", "crf_phone"}
    assert pii.find_pii(documents(spark, []), model).collect() == []


def spark_null():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")


def test_messages_carry_labels_over_skip_edges():
    import numpy as np

    tokens = [(0, 3, 0, "ab1"), (4, 7, 1, "zz9"), (20, 23, 50, "ab1")]
    f = pii.features(tokens)
    unary = np.zeros((pii.DIMS, 5))
    unary[list(set(f[0]) - set(f[2])), 4] = 3.0
    tied, free = np.where(np.eye(5) > 0, 2.0, -2.0), np.zeros((5, 5))
    assert pii.edges(tokens) == ([(0, 1)], [(0, 2)], [])
    alone = pii.SkipChain(unary, free, free, free).marginals(tokens)
    joined = pii.SkipChain(unary, free, tied, free).marginals(tokens)
    assert np.allclose(alone[2], 0.2) and joined[2].argmax() == 4 and joined[2, 4] > 0.8


def test_labels_carry_over_any_number_of_mentions():
    import numpy as np

    n = 30
    tokens = [(i * 10, i * 10 + 3, i * 50, "ab1") for i in range(n)]
    unary = np.zeros((pii.DIMS, 5))
    unary[pii.features(tokens)[0][0], 0] = 2.5
    tied, free = np.where(np.eye(5) > 0, 3.0, -3.0), np.zeros((5, 5))
    model = pii.SkipChain(unary, free, tied, free)
    assert (model.marginals(tokens).argmax(axis=1) == 0).all()
    # exact marginals of the chain, with the first mention held to phone
    local = np.exp(np.array([unary[f].sum(axis=0) for f in pii.features(tokens)]))
    local[0] = np.eye(5)[4]
    forth, back = [local[0]], [np.ones(5)]
    for i in range(1, n):
        f = local[i] * (forth[-1] @ np.exp(tied))
        forth.append(f / f.sum())
        b = np.exp(tied) @ (local[n - i] * back[-1])
        back.append(b / b.sum())
    exact = np.array(forth) * np.array(back[::-1])
    exact /= exact.sum(axis=1, keepdims=True)
    assert np.allclose(model.marginals(tokens, [4] + [0] * (n - 1)), exact, atol=1e-3)


def test_base_spans_are_evidence():
    import numpy as np

    unary = np.zeros((pii.DIMS, 5))
    tied, free = np.where(np.eye(5) > 0, 3.0, -3.0), np.zeros((5, 5))
    text = "4111111111111111 " + "word and " * 20 + "4111111111111111 x"
    assert pii.SkipChain(unary, free, tied, free).added(text, [(0, 2, 16)]) == [(197, 2 + len(pii.KINDS), 213)]
