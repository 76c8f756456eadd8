import hashlib
import re

from corpuscope.llm import registry, secrets

from .conftest import documents

BASE = (
    ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def brute(doc_id, text):
    spans = []
    for k, (_, pattern, fits) in enumerate(BASE):
        spans += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if fits(m)]
    shown = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(spans))
    return (doc_id, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(shown.encode()).hexdigest()), shown


TEXTS = [
    None, "", "no secret here: none", "password=hunter22 PassWord : 'abc' TOKEN=\"abcdefgh\" x", "é𝒳 api_key=abcdef apikey = 123456 API_KEY:zzzzzz", "passwd==secret=token=abcdefg",
    "AKIA" + "A1" * 8, "AKIAAKIA" + "Z" * 30 + " AKIASHORT", "f" * 23 + " " + "a0" * 12, "x" + "deadbeef" * 5 + "g", "token = " + "0123456789abcdef" * 2, "tok en=abcdefgh pass word=abcdefgh",
    "line\npassword\n=abcdef password: \"\nabcdef", "Key toKen=abcdefgh", "a" * 50_000, "token=abcdef " * 1500, "-----BEGIN RSA PRIVATE KEY-----\nx ghp_" + "X9Q" * 12, "\x01\x02 secret='a.b-c_d' \x00",
    "password=password=password=1", "same token=abcdefg", "same token=abcdefg",
]


def test_query_equals_brute_force(spark, store):
    got = registry.op3_secret_scan(spark, store(documents=documents(spark, TEXTS))).collect()
    for r in got:
        digest, shown = brute(r.doc_id, TEXTS[r.doc_id])
        assert tuple(r)[:5] == digest, TEXTS[r.doc_id][:80]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == [s for s in shown.split(",") if s]
    assert len(got) == len(TEXTS)
    extra = next(r for r in got if r.doc_id == 16)
    assert {s.split(":")[0] for s in extra.spans.split(",")} == {"key", "vendor"}


def test_clashing_ids_and_columns(spark):
    docs = documents(spark, ["token=abcdefg", "nothing", "password=abcdefg", None], doc_id=[1, 1, None, None])
    got = secrets.find_secrets(docs.withColumn("trigram", docs.text).withColumn("of", docs.text).withColumn("spans", docs.text)).collect()
    assert sorted((str(r.doc_id), r.text, len(r.spans)) for r in got) == [("1", "nothing", 0), ("1", "token=abcdefg", 1), ("None", "", 0), ("None", "password=abcdefg", 1)]
    assert secrets.find_secrets(documents(spark, [])).collect() == []


def test_trigrams_decide_candidates(spark):
    docs = documents(spark, ["passw sword", "password", "akia", "AKIA0"])
    got = {r.doc_id: (r.maybe_assign, r.maybe_access) for r in secrets.candidates(secrets.index(docs)).collect()}
    assert got[1] == (True, False) and got[2] == got[3] == (False, True) and set(got) <= {0, 1, 2, 3}


def test_queries_are_derived_from_the_regex(spark):
    """A new rule needs nothing but its regex; what it doesn't make mandatory isn't asked for."""
    shown = lambda regex: [sorted("".join(sorted(s)) for s in clause) for clause in secrets.query_of(secrets.Rule("x", regex))]
    assert shown("abcd") == [["abcbcd"]]
    assert shown("abc|xyz+") == [] and shown("abc|(?:xyz)+") == [["abc", "xyz"]]
    assert shown("[0-9a-f]+") == shown("(?:abc)?") == shown("abc|d") == shown("a.b.c") == shown("(?:abc)*") == []
    assert shown("abc.*def") == shown("(?i:ABC)[0-9]{2}DEF") == [["abc"], ["def"]]
    assert shown("ab(?:c|d)") == [["abc", "abd"]] and shown("abc?de") == [["abcbcdcde", "abdbde"]]
    assert secrets.query_of(secrets.BASE[2]) == []
    every = [secrets.Rule("new", r"npm_[A-Za-z0-9]+", 20)]
    docs = documents(spark, ["see NPM_x and npm_" + "a1" * 20, "npm", None])
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secrets.find_secrets(docs, every).collect()}
    assert got == {0: [(14, 58)], 1: [], 2: []}
    assert {r.doc_id for r in secrets.candidates(secrets.index(docs, every), every).collect()} == {0}


def test_any_match_holds_its_query():
    """Texts that match a rule, made from its pattern, hold what its derived query asks for."""
    samples = {"assign": ["PassWord = 'abcdef'", "api_key:abcdef", "apikey=abcdef", "token \t=abcdef".replace("\t", " ")], "access": ["AKIA" + "A1" * 8], "key": ["-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----"], "vendor": ["ghs_" + "a" * 20, "xoxp-" + "1-" * 9, "sk_live_" + "z" * 20]}
    for rule in secrets.RULES:
        for text in samples.get(rule.kind, []):
            assert re.search(rule.regex, text)
            grams = set(secrets.trigrams(text.lower()))
            assert all(any(s <= grams for s in clause) for clause in secrets.query_of(rule)), (rule, text)


def test_many_matches_of_one_text(spark):
    text = "token=abcdef " * 3000
    got = secrets.find_secrets(documents(spark, [text])).first()
    assert [(s.start, s.end) for s in got.spans] == [(13 * i, 13 * i + 12) for i in range(3000)]
