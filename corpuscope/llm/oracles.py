"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

import string

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: op5: counts of bigrams and words, with each document left out of its own.
LM_SCORES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT r, i, CASE WHEN i = 1 THEN NULL ELSE w[i - 1] END AS v, w[i] AS w FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
p AS (SELECT r, v, w, count(*) AS own FROM t GROUP BY ALL),
u AS (SELECT r, w, count(*) AS own FROM (SELECT r, w FROM t UNION ALL SELECT r, NULL FROM d WHERE len(w) > 0) GROUP BY ALL),
pairs AS (SELECT v, w, sum(own) AS n FROM p GROUP BY ALL),
words AS (SELECT w, sum(own) AS n FROM u GROUP BY ALL),
total AS (SELECT sum(len(w)) AS n FROM d),
s AS (SELECT p.r, p.own, pairs.n - p.own AS pair, cw.n - cu.own AS context, ww.n - wu.own AS single, greatest(total.n - len(d.w), 1) AS rest
 FROM p JOIN pairs ON p.v IS NOT DISTINCT FROM pairs.v AND p.w = pairs.w JOIN words cw ON p.v IS NOT DISTINCT FROM cw.w JOIN words ww ON p.w = ww.w
 JOIN u cu ON cu.r = p.r AND cu.w IS NOT DISTINCT FROM p.v JOIN u wu ON wu.r = p.r AND wu.w = p.w JOIN d ON d.r = p.r, total),
f AS (SELECT r, sum(own * ln(CASE WHEN pair > 0 THEN pair / context ELSE 0.4::DOUBLE * greatest(single, 0.5::DOUBLE) / rest END)) AS score FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(score, 0.0::DOUBLE), 4) AS score, round(score / len(w), 6) AS mean FROM d LEFT JOIN f USING (r)"""

#: op9: windows of the benchmark's items against the documents' windows of the same lengths.
DECONTAMINATION = rf"""
WITH fold AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT row_number() OVER () AS r, side, id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM fold),
b AS (SELECT coalesce(id::VARCHAR, 'null') AS item, least(10, len(w)) AS m, w FROM w WHERE side = 'b' AND len(w) > 0),
bw AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
dw AS (SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS win FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT DISTINCT m FROM bw) WHERE side = 'd')),
hits AS (SELECT dw.r, dw.i, dw.m, item FROM dw JOIN bw USING (m, win)),
n AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + m)) AS at FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS shown FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(shown, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (r) LEFT JOIN items USING (r) WHERE side = 'd'"""

#: op10: all pairs of documents that share a shingle, and what is reached from each over the similar ones.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT r, array_to_string(w[i : i + 4], ' ') AS s, count(*) AS n FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0) GROUP BY ALL),
total AS (SELECT count(*) AS n FROM d),
df AS (SELECT s, 1 + ln(1 + any_value(total.n) / count(*)) / ln(1 + any_value(total.n)) AS idf FROM s, total GROUP BY s),
wt AS MATERIALIZED (SELECT r, s, s.n * idf AS v FROM s JOIN df USING (s)),
whole AS (SELECT r, sum(v) AS v FROM wt GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, sum(least(a.v, b.v)) AS shared FROM wt a JOIN wt b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
alike AS MATERIALIZED (SELECT a, b FROM pairs JOIN whole x ON x.r = a JOIN whole y ON y.r = b WHERE shared / (x.v + y.v - shared) >= 0.8),
edges AS MATERIALIZED (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
reached(r, o) AS (SELECT r, r FROM d UNION SELECT reached.r, edges.b FROM reached JOIN edges ON reached.o = edges.a)
SELECT x.doc_id, min(y.doc_id) AS class_id, count(*) AS class_size FROM reached JOIN d x ON x.r = reached.r JOIN d y ON y.r = o GROUP BY x.r, x.doc_id"""

#: op2: the same schedule and streams, by plain windows.
SOURCE_MIXING = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '') || ':' || coalesce(text, '')) AS o FROM documents),
g AS (SELECT source, sum(size)::DOUBLE AS s FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM g),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][place % 3 + 1] AS weight, 2 * s AS most, 1.5::DOUBLE * sum(s) OVER () AS budget FROM p),
l AS (SELECT *, (budget - sum(most) OVER (ORDER BY most / weight, place) + most) / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level FROM l WHERE most / weight >= level ORDER BY most / weight, place LIMIT 1),
t AS (SELECT l.*, least(most, coalesce(f.level * weight, most)) AS target, ceil(s / 128)::BIGINT AS nb FROM l LEFT JOIN f ON true),
n AS (SELECT *, CASE WHEN s > 0 THEN target * nb / s ELSE 0.0 END AS wanted FROM t),
e AS (SELECT *, sum(wanted) OVER () AS total, sum(wanted) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS above FROM n),
b AS (SELECT *, round(total)::BIGINT AS slots, round((above - wanted) / total * 2147483648)::BIGINT AS lo, round(above / total * 2147483648)::BIGINT AS hi FROM e),
k AS (SELECT slot, (slot % 2147483648 * 1327217885) % 2147483648 AS point FROM (SELECT unnest(range((SELECT coalesce(max(slots), 0) FROM b))) AS slot)),
ranked AS (SELECT place, nb, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS rank FROM k JOIN b ON point >= lo AND point < hi),
times AS (SELECT place, rank % nb AS block, count(*) AS times FROM ranked WHERE rank // nb < 2 GROUP BY ALL),
placed AS (SELECT d.*, b.place, sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size, r ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source WHERE size > 0),
cut AS (SELECT *, unnest(range(start // 128, (start + size - 1) // 128 + 1)) AS block FROM placed),
taken AS (SELECT r, sum(times * (least(start + size, (block + 1) * 128) - greatest(start, block * 128))) AS taken FROM cut JOIN times USING (place, block) GROUP BY r)
SELECT doc_id, size, s::BIGINT AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN taken USING (r)"""

#: op4: all 200-byte strings, as hexadecimal digits.
REPEATED_STRINGS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, i, md5(h[2 * i + 1 : 2 * i + 400]) AS k FROM (SELECT r, h, unnest(range(len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
dup AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1),
marked AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, true)::INT AS new FROM dup),
numbered AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY r, run),
before AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS last FROM spans),
kept AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(h[2 * last + 1 : 2 * a], '' ORDER BY a) || any_value(h)[2 * max(b) + 1 :] AS h FROM before JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""



def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
#: Kinds of secrets in order: name, pattern, group whose length counts, least length.
_SECRETS = (
    ("assign", rf"(?:{_NAMES})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 3, 6),
    ("access", r"AKIA[A-Z0-9]+", 2, 20),
    ("hex", r"[0-9a-f]+", 2, 24),
    ("key", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", 2, 0),
    ("vendor", r"(?:gh[pousr]_[A-Za-z0-9]+|xox[abprs]-[A-Za-z0-9-]+|sk_live_[A-Za-z0-9]+)", 2, 20),
)


def _matches(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    """All matches of a kind, each with what stands before it: their lengths, summed up, give the places."""
    whole = f"'(?s)(.*?)({pattern}|\\z)'"
    parts = f"SELECT r, unnest(range(len(g))) AS i, unnest(g) AS g, unnest(h) AS h, unnest(c) AS c FROM (SELECT r, regexp_extract_all(t, {whole}, 1) AS g, regexp_extract_all(t, {whole}, 2) AS h, regexp_extract_all(t, {whole}, {group}) AS c FROM d)"
    placed = f"SELECT *, sum(length(g) + length(h)) OVER (PARTITION BY r ORDER BY i) AS b FROM ({parts})"
    return f"SELECT r, {number} AS k, '{kind}' AS kind, b - length(h) AS a, b FROM ({placed}) WHERE length(h) > 0 AND length(c) >= {least}"


#: op3: each rule's leftmost matches that don't overlap, by plain extraction from every text.
SECRET_SCAN = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_matches(i, *s) for i, s in enumerate(_SECRETS))}),
s AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
 coalesce(string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, k) FILTER (k < 3), '') AS base, string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, k) AS spans FROM m GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (r)"""

SQL = {"op3_secret_scan": SECRET_SCAN, "op4_repeated_strings": REPEATED_STRINGS, "op2_source_mixing": SOURCE_MIXING, "op5_lm_scores": LM_SCORES, "op9_decontamination": DECONTAMINATION, "op10_near_duplicates": NEAR_DUPLICATES}
