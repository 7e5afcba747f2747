"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import chat, rules, urls

_WORDS = r"'[^\x20\x09-\x0D]+'"


def quality_rules() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(" ".join(rules.STOP_WORDS).split()))
    tests = []
    for r in rules.THRESHOLDS:
        base = "1" if r.denominator is None else r.denominator
        if r.low is not None:
            tests.append(f"{r.numerator} >= {float(r.low)} * {base}")
        if r.high is not None:
            tests.append(f"{r.numerator} <= {float(r.high)} * {base}")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS k FROM d, unnest(range(1, len(w) - 6)) AS t(i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, unnest(range(0, 8)) AS u(j) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS l FROM d),
m AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(w, lambda x: list_contains([{stops}], lower(x))))::BIGINT AS n_stop
  FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop, base_failed,
  NOT base_failed AND {" AND ".join(tests)} AS kept FROM f
"""


_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''), {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''), {_ALNUM}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
  FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM bw) AS s, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS c FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(0, n)) AS u(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS c, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.c, 0)::BIGINT AS n_hit, coalesce(items.c, 0)::BIGINT AS n_items, sha256(coalesce(items.l, '')) AS items_sha256,
  coalesce(covered.c, 0) > 0 AND 20 * coalesce(covered.c, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS lo FROM win) WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM dup, unnest(range(0, 50)) AS u(j)),
word AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS c FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(c, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''), {_WORDS}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.c + q.c - shared)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x, x AS r FROM edges UNION SELECT e.y, reach.r FROM reach JOIN edges e ON e.x = reach.x),
comp AS (SELECT x, min(r) AS c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, coalesce(comp.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.x = d.doc_id
"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h, min(page_id) OVER (PARTITION BY sha256(b)) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM f
"""


def chat_formatting() -> str:
    grown = f"len(regexp_extract_all({{0}}, '{chat.CONTROL_PATTERN}')) + length({{0}})"
    marks = len(chat.TURN) + len(chat.TEXT) + len(chat.END)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({marks} + {grown.format("role")} + {grown.format("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def url_filters() -> str:
    """Rules, seeds, the host graph and every round of the walk, one CTE each."""
    cases = "".join(
        f" WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in sorted(urls.RULES, key=lambda r: (-len(r.text), r.text))
    )
    verdicts = "".join(f" WHEN '{r.text}' THEN '{r.verdict}'" for r in urls.RULES)
    host = r"translate(regexp_extract({}, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    href = r"""(?i)href\s*=\s*["'']?([a-z][a-z0-9+.-]*://[^"''\s>]+|//[^"''\s>]+)"""
    d = urls.DAMPING
    rounds = "".join(
        f""",
r{k + 1} AS (SELECT kind, host, sum(score) AS score FROM (
  SELECT r.kind, s.dst AS host, r.score * s.p * {d} AS score FROM r{k} r JOIN step s ON s.kind = r.kind AND s.src = r.host
  UNION ALL SELECT kind, host, score * {1 - d} FROM r0) GROUP BY ALL)"""
        for k in range(urls.ROUNDS)
    )
    return rf"""
WITH u AS (SELECT page_id, html, coalesce({host.format("url")}, '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
v AS (SELECT *, CASE rule{verdicts} END AS ruled FROM (SELECT *, CASE{cases} END AS rule FROM u)),
h AS (SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS allow, count(*) FILTER (ruled = 'block') AS block FROM v WHERE host <> '' GROUP BY host),
seeds AS (SELECT 'trust' AS kind, host, allow AS mass FROM h WHERE block = 0 AND allow > 0 UNION ALL SELECT 'distrust', host, block FROM h WHERE block = n),
r0 AS (SELECT kind, host, mass / sum(mass) OVER (PARTITION BY kind) AS score FROM seeds),
hrefs AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1)) AS href FROM u),
ends AS (SELECT src, {host.format("CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END")} AS dst FROM hrefs),
e AS (SELECT src, dst, count(*) AS weight FROM ends WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
both_ways AS (SELECT 'trust' AS kind, src, dst, weight FROM e UNION ALL SELECT 'distrust', dst, src, weight FROM e),
step AS (SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS p FROM both_ways){rounds},
last AS (SELECT * FROM r{urls.ROUNDS} WHERE EXISTS (FROM step) UNION ALL SELECT * FROM r0 WHERE NOT EXISTS (FROM step)),
s AS (SELECT host, sum(CASE kind WHEN 'trust' THEN score ELSE 0 END) AS trust, sum(CASE kind WHEN 'distrust' THEN score ELSE 0 END) AS distrust FROM last GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust > {urls.THRESHOLD} / greatest((SELECT count(*) FROM h), 1) AND distrust > trust THEN 'block' END, 'allow') AS verdict
FROM v LEFT JOIN s USING (host)
"""
