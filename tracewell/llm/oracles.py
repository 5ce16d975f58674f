"""The queries that SQL can express, as SQL."""

from __future__ import annotations

from . import disclosure
from .mixing import OTHER, STEM, Params

OP6 = r"""
WITH host_pages AS (
  SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host, page_id, url FROM pages
), hosts AS (
  SELECT host, min(page_id) AS lo, count(*) AS n FROM host_pages WHERE host <> '' GROUP BY host
), entries AS (
  SELECT 'spam' AS list, 'host' AS kind, host AS value, 'add' AS action, DATE '2024-01-01' + CAST(lo % 200 AS INTEGER) AS day FROM hosts WHERE lo % 3 = 0
  UNION ALL SELECT 'spam', 'host', host, 'remove', DATE '2024-01-01' + CAST(lo % 200 + 30 + n % 60 AS INTEGER) FROM hosts WHERE lo % 3 = 0
  UNION ALL SELECT 'spam', 'host', host, 'add', DATE '2024-01-01' + CAST(lo % 200 + 120 + n % 60 AS INTEGER) FROM hosts WHERE lo % 6 = 0
  UNION ALL SELECT 'adult', 'domain', regexp_replace(host, '^(www|m|blog)\.', ''), 'add', DATE '2024-01-01' + CAST(lo % 300 AS INTEGER) FROM hosts WHERE lo % 5 = 1
  UNION ALL SELECT 'adult', 'domain', regexp_replace(host, '^(www|m|blog)\.', ''), 'remove', DATE '2024-01-01' + CAST(lo % 300 + 45 AS INTEGER) FROM hosts WHERE lo % 10 = 1
  UNION ALL SELECT 'copyright', 'prefix', host || '/en', 'add', DATE '2024-01-01' + CAST(lo % 250 AS INTEGER) FROM hosts WHERE lo % 7 = 2
), daily AS (
  SELECT list, kind, value, day, min(CASE WHEN action = 'add' THEN 1 ELSE 0 END) AS adds FROM entries GROUP BY ALL
), spans AS (
  SELECT * FROM (SELECT list, kind, value, adds, day AS valid_from,
    coalesce(lead(day) OVER (PARTITION BY list, kind, value ORDER BY day), DATE '9999-12-31') AS valid_to FROM daily) WHERE adds = 1
), captures AS (
  SELECT page_id, url, host, DATE '2024-01-01' + CAST(page_id * 7919 % 366 AS INTEGER) AS fetched_on,
    list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1)), '/'), lambda x: x <> '') AS parts,
    string_split(host, '.') AS labels FROM host_pages
), keys AS (
  SELECT page_id, 'host' AS kind, host AS value FROM captures WHERE host <> ''
  UNION ALL SELECT page_id, 'domain', array_to_string(labels[i:], '.') FROM captures, unnest(range(1, len(labels) + 1)) AS t(i) WHERE host <> ''
  UNION ALL SELECT page_id, 'prefix', host || '/' || array_to_string(parts[1:i], '/') FROM captures, unnest(range(1, 4)) AS t(i) WHERE host <> '' AND i <= len(parts)
), active AS (
  SELECT k.page_id, count(*) AS n_active, min(s.list || '/' || s.kind || '/' || s.value) AS first_rule
  FROM keys k JOIN captures c USING (page_id) JOIN spans s ON k.kind = s.kind AND k.value = s.value
    AND c.fetched_on >= s.valid_from AND c.fetched_on < s.valid_to GROUP BY k.page_id
)
SELECT c.page_id, c.url, c.fetched_on, coalesce(n_active, 0) AS n_active, first_rule, coalesce(n_active, 0) > 0 AS blocked
FROM captures c LEFT JOIN active a USING (page_id)
"""


def op10(p: Params = Params()) -> str:
    steps = ["w0 AS (SELECT c.*, tokens / total AS weight, tokens / (%r * total) AS most FROM cells c, total WHERE tokens > 0)" % p.rate]
    for d in ("source", "lang", "topic"):
        steps.append(
            f"g_{d} AS (SELECT {d}, g / sum(g) OVER () AS goal FROM (SELECT {d}, pow(CAST(sum(tokens) AS DOUBLE), {p.powers[d]}) AS g FROM w0 GROUP BY {d}))"
        )
    last = "w0"
    for k in range(p.sweeps):
        for d in ("source", "lang", "topic"):
            name = f"w{k + 1}_{d}"
            steps.append(
                f"{name} AS (SELECT w.source, w.lang, w.topic, w.tokens, w.most, w.weight * g.goal / sum(w.weight) OVER (PARTITION BY w.{d}) AS weight "
                f"FROM {last} w JOIN g_{d} g ON g.{d} = w.{d})"
            )
            last = name
        steps.append(f"w{k + 1} AS (SELECT source, lang, topic, tokens, most, least(weight, most) AS weight FROM {last})")
        last = f"w{k + 1}"
    picks = ["pick1 AS (SELECT stem FROM seeds ORDER BY n DESC, stem LIMIT 1)"]
    for k in range(2, p.topics + 1):
        picks.append(
            f"pick{k} AS (SELECT stem FROM pick{k - 1} UNION ALL (SELECT stem FROM seeds WHERE stem NOT IN (SELECT stem FROM pick{k - 1}) "
            f"AND NOT EXISTS (SELECT 1 FROM near WHERE near.a = seeds.stem AND near.b IN (SELECT stem FROM pick{k - 1})) ORDER BY n DESC, stem LIMIT 1))"
        )
    rounds = [f"own0 AS (SELECT stem, stem AS topic FROM pick{p.topics})"]
    for k in range(p.rounds + 1):
        rounds.append(
            f"told{k} AS (SELECT r, topic FROM (SELECT r, topic, count(*) AS n FROM hits JOIN own{k} USING (stem) GROUP BY ALL) "
            "QUALIFY row_number() OVER (PARTITION BY r ORDER BY n DESC, topic) = 1)"
        )
        if k < p.rounds:
            rounds.append(f"use{k} AS (SELECT topic, stem, CAST(count(*) AS DOUBLE) AS n FROM hits JOIN told{k} USING (r) GROUP BY ALL)")
            rounds.append(
                f"own{k + 1} AS (SELECT stem, topic FROM (SELECT stem, topic, n / sum(n) OVER (PARTITION BY topic) AS share FROM use{k}) "
                "QUALIFY row_number() OVER (PARTITION BY stem ORDER BY share DESC, topic) = 1)"
            )
    return f"""
WITH given AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
    CAST(CASE WHEN trim(text) <> '' THEN length(text) - length(replace(text, ' ', '')) + 1 ELSE 0 END AS BIGINT) AS n_tokens,
    list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{STEM}', 1)) AS stems
  FROM documents
), every AS (SELECT count(*) AS n FROM given),
each AS MATERIALIZED (SELECT r, unnest(stems) AS stem FROM given),
known AS MATERIALIZED (
  SELECT stem, n FROM (SELECT stem, count(*) AS n FROM each GROUP BY stem)
  WHERE n * {p.most_docs} <= (SELECT n FROM every) AND n * {p.least_docs} >= (SELECT n FROM every) ORDER BY n DESC, stem LIMIT {p.terms}
), hits AS MATERIALIZED (SELECT r, stem FROM each WHERE stem IN (SELECT stem FROM known)),
seeds AS MATERIALIZED (SELECT stem, n FROM known ORDER BY n DESC, stem LIMIT {p.seeds}),
near AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.stem AS a, y.stem AS b, x.n AS na, y.n AS nb, count(*) AS n FROM hits h JOIN seeds x ON h.stem = x.stem
    JOIN hits i ON h.r = i.r JOIN seeds y ON i.stem = y.stem WHERE x.stem <> y.stem GROUP BY ALL)
  WHERE n * (SELECT n FROM every) > {p.lift} * na * nb
), {", ".join(picks)}, {", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in rounds)},
seen AS (SELECT given.* EXCLUDE (stems), coalesce(topic, '{OTHER}') AS topic FROM given LEFT JOIN told{p.rounds} USING (r)),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM seen GROUP BY ALL),
total AS (SELECT sum(tokens) AS total FROM cells),
{", ".join(steps)},
raked AS (
  SELECT w.*, sum(weight) OVER (PARTITION BY source) - gs.goal AS source_residual, sum(weight) OVER (PARTITION BY lang) - gl.goal AS lang_residual,
    sum(weight) OVER (PARTITION BY topic) - gt.goal AS topic_residual
  FROM {last} w JOIN g_source gs USING (source) JOIN g_lang gl USING (lang) JOIN g_topic gt USING (topic)
)
SELECT s.doc_id, s.source, s.lang, s.topic, s.n_tokens, round(w.weight, 9) AS cell_weight, round(least(1.0, w.weight / w.most), 9) AS probability,
  round(source_residual, 9) + 0.0 AS source_residual, round(lang_residual, 9) + 0.0 AS lang_residual, round(topic_residual, 9) + 0.0 AS topic_residual
FROM seen s JOIN raked w ON s.source = w.source AND s.lang = w.lang AND s.topic = w.topic
WHERE s.n_tokens > 0
  AND CAST('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), '') || ':{p.seed}'), 1, 13) AS BIGINT) / 4503599627370496.0 < least(1.0, w.weight / w.most)
"""


def op13(p: disclosure.Params = disclosure.Params()) -> str:
    """Plain patterns as the task words them: this engine's matcher never goes over a text twice."""
    word = r"\p{L}{%d,}" % p.letters
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    raw = " UNION ALL ".join(
        f"SELECT r, doc_id, {k} AS kind, regexp_extract_all(text, '{x}') AS m, string_split_regex(text, '{x}') AS g FROM given" for k, x in enumerate(plain.values())
    )
    digits = "regexp_replace(match, '[^0-9]', '', 'g')"
    return f"""
WITH given AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({raw}),
hits AS (
  SELECT r, kind, i, m[i] AS match, g[i] AS gap, g[i + 1] AS rest, {digits} AS digits
  FROM (SELECT r, kind, m, g, unnest(range(1, len(m) + 1)) AS i FROM raw)
),
placed AS (
  SELECT *, sum(length(gap) + length(match)) OVER (PARTITION BY r, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop,
    CASE kind WHEN 0 THEN true
      WHEN 1 THEN len(list_filter(string_split(match, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(nullif(ltrim(x, '0'), '') AS INTEGER), 0) > 255)) = 0
      WHEN 2 THEN length(digits) BETWEEN {disclosure.CARD_DIGITS[0]} AND {disclosure.CARD_DIGITS[1]} AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
        CASE WHEN i % 2 = 1 THEN CAST(digits[length(digits) - i + 1] AS INTEGER) WHEN CAST(digits[length(digits) - i + 1] AS INTEGER) > 4
        THEN 2 * CAST(digits[length(digits) - i + 1] AS INTEGER) - 9 ELSE 2 * CAST(digits[length(digits) - i + 1] AS INTEGER) END)) % 10 = 0
      ELSE length(digits) BETWEEN {disclosure.PHONE_DIGITS[0]} AND {disclosure.PHONE_DIGITS[1]} END AS good
  FROM hits
),
found AS (
  SELECT r, kind, CAST(stop - length(match) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CASE WHEN kind < 2 THEN lower(match) ELSE digits END AS value,
    right(gap, {p.reach}) AS before, left(rest, {p.reach}) AS after, length(gap) > {p.reach} AS cut, length(rest) > {p.reach} AS more
  FROM placed WHERE good
),
sides AS (
  SELECT r, kind, value, before || chr(1) || after AS context, before AS side, start - length(before) AS begins, cut AS cut, false AS more FROM found
  UNION ALL SELECT r, kind, value, before || chr(1) || after, after, stop, false, more FROM found
),
words AS (SELECT *, regexp_extract_all(side, '{word}') AS w, string_split_regex(side, '{word}') AS g FROM sides),
near AS (
  SELECT r, kind, value, context, lower(w[i]) AS term, begins + length(array_to_string(g[1:i], '')) + length(array_to_string(w[1:i - 1], '')) AS start,
    begins + length(array_to_string(g[1:i], '')) + length(array_to_string(w[1:i], '')) AS stop, begins, begins + length(side) AS ends, cut, more
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words)
),
terms AS (SELECT * FROM near WHERE NOT (cut AND start = begins) AND NOT (more AND stop = ends)),
pairs AS (SELECT kind, value, term, count(DISTINCT r) AS n_both FROM terms GROUP BY ALL HAVING count(DISTINCT context) >= {p.contexts}),
held AS (SELECT kind, value, count(DISTINCT r) AS n_value FROM found GROUP BY ALL),
counts AS (
  SELECT term, count(*) AS n_term FROM (SELECT unnest(list_distinct(list_transform(regexp_extract_all(text, '{word}'), lambda x: lower(x)))) AS term FROM given) GROUP BY term
),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM given),
told AS (
  SELECT kind, value, term FROM pairs JOIN held USING (kind, value) JOIN counts USING (term), total
  WHERE n_value < n AND ln(n_both * n / (CAST(n_value AS DOUBLE) * n_term)) / ln(n / n_value) >= {p.general} - {disclosure.EPSILON}
),
marked AS (SELECT DISTINCT r, start, stop FROM terms JOIN told USING (kind, value, term)),
free AS (SELECT r, {disclosure.TERM} AS kind, start, stop FROM marked t WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.r = t.r AND f.start < t.stop AND f.stop > t.start)),
listed AS (
  SELECT r, kind, start, CASE kind {" ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(disclosure.KINDS))} END || ':' || start || ':' || stop AS span
  FROM (SELECT r, kind, start, stop FROM found UNION ALL SELECT * FROM free)
),
by_row AS (
  SELECT r, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(disclosure.KINDS[: disclosure.TERM]))},
    string_agg(span, ',' ORDER BY kind, start) FILTER (kind < {disclosure.TERM}) AS base, string_agg(span, ',' ORDER BY kind, start) AS spans FROM listed GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name in disclosure.KINDS[: disclosure.TERM])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM given LEFT JOIN by_row USING (r)
"""
