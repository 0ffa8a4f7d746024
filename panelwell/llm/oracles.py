"""SQL (DuckDB) for the queries that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

from panelwell.llm.common import LOWER, UPPER, WORD_PATTERN
from panelwell.llm.source_mixture import Margin


def number(text: str, digits: int = 15) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT)"


def mixture_sql(margins: Sequence[Margin], keep: float, rounds: int, scale_rounds: int, seed: str) -> str:
    """The raking rounds and scale rounds written out, a common table each."""
    parts = [
        r"""docs AS MATERIALIZED (SELECT doc_id, source, lang,
  CASE WHEN contains(text, 'License') THEN 'software' WHEN length(text) < 500 THEN 'note' WHEN length(text) < 5000 THEN 'article' ELSE 'long' END AS mix_topic,
  coalesce(CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_extract_all(trim(text), '[ \t\n\x0B\f\r]+')) + 1 END, 0) AS tokens FROM documents)""",
        "cells AS MATERIALIZED (SELECT source, lang, mix_topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM docs GROUP BY ALL)",
    ]
    goals = []
    for i, m in enumerate(margins):
        if m.shares is None:
            share = f"CASE WHEN n > 0 THEN pow(n, {m.temperature!r}) ELSE 0 END"
        else:
            share = "CASE " + " ".join(f"WHEN {m.column} IS NOT DISTINCT FROM '{v}' THEN {s!r}" for v, s in m.shares.items()) + " ELSE 0 END"
        parts.append(
            f"goal{i} AS MATERIALIZED (SELECT {m.column} AS value, s / sum(CASE WHEN n > 0 THEN s END) OVER () AS goal FROM "
            f"(SELECT {m.column}, n, CAST({share} AS DOUBLE) AS s FROM (SELECT {m.column}, sum(tokens) AS n FROM cells GROUP BY 1)))"
        )
        goals.append((m.column, f"goal{i}"))
    parts.append("w0 AS MATERIALIZED (SELECT *, tokens / (SELECT sum(tokens) FROM cells) AS w FROM cells)")
    at = 0
    for _ in range(rounds):
        for column, goal in goals:
            parts.append(
                f"w{at + 1} AS MATERIALIZED (SELECT a.* EXCLUDE (w), CASE WHEN h.held > 0 THEN a.w * g.goal / h.held ELSE 0 END AS w FROM w{at} a "
                f"JOIN (SELECT {column} AS v, sum(w) AS held FROM w{at} GROUP BY 1) h ON a.{column} IS NOT DISTINCT FROM h.v "
                f"JOIN {goal} g ON a.{column} IS NOT DISTINCT FROM g.value)"
            )
            at += 1
    parts.append(f"s0 AS MATERIALIZED (SELECT {keep!r} * sum(tokens) AS scale, {keep!r} * sum(tokens) AS budget FROM cells)")
    for i in range(scale_rounds):
        parts.append(
            f"s{i + 1} AS MATERIALIZED (SELECT CASE WHEN f.rest <= 1e-12 OR f.given >= s.budget THEN s.scale ELSE (s.budget - f.given) / f.rest END AS scale, s.budget "
            f"FROM s{i} s, (SELECT coalesce(sum(tokens) FILTER (tokens > 0 AND w / tokens * t.scale >= 1), 0) AS given, "
            f"coalesce(sum(w) FILTER (NOT coalesce(tokens > 0 AND w / tokens * t.scale >= 1, false)), 0) AS rest FROM w{at}, s{i} t) f)"
        )
    parts.append(f"p AS MATERIALIZED (SELECT source, lang, mix_topic, CASE WHEN tokens > 0 THEN least(1.0, w / tokens * scale) ELSE 0 END AS p FROM w{at}, s{scale_rounds})")
    draw = f"{number(f"'{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')")} / {16 ** 15}.0::DOUBLE"
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, d.source, d.lang, d.mix_topic AS topic, CAST(d.tokens AS BIGINT) AS tokens, round(q, 9) AS probability, {draw} < q AS sampled
FROM (SELECT d.*, CASE WHEN d.tokens > 0 THEN p.p ELSE 0 END AS q FROM docs d
      JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.mix_topic IS NOT DISTINCT FROM p.mix_topic) d"""


def contamination_sql(window: int = 13, part: int = 20) -> str:
    def words(text: str) -> str:
        return f"coalesce(regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{WORD_PATTERN}'), [])"

    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS w FROM documents),
items AS MATERIALIZED (SELECT item_id, w, least(len(w), {window}) AS k FROM (SELECT item_id, {words('text')} AS w FROM benchmark) WHERE len(w) > 0),
windows AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS phrase FROM (SELECT *, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS s FROM items)),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT r, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS s FROM docs, sizes WHERE len(w) >= k),
found AS MATERIALIZED (SELECT r, s, p.k, item_id FROM places p JOIN windows v ON p.k = v.k AND array_to_string(list_slice(p.w, s, s + p.k - 1), ' ') = v.phrase),
hits AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS place FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND {part} * n_hit >= len(w), false) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
STEP = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"

URL_FILTERS_SQL = f"""
WITH p AS MATERIALIZED (SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '\\.$', ''), '') AS h, coalesce(regexp_extract(url, '{STEP}', 1), '') AS s,
  CAST(DATE '2024-01-01' + CAST({number("'fetch:' || coalesce(CAST(page_id AS VARCHAR), 'null')", 8)} % 366 AS INTEGER) AS DATE) AS fetched FROM pages),
up AS MATERIALIZED (SELECT DISTINCT h, array_to_string(list_slice(l, i, len(l)), '.') AS suffix, i = greatest(len(l) - 1, 1) AS is_domain
  FROM (SELECT h, l, unnest(range(1, CAST(greatest(len(l) - 1, 1) + 1 AS BIGINT))) AS i FROM (SELECT DISTINCT h, string_split(h, '.') AS l FROM p WHERE h IS NOT NULL))),
patterns AS MATERIALIZED (SELECT h AS pattern FROM p WHERE h IS NOT NULL UNION SELECT suffix FROM up WHERE is_domain UNION SELECT h || '/' || s FROM p WHERE h IS NOT NULL AND s <> ''),
drawn AS (SELECT pattern, category, {number("concat_ws(':', pattern, category, CAST(i AS VARCHAR))", 8)} AS n FROM patterns, (VALUES ('malware'), ('spam')) c(category), range(4) t(i)),
entries AS (SELECT pattern, category, (['block', 'remove', 'block', 'allow', 'remove'])[(n // 8) % 5 + 1] AS action, CAST(DATE '2023-12-01' + CAST((n // 64) % 420 AS INTEGER) AS DATE) AS day FROM drawn WHERE n % 8 < 3),
daily AS (SELECT pattern, category, day, max(action) AS action FROM entries GROUP BY ALL),
spans AS MATERIALIZED (SELECT pattern, category, action, day AS a, lead(day) OVER (PARTITION BY pattern, category ORDER BY day) AS b FROM daily),
asked AS MATERIALIZED (SELECT DISTINCT p.h, p.s, fetched, suffix AS pattern FROM p JOIN up ON p.h = up.h UNION SELECT h, s, fetched, h || '/' || s FROM p WHERE h IS NOT NULL AND s <> ''),
met AS (SELECT h, s, fetched, q.pattern, action, string_agg(DISTINCT category, ',' ORDER BY category) AS cats FROM asked q JOIN spans i ON q.pattern = i.pattern AND fetched >= a AND (b IS NULL OR fetched < b)
  WHERE action <> 'remove' GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY h, s, fetched ORDER BY length(pattern) DESC, pattern, action = 'allow') AS rn FROM met)
SELECT page_id, p.fetched, p.h AS url_host, coalesce(action = 'block', false) AS url_blocked, pattern AS url_pattern, coalesce(cats, '') AS url_categories
FROM p LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON p.h = b.h AND p.s = b.s AND p.fetched = b.fetched"""


def collocations_sql(words: int = 4, least: int = 30, scale: int = 2_000_000, inside: int = 80, top: int = 2000) -> str:
    parts = "\nUNION ALL ".join(
        f"SELECT lang, phrase, a, {k} AS k, array_to_string(w[1:{k}], ' ') AS first, array_to_string(w[{k + 1}:], ' ') AS rest FROM candidates WHERE len(w) > {k}"
        for k in range(1, words)
    )
    slices = ", ".join(f"[w[i:i + {m - 1}] for i in range(1, CAST(greatest(len(w) - {m} + 2, 1) AS BIGINT))]" for m in range(2, words))
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
running AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM running, range(1, {words + 1}) t(n) WHERE len(w) >= n),
counts AS MATERIALIZED (SELECT lang, n, array_to_string(w[i:i + n - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f FROM places GROUP BY ALL HAVING count(*) >= {least}),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM running GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE n > 1),
cuts AS ({parts}),
scored AS (SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, ({scale}::HUGEINT * a) // (l.f + r.f) AS score FROM cuts c
  JOIN counts l ON l.lang = c.lang AND l.phrase = c.first JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored) WHERE place = 1),
inner_parts AS (SELECT lang, a, len(w) AS n, unnest(flatten([{slices}])) AS part FROM candidates),
around AS (SELECT DISTINCT p.lang, c.phrase FROM (SELECT lang, a, n, part FROM inner_parts WHERE len(part) < n) p
  JOIN counts c ON c.lang = p.lang AND c.phrase = array_to_string(p.part, ' ') AND c.n > 1 WHERE 100 * p.a >= {inside} * c.f),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM best b ANTI JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, t.n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= {top}"""


def nibble_table() -> list[int]:
    """What four bits of a reflected CRC-32 come to."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def variants_sql(every: int = 97, letters: int = 5, least: int = 3, ratio: int = 2) -> str:
    """The CRC-32 goes through the bytes four bits at a time; runs have letters of one byte, or of two that begin with C3."""
    return f"""
WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
once AS MATERIALIZED (SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM runs WHERE length(run) >= {letters} GROUP BY ALL),
points AS (SELECT doc_id, run, n, [unicode(c) for c in string_split(s, '')] AS p FROM once),
bits AS (SELECT doc_id, run, n, flatten([CASE WHEN c < 128 THEN [c & 15, c >> 4] ELSE [3, 12, (c - 64) & 15, (c - 64) >> 4] END for c in p]) AS b FROM points),
hashed AS (SELECT run, n, xor(list_reduce([CAST(x AS BIGINT) for x in b], lambda c, x: xor(c >> 4, ({nibble_table()}::BIGINT[])[(xor(c, x) & 15) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM bits),
vocabulary AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT CASE WHEN h % {every} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {letters} GROUP BY word HAVING sum(n) >= {least}),
places AS MATERIALIZED (SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
shorter AS (SELECT DISTINCT p.word, p.n, v.word AS other, v.n AS other_n FROM places p JOIN vocabulary v ON v.word = p.a || p.b),
pairs AS (SELECT * FROM shorter UNION ALL SELECT other, other_n, word, n FROM shorter
  UNION ALL SELECT p.word, p.n, q.word, q.n FROM places p JOIN places q ON p.a || '_' || p.b = q.a || '_' || q.b AND p.word <> q.word),
near AS MATERIALIZED (SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS best, max(other_n) AS best_n FROM pairs GROUP BY word, n),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {ratio} * v.n THEN best END AS form, CASE WHEN best_n >= {ratio} * v.n THEN best_n END AS form_n
  FROM vocabulary v LEFT JOIN near USING (word)),
RECURSIVE_WALK
SELECT f.word, f.form, walk.here AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM forms f JOIN walk ON walk.word = f.word AND walk.last""".replace("WITH runs", "WITH RECURSIVE runs").replace("RECURSIVE_WALK", """walk(word, here, last) AS (SELECT word, coalesce(form, word), form IS NULL FROM forms
  UNION ALL SELECT w.word, coalesce(f.form, w.here), f.form IS NULL FROM walk w JOIN forms f ON f.word = w.here WHERE NOT w.last)""")
