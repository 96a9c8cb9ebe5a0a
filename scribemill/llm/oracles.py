"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from scribemill.llm import chat, licenses, quality

ORACLES: dict[str, str] = {}

_SPACE = r"[\x20\x09-\x0D]+"

ORACLES["op1_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body,
    list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT r, count(DISTINCT p) AS n
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1)
  GROUP BY r
), bad AS (
  SELECT r, count(*) AS n, sum(length(regexp_replace(x, '{_SPACE}', '', 'g'))) AS lost
  FROM (SELECT r, x, length(x) - length(regexp_replace(x, '{quality.SYMBOLS}', '', 'g')) AS s,
          len(list_filter(string_split_regex(x, '{_SPACE}'), lambda y: y <> '')) AS n,
          2 * len(regexp_extract_all(x, '!!')) AS shouts
        FROM (SELECT r, unnest(l) AS x FROM d))
  WHERE NOT regexp_matches(x, '{quality.SENTENCE_MARKS}') OR s * 100 > length(x) * {quality.MAX_SYMBOL_PERCENT} OR shouts > n
    OR (length(x) <= 60 AND regexp_matches(x, '(?i)^\s*(?:{"|".join(quality.MENU_WORDS)})\b.{{0,20}}$'))
    OR (regexp_matches(x, '{quality.MENU_MARKS}.*{quality.MENU_MARKS}') AND n <= {quality.MAX_MENU_WORDS})
    OR regexp_matches(lower(x), '{"|".join(quality.BOILERPLATE)}')
  GROUP BY r
), q AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(body) - length(regexp_replace(body, '{quality.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(bad.n, 0)::BIGINT AS n_lines_removed, coalesce(bad.lost, 0)::BIGINT AS lost_chars
  FROM d LEFT JOIN rep USING (r) LEFT JOIN bad USING (r)
)
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words)
    AND lost_chars * 100 <= word_chars * {quality.MAX_LOST_PERCENT} AS kept
FROM q
"""

# Targets by closed form over sources in ascending order of size per weight, see mixing.source_targets.
ORACLES["op4_mixed_sources"] = rf"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> ''))::BIGINT AS size,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS symbols
  FROM documents
), keyed AS (
  SELECT *, -ln((('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)
      / (1.0::DOUBLE - 0.5::DOUBLE * least(1.0::DOUBLE, symbols::DOUBLE / greatest(size, 1)::DOUBLE)) AS key
  FROM d
), sources AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source)
), rooms AS (
  SELECT *, sum(s) OVER () AS total, row_number() OVER (ORDER BY s / w, source NULLS LAST) AS o FROM sources
), flagged AS (
  SELECT *, 3 * s * sum(w) OVER (ORDER BY o DESC) < (total - coalesce(sum(3 * s) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS capped
  FROM rooms
), targets AS (
  SELECT source, s, CASE WHEN capped THEN (3 * s)::DOUBLE
      ELSE ((total - coalesce(sum(CASE WHEN capped THEN 3 * s END) OVER (), 0)) * w)::DOUBLE / (sum(CASE WHEN NOT capped THEN w END) OVER ())::DOUBLE END AS target
  FROM flagged
), placed AS (
  SELECT k.doc_id, k.source, k.size, t.s AS source_size, t.target, CASE WHEN t.s > 0 THEN floor(t.target / t.s)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken
FROM (SELECT *, CASE WHEN size > 0 THEN epochs + ((target - (epochs * source_size)::DOUBLE - before::DOUBLE) * 2 >= size AND epochs < 3)::BIGINT ELSE 0 END AS copies
      FROM placed)
"""

ORACLES["op6_chat_snapshots"] = rf"""
WITH t AS (
  SELECT conv_id AS id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), p AS (
  SELECT *, count(*) OVER (PARTITION BY id) AS n_turns,
    md5(string_agg(coalesce('+' || role, '-') || chr(31) || coalesce('+' || text, '-'), chr(30)) OVER (PARTITION BY id ORDER BY pos)) AS prefix
  FROM t
), whole AS (
  SELECT min(id) AS id, n_turns, prefix FROM p WHERE pos = n_turns GROUP BY n_turns, prefix
), kept AS (
  SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos = w.n_turns AND p.prefix = w.prefix AND p.n_turns > w.n_turns)
)
SELECT k.id AS conv_id, k.n_turns, (p.pos - 1) // {chat.PART_TURNS} AS part,
  string_agg('{chat.OPEN}' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY p.pos) AS rendered
FROM kept k JOIN p USING (id) GROUP BY ALL
"""


def _canonical(text: str) -> str:
    form = f"regexp_replace(lower(coalesce({text}, '')), '{licenses.COPYRIGHT_LINE}', ' ', 'g')"
    for found, written in licenses.SPELLINGS:
        form = f"replace({form}, '{found}', '{written}')"
    return f"trim(regexp_replace({form}, '[^a-z0-9]+', ' ', 'g'))"


_KNOWN = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.KNOWN)

ORACLES["op8_license_digests"] = rf"""
WITH known AS (
  SELECT sha256({_canonical("t")}) AS digest, min(n) AS license FROM (VALUES {_KNOWN}) v(n, t) WHERE {_canonical("t")} <> '' GROUP BY 1
), lines AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) JOIN known ON sha256({_canonical("line")}) = digest
  WHERE trim(line) <> '' GROUP BY doc_id
)
SELECT d.doc_id, d.digest, license, coalesce(line_licenses, '') AS line_licenses, coalesce(n, 0)::BIGINT AS n_license_lines
FROM (SELECT doc_id, sha256({_canonical("text")}) AS digest FROM documents) d
LEFT JOIN known USING (digest) LEFT JOIN lines ON d.doc_id IS NOT DISTINCT FROM lines.doc_id
"""

# The crc32 of a string is formed by one join a byte; near words meet by the same string without one of their characters.
ORACLES["op11_spelling_variants"] = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), seen AS (
  SELECT run, count(*) AS c, hex(encode(id || ':' || run)) AS bytes FROM runs GROUP BY id, run
), bits AS (
  SELECT range AS place, 0 AS step, range AS v FROM range(256)
  UNION ALL SELECT place, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8
), crc AS (
  SELECT run, c, bytes, 4294967295 AS v FROM seen
  UNION ALL
  SELECT run, c, substr(bytes, 3), xor(crc.v >> 8, t.v) FROM crc JOIN (SELECT place, v FROM bits WHERE step = 8) t
    ON t.place = xor(crc.v, ('0x' || substr(bytes, 1, 2))::BIGINT) & 255
  WHERE bytes <> ''
), hashed AS (
  SELECT run, c, xor(v, 4294967295) AS h FROM crc WHERE bytes = ''
), counted AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1
), words AS MATERIALIZED (
  SELECT word, n FROM counted WHERE length(word) >= 5 AND n >= 3
), gone AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM gone a JOIN gone b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gone a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gone a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, encode(other))) AS other FROM near GROUP BY word
), summary AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root FROM summary
  UNION ALL SELECT chain.word, s.form FROM chain JOIN summary s ON s.word = chain.root WHERE s.form IS NOT NULL
)
SELECT s.word, s.form, c.root, s.n, s.n_near::BIGINT AS n_near, s.form_n
FROM summary s JOIN (SELECT chain.word, chain.root FROM chain JOIN summary e ON e.word = chain.root WHERE e.form IS NULL) c USING (word)
"""


def _rounds(rounds: int) -> str:
    """Each round: distances to all centroids, the nearest, and the floor of each component's mean."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (
  SELECT rn, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d
  FROM (SELECT rn, cluster, sum((x.val - c.val) * (x.val - c.val))::BIGINT AS d FROM x JOIN c{i} c USING (pos) GROUP BY rn, cluster) GROUP BY rn
)""")
        if i < rounds:
            out.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, c.pos, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.val)::BIGINT AS val
  FROM c{i} c LEFT JOIN (SELECT cluster, pos, sum(val)::BIGINT AS s, count(*) AS n FROM a{i} JOIN x USING (rn) GROUP BY cluster, pos) m USING (cluster, pos)
)""")
    return ",\n".join(out)


ORACLES["op12_laesa_clusters"] = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0
), x AS MATERIALIZED (
  SELECT rn, unnest(range(64)) AS pos, unnest(list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT)) AS val FROM v
), c0 AS MATERIALIZED (
  SELECT cluster, pos, val FROM x JOIN (SELECT rn, (row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1)::INT AS cluster FROM v) USING (rn)
  WHERE cluster < 8
),
{_rounds(10)}
SELECT vec_id, cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a10 JOIN v USING (rn) JOIN (SELECT cluster, sha256(string_agg(val::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c10 GROUP BY cluster) USING (cluster)
"""

ORACLES["op13_web_archives"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest
  FROM pages
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 1000 OR page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM p
"""
