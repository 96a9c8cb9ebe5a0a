"""DuckDB SQL that computes the registered queries over the same tables."""

from __future__ import annotations

SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def key(x: str) -> str:
    return f"regexp_replace(trim(regexp_replace(lower({x}), '[^a-z0-9 ]', '', 'g')), '\\s+', ' ', 'g')"


def no_note(x: str, note: str) -> str:
    return f"regexp_replace({x}, '\\[{note}\\]', '', 'gi')"


NOTED = """CASE doc_id % 4
  WHEN 0 THEN ' [Applause]  ' || chr(9) || text || repeat(chr(10), 4) || '[LAUGHTER]' || chr(10)
  WHEN 1 THEN '[laugh[applause]ter] ' || text || chr(10) || ' ' || repeat(chr(10), 3) || '[CrossTalk]'
  WHEN 2 THEN '[app[laughter]lause]' || chr(9) || chr(9) || text || chr(28)
  ELSE text END"""
CLEANED = strip(
    "regexp_replace(regexp_replace("
    + no_note(no_note(no_note(NOTED, "applause"), "laughter"), "crosstalk")
    + ", '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')"
)
MATCHES = " OR ".join(
    [f"contains(lo, '{p}')" for p in ("the ", "de la", "und ")] + [f"starts_with(lo, '{p}')" for p in ("in ", "que ")]
)
TWO_SOURCES = f"""both_sources AS (
  SELECT *, source = 'primary' OR ({MATCHES}) AS accepted FROM (
    SELECT doc_id, left(text, 40) AS title, {strip("lower(left(text, 40))")} AS lo,
      CASE WHEN lang = 'en' THEN 'primary' ELSE 'archive' END AS source FROM documents))"""
EXCHANGES = """exchanges AS (
  SELECT q.conv_id, q.turn, q.text AS instruction, a.text AS output
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant')"""
PARSED = (
    EXCHANGES
    + """, parsed AS (
  SELECT *, CASE conv_id % 6 WHEN 2 THEN 'bad_json' WHEN 3 THEN 'not_list' WHEN 4 THEN 'service_error'
      WHEN 5 THEN 'bad_element' ELSE 'ok' END AS status,
    conv_id % 6 IN (0, 1, 5) AS has_pair,
    CASE WHEN conv_id % 6 IN (2, 4) THEN 0 ELSE length(instruction) END AS input_tokens,
    CASE WHEN conv_id % 6 IN (2, 4) THEN 0 ELSE length(output) END AS output_tokens
  FROM exchanges)"""
)
PUTS = """puts AS (
  SELECT 'job-' || user_id AS job_id, strftime(ts, '%Y-%m-%d') AS "timestamp", event_type AS status,
    CASE WHEN event_type = 'view' THEN value END AS view_value,
    CASE WHEN event_type <> 'view' THEN value END AS other_value,
    row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d')
      ORDER BY event_type <> 'view' DESC, event_id DESC) AS r
  FROM events)"""
UPSERT = f"WITH {PUTS} SELECT * EXCLUDE (r) FROM puts WHERE r = 1"
TOKENS = """sized AS (
  SELECT doc_id, len(regexp_extract_all(text, '[^SPACE]+')) + 1 AS n FROM documents),
placed AS (
  SELECT doc_id, n, CAST(sum(n) OVER (ORDER BY doc_id) AS BIGINT) - n AS start FROM sized),
slices AS (
  SELECT block, doc_id, greatest(block * 2048 - start, 0) AS lo, least((block + 1) * 2048 - start, n) AS hi
  FROM (SELECT *, unnest(range(start // 2048, (start + n - 1) // 2048 + 1)) AS block FROM placed))""".replace(
    "[^SPACE]", "[^" + SPACE[1:-1] + "]"
)
LOG = f"""log AS (
  SELECT doc_id AS request_id,
    TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(doc_id * 100000) AS ts,
    CASE WHEN doc_id % 9 = 0 THEN '10.0.0.' || (doc_id % 5) ELSE source END AS caller,
    doc_id % 17 <> 0 AS authorized,
    CASE WHEN doc_id % 11 = 0 THEN ' [INST] </s> [/inst]' WHEN doc_id % 13 = 0 THEN ''
      WHEN doc_id % 7 = 0 THEN '<S>[INST] ' || text || ' [/INST]</s>' ELSE text END AS question,
    CASE WHEN doc_id % 5 = 0 THEN 512 WHEN doc_id % 19 = 0 THEN 5000 ELSE 100 END AS max_tokens,
    CAST(CASE WHEN doc_id % 3 = 0 THEN 0.7 WHEN doc_id % 23 = 0 THEN 3.0 ELSE 1.5 END AS DOUBLE) AS temperature,
    CASE WHEN doc_id % 29 = 0 THEN 503 WHEN doc_id % 31 = 0 THEN 429 WHEN doc_id % 37 = 0 THEN 500 ELSE 200 END AS answered
  FROM documents),
checked AS (
  SELECT *, {strip("regexp_replace(question, '\\[/?INST\\]|</?s>', '', 'gi')")} AS clean_question,
    CASE WHEN length(question) < 1 THEN 'question empty' WHEN length(question) > 4000 THEN 'question too long'
      WHEN max_tokens > 4096 THEN 'max_tokens out of range'
      WHEN temperature > 2.0 THEN 'temperature out of range' END AS reason FROM log),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY caller, date_trunc('minute', ts), authorized AND reason IS NULL
    ORDER BY ts, request_id) AS nth FROM checked),
verdicts AS (
  SELECT *, CASE WHEN NOT authorized THEN 401 WHEN reason IS NOT NULL THEN 422 WHEN nth > 10 THEN 429
    WHEN clean_question = '' THEN 400 ELSE answered END AS status FROM numbered)"""
FIRST_END = """ends AS (
  SELECT user_id AS job_id, event_type AS status, ts AS ended_at, event_id, props, value FROM events
  WHERE event_type IN ('error', 'purchase', 'signup')
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1),
counted AS (
  SELECT e.user_id AS job_id, count(*) AS polls FROM events e LEFT JOIN ends n ON n.job_id = e.user_id
  WHERE n.ended_at IS NULL OR (e.ts, e.event_id) <= (n.ended_at, n.event_id) GROUP BY ALL)"""
ERROR = "CASE WHEN status = 'error' THEN CASE WHEN value > 20 THEN props ELSE 'Unknown' END END AS error"
ANSWERS = "SELECT conv_id AS request_id, turn AS seq, text FROM conversations WHERE role <> 'system'"
ANSWER_TOKENS = f"SELECT request_id, 2 * seq + 1 AS chunk, text AS token FROM ({ANSWERS})"
ANCHORED = """WITH RECURSIVE anchors AS (
  SELECT user_id, min(ts) AS a FROM events GROUP BY user_id
  UNION ALL
  SELECT e.user_id, min(e.ts) FROM anchors n JOIN events e
    ON e.user_id = n.user_id AND e.ts >= n.a + INTERVAL 1 DAY GROUP BY e.user_id)
SELECT caller, request_id,
  row_number() OVER (PARTITION BY caller, a ORDER BY ts, request_id) <= 2 AS admitted
FROM (SELECT e.user_id AS caller, e.event_id AS request_id, e.ts, n.a
  FROM events e ASOF JOIN anchors n ON e.user_id = n.user_id AND e.ts >= n.a)"""
LISTED = """listed AS (
  SELECT doc_id, lang, source AS date, text, left(text, 40) AS raw_title, doc_id // 100 AS page_no,
    CAST(row_number() OVER (PARTITION BY lang = 'en', doc_id // 100 ORDER BY doc_id) - 1 AS INTEGER) AS row_no
  FROM documents)"""
# An ampersand entity counts without its semicolon too, as in HTML.
UNESCAPE = (
    "regexp_replace(replace(replace(replace(replace(replace({0}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'),"
    " '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"
)

ORACLES: dict[str, str] = {
    "corpus_clean": f"""
SELECT doc_id, source,
  CASE WHEN length(t) > 6000 THEN left(t, 6000) || chr(10) || chr(10) || '[truncated]' ELSE t END AS text
FROM (SELECT doc_id, source, {CLEANED} AS t FROM documents WHERE length(text) >= 200
  QUALIFY row_number() OVER (PARTITION BY {key("left(text, 40)")} ORDER BY doc_id) = 1)""",
    "title_dedup": f"""
SELECT doc_id, {key("left(text, 40)")} AS title_key FROM documents
QUALIFY row_number() OVER (PARTITION BY {key("left(text, 40)")} ORDER BY doc_id) = 1""",
    "source_counts": f"""
WITH {TWO_SOURCES} SELECT source, count(*) AS found, count(*) FILTER (NOT accepted) AS skipped
FROM both_sources GROUP BY source""",
    "corpus_totals": f"""
WITH {TWO_SOURCES} SELECT count(*) AS raw_total, count(DISTINCT {key("title")}) AS unique_total
FROM both_sources WHERE accepted""",
    "union_order": f"""
WITH {TWO_SOURCES} SELECT source, doc_id,
  row_number() OVER (ORDER BY source = 'archive', doc_id) - 1 AS position FROM both_sources WHERE accepted""",
    "exact_sample": "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 150",
    "exact_sample_by_bound": "SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 150",
    "dense_positions": """
SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents WHERE length(text) >= 200""",
    "dense_positions_by_columns": """
SELECT lang, source, doc_id, row_number() OVER (ORDER BY lang, source, doc_id) - 1 AS position FROM documents""",
    "document_report": """
SELECT row_number() OVER (ORDER BY doc_id) AS position, count(*) OVER () AS total,
  CAST(len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 200)) AS INTEGER) AS n_pairs,
  left(text, 60) AS title FROM documents""",
    "page_links": f"""
SELECT page_id, CAST(row_no AS INTEGER) AS row_no, 'https://site.example' || {UNESCAPE.format("href")} AS url,
  trim({UNESCAPE.format("label")}) AS title, '' AS date
FROM (SELECT page_id, unnest(regexp_extract_all(nav, '<a href="([^"]*)"', 1)) AS href,
    unnest(regexp_extract_all(nav, '<a href="[^"]*">([^<]*)<', 1)) AS label,
    unnest(range(len(regexp_extract_all(nav, '<a href=')))) AS row_no
  FROM (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages))""",
    "page_body": f"""
SELECT page_id, url, text FROM (
  SELECT page_id, url, array_to_string(list_filter(list_transform(
      regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>'),
      lambda x: {strip(UNESCAPE.format("x"))}), lambda x: x <> ''), chr(10)) AS text FROM pages)
WHERE length(text) >= 200""",
    "page_cutoff": """
WITH numbered AS (SELECT doc_id % 20 AS source, doc_id // 20 AS page_no, doc_id, length(text) >= 200 AS good FROM documents),
stops AS (SELECT source, coalesce(min(page_no) FILTER (NOT good), max(page_no) + 1) AS stop FROM numbered GROUP BY source)
SELECT n.source, n.page_no, n.doc_id FROM numbered n JOIN stops s ON s.source = n.source AND n.page_no < s.stop""",
    "listing_table": f"""
WITH {LISTED} SELECT page_no, row_no, 'https://site.example/d/' || doc_id AS url, {strip("raw_title")} AS title, date
FROM listed WHERE lang = 'en'""",
    "listing_cards": f"""
WITH {LISTED} SELECT page_no, row_no, 'https://site.example/d/' || doc_id AS url, {strip("raw_title")} AS title, date
FROM listed WHERE lang <> 'en'""",
    "lookup_join": """
SELECT event_id, '/d/' || user_id AS url, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5
FROM events JOIN documents ON doc_id = user_id WHERE length(text) >= 200""",
    "corpus_build": f"""
WITH {LISTED}, records AS (
  SELECT *, CASE WHEN lang = 'en' THEN 'primary' ELSE 'archive' END AS site, {strip("raw_title")} AS title,
    {strip("text")} AS body, {strip("lower(raw_title)")} AS lo FROM listed)
SELECT row_number() OVER (ORDER BY site = 'archive', doc_id) - 1 AS position, title, date, site AS source,
  'https://site.example/d/' || doc_id AS url, md5(body) AS text_md5
FROM (SELECT * FROM records WHERE length(body) >= 200 AND (site = 'primary' OR {MATCHES})
  QUALIFY row_number() OVER (PARTITION BY {key("title")} ORDER BY site = 'archive', doc_id) = 1)""",
    "jsonl_scan": """
SELECT left(text, 40) AS title, CAST(NULL AS VARCHAR) AS date, source, CAST(doc_id AS VARCHAR) AS url, text FROM documents""",
    "jsonl_ordered": "SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents",
    "numbered_files": f"""
SELECT doc_id, source, CASE WHEN p < 100000 THEN lpad(CAST(p AS VARCHAR), 5, '0') ELSE CAST(p AS VARCHAR) END AS file_id
FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM (
  SELECT doc_id, source FROM documents
  QUALIFY row_number() OVER (PARTITION BY {key("left(text, 40)")} ORDER BY doc_id) = 1))""",
    "pair_files": f"""
WITH {PARSED}, placed AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS p FROM parsed)
SELECT CASE WHEN p < 100000 THEN lpad(CAST(p AS VARCHAR), 5, '0') ELSE CAST(p AS VARCHAR) END AS file_id,
  0 AS pair_no, instruction, '' AS input, output FROM placed WHERE has_pair""",
    "record_table": UPSERT,
    "record_upsert": UPSERT,
    "prompts": """
SELECT doc_id, 'Title: ' || CASE WHEN doc_id % 3 <> 0 THEN left(text, 40) ELSE 'Unknown' END || chr(10)
  || 'Date: ' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'Unknown' END || chr(10) || chr(10)
  || CASE WHEN length(text) > 6000 THEN left(text, 6000) || chr(10) || chr(10) || '[truncated]' ELSE text END
  || chr(10) || chr(10) || 'Answer with a JSON array.' || chr(10) AS prompt FROM documents""",
    "qa_pairs": f"""
WITH {PARSED} SELECT conv_id, turn, 0 AS pair_no, instruction, '' AS input, output FROM parsed WHERE has_pair""",
    "pair_status": f"""
WITH {PARSED} SELECT status, count(*) AS responses, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM parsed GROUP BY status""",
    "token_cost": f"""
WITH {PARSED} SELECT documents, total_pairs, input_tokens, output_tokens,
  input_tokens * CAST(3 AS DOUBLE) / 1e6 + output_tokens * CAST(15 AS DOUBLE) / 1e6 AS cost
FROM (SELECT count(*) AS documents, count(*) FILTER (has_pair) AS total_pairs,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM parsed)""",
    "token_progress": """
SELECT *, input_tokens * CAST(3 AS DOUBLE) / 1e6 + output_tokens * CAST(15 AS DOUBLE) / 1e6 AS cost
FROM (SELECT row_number() OVER w AS position, CAST(sum(length(text)) OVER w AS BIGINT) AS input_tokens,
    CAST(sum(length(text) // 4) OVER w AS BIGINT) AS output_tokens FROM documents WINDOW w AS (ORDER BY doc_id))
WHERE position % 100 = 0""",
    "generated_pairs": f"""
WITH cleaned AS (
  SELECT doc_id, lang, left(text, 40) AS title,
    {strip("regexp_replace(regexp_replace(" + no_note(no_note(no_note("text", "applause"), "laughter"), "crosstalk") + ", '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')")} AS t
  FROM documents),
asked AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, 'Title: ' || title || chr(10) || 'Date: ' || lang || chr(10) || chr(10)
    || CASE WHEN length(t) > 6000 THEN left(t, 6000) || chr(10) || chr(10) || '[truncated]' ELSE t END
    || chr(10) || chr(10) || 'Answer with a JSON array.' || chr(10) AS prompt FROM cleaned)
SELECT position, 0 AS pair_no, md5(prompt) AS instruction, '' AS input, CAST(length(prompt) AS VARCHAR) AS output FROM asked""",
    "stored_responses": f"""
WITH {PARSED} SELECT conv_id * 4294967296 + turn AS doc_id, status, CAST(has_pair AS INTEGER) AS n_pairs
FROM parsed""",
    "training_set": f"""
WITH {PARSED} SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS position, '<s>[INST] ' || instruction || ' [/INST] ' || output || '</s>' AS text
FROM parsed WHERE has_pair""",
    "sampled_files": """
SELECT s_suppkey, s_name FROM supplier
ORDER BY md5('42:' || CASE WHEN s_suppkey < 100000 THEN lpad(CAST(s_suppkey AS VARCHAR), 5, '0') ELSE CAST(s_suppkey AS VARCHAR) END || '.jsonl') LIMIT 40""",
    "chat_text": f"""
WITH {EXCHANGES} SELECT conv_id, turn, '<s>[INST] ' || instruction || ' [/INST] ' || output || '</s>' AS text FROM exchanges""",
    "packed_slices": f"WITH {TOKENS} SELECT block, doc_id, lo, hi FROM slices",
    "packed_blocks": f"""
WITH {TOKENS}, words AS (
  SELECT doc_id, list_append(regexp_extract_all(text, '[^{SPACE[1:-1]}]+'), '</s>') AS t FROM documents)
SELECT block, CAST(sum(hi - lo) AS INTEGER) AS n_tokens,
  md5(string_agg(array_to_string(t[lo + 1 : hi], ' '), ' ' ORDER BY s.doc_id)) AS content_md5
FROM slices s JOIN words w ON w.doc_id = s.doc_id GROUP BY block""",
    "readiness": f"""
WITH {EXCHANGES} SELECT pairs, CASE WHEN pairs <= 12 THEN 'too few' WHEN pairs < 500 THEN 'below the wanted size'
  WHEN pairs < 1000 THEN 'enough' WHEN pairs <= 10000 THEN 'comfortable' ELSE 'diminishing returns' END AS verdict
FROM (SELECT count(*) AS pairs FROM exchanges)""",
    "metric_columns": "SELECT user_id AS job_id, "
    + ", ".join(
        f"arg_max(value, event_id) FILTER (event_type = '{t}') AS train_{t}"
        for t in ("click", "error", "purchase", "signup", "view")
    )
    + " FROM events GROUP BY user_id",
    "job_records": """
SELECT 'job-' || event_id AS job_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp",
  CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'Failed' ELSE 'Unknown' END AS status,
  CASE WHEN event_type = 'purchase' THEN props END AS model_artifact,
  CAST(CASE WHEN event_type = 'purchase' THEN k + 1 ELSE value END AS VARCHAR) AS train_loss,
  CAST(k AS VARCHAR) AS eval_k, 2 AS n_metrics, 'status' AS rejected
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""",
    "registry_records": """
SELECT 'bedrock-import-m' || user_id AS job_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp", 'Completed' AS status,
  props AS bedrock_model_arn, 'm' || user_id AS model_name FROM events WHERE event_type = 'purchase'""",
    "first_terminal": f"""
WITH {FIRST_END} SELECT c.job_id, coalesce(status, 'Running') AS status, ended_at, polls, {ERROR}
FROM counted c LEFT JOIN ends n ON n.job_id = c.job_id""",
    "first_import_end": """
WITH p AS (
  SELECT user_id AS job_id, ts, CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'Failed' ELSE 'InProgress' END AS status,
    CASE WHEN value > 20 THEN props END AS reason, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT job_id, min(n) AS stop FROM p WHERE status <> 'InProgress' GROUP BY job_id)
SELECT job_id, coalesce(max(status) FILTER (n = stop), 'Running') AS status, max(ts) FILTER (n = stop) AS ended_at,
  count(*) FILTER (stop IS NULL OR n <= stop) AS polls, max(coalesce(reason, 'Unknown')) FILTER (n = stop AND status = 'Failed') AS error
FROM p LEFT JOIN f USING (job_id) GROUP BY job_id""",
    "job_registry": """
WITH j AS (
  SELECT *, date_trunc('day', ts) AS day, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
    row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_type <> 'view' DESC, event_id DESC) AS r FROM events),
m AS (
  SELECT *, date_trunc('day', ts) AS day, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id DESC) AS r
  FROM events WHERE event_type = 'purchase')
SELECT 'job-' || user_id AS job_id, strftime(day, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp",
  CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'Failed' ELSE 'Unknown' END AS status,
  CASE WHEN event_type = 'purchase' THEN props END AS model_artifact, NULL AS bedrock_model_arn, NULL AS model_name,
  CAST(CASE WHEN event_type = 'purchase' THEN k + 1 ELSE value END AS VARCHAR) AS train_loss
FROM j WHERE r = 1
UNION ALL
SELECT 'bedrock-import-m' || user_id, strftime(day, '%Y-%m-%dT%H:%M:%SZ'), 'Completed', NULL, props, 'm' || user_id, NULL
FROM m WHERE r = 1""",
    "latest_completed": """
SELECT user_id AS model_name, arg_max(event_id || '-' || props, ts) AS model_artifact, max(ts) AS "timestamp"
FROM events WHERE event_type = 'purchase' GROUP BY user_id""",
    "request_verdicts": f"""
WITH {LOG} SELECT request_id, caller, CAST(length(clean_question) AS INTEGER) AS clean_chars, reason, status FROM verdicts""",
    "outcome_report": f"""
WITH {LOG} SELECT status, count(*) AS requests, CASE WHEN status = 401 THEN 'sign_in' WHEN status = 503 THEN 'warming'
  WHEN status = 200 THEN 'answer' ELSE 'error' END AS client FROM verdicts GROUP BY status""",
    "request_payload": f"WITH {LOG} SELECT request_id, md5(question) AS question_md5, max_tokens, temperature FROM log",
    "rate_limit": """
SELECT user_id AS caller, event_id AS request_id,
  row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 AS admitted FROM events""",
    "rate_limit_anchored": ANCHORED,
    "answer_lines": f"""
SELECT request_id, seq, text AS token FROM ({ANSWERS})
UNION ALL SELECT conv_id, max(turn) + 1, '[DONE]' FROM conversations GROUP BY conv_id""",
    "answer_tokens": ANSWER_TOKENS,
    "answer_texts": """
SELECT conv_id AS request_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role <> 'system'), '') AS text
FROM conversations GROUP BY conv_id""",
    "rate_limit_stream": ANCHORED,
    "first_terminal_stream": f"""
WITH {FIRST_END} SELECT n.job_id, status, ended_at, polls, {ERROR} FROM ends n JOIN counted c ON n.job_id = c.job_id""",
    "answer_tokens_stream": ANSWER_TOKENS,
    "answer_bytes": """
SELECT conv_id AS request_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role <> 'system'), '') AS text
FROM conversations GROUP BY conv_id""",
    "answer_bytes_stream": """
SELECT conv_id AS request_id, text AS token FROM conversations WHERE role <> 'system' AND length(text) > 0""",
}
ORACLES["resumed_pairs"] = ORACLES["generated_pairs"]
