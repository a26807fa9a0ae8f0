"""SQL fragments that several twins share; DuckDB's dialect."""

SPACE = r"[\p{Z}\t\n\x0B\f\r\x1C-\x1F\x{85}]"
TRIMMED = rf"regexp_replace(regexp_replace(%s, '^{SPACE}+', ''), '{SPACE}+$', '')"
LINES = rf"""
lines AS (
  SELECT doc_id AS file_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {TRIMMED % 'x'} <> '') AS parts FROM documents
), chunks AS (
  SELECT file_id, (i - 1)::INT AS chunk_index, parts[i] AS text FROM (SELECT file_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM lines)
), hashed AS (
  SELECT *, sha256(lower(trim(regexp_replace({TRIMMED % 'text'}, '{SPACE}+', ' ', 'g')))) AS body_hash FROM chunks
), bodies AS (
  SELECT body_hash, count(DISTINCT file_id) AS doc_count FROM hashed GROUP BY body_hash
)"""
TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
JOBS = """
jobs AS (
  SELECT event_id AS job_id, user_id AS file_id,
    CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'PROCESSING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'EXCLUDED' END AS status,
    floor(epoch(ts))::BIGINT AS created_at, (props::JSON->>'k')::BIGINT AS k, value
  FROM events
)"""
MENTIONS = "mentions AS (SELECT l_orderkey AS chunk_id, l_partkey AS entity_id, 1 - 5 * l_discount AS score FROM lineitem)"
DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
