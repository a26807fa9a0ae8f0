"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from corpusforge.llm.bpe import op1_byte_bpe
from corpusforge.llm.decontam import op9_decontaminate
from corpusforge.llm.fingerprints import op4_fingerprints
from corpusforge.llm.licenses import op2_license_scan
from corpusforge.llm.lexical import op13_lexical_search
from corpusforge.llm.neardup import op6_near_duplicates
from corpusforge.llm.pairbpe import op12_pair_bpe
from corpusforge.llm.secrets import op7_secret_ledger
from corpusforge.llm.tokenbin import op8_token_binary
from corpusforge.llm.tokencount import op10_token_counts
from corpusforge.llm.toxicity import op3_toxicity
from corpusforge.llm.vectorcodes import op11_vector_codes, vector_codes_sql
from corpusforge.llm.warczip import op5_warc_zip

QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_license_scan, op3_toxicity, op4_fingerprints, op5_warc_zip, op6_near_duplicates, op7_secret_ledger, op8_token_binary, op9_decontaminate, op10_token_counts, op11_vector_codes, op12_pair_bpe, op13_lexical_search)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM words
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT words.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, words.doc_id = component_id AS kept
FROM words LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""

_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = rf"""
WITH words AS (
  SELECT doc_id, {_ALNUM} AS w FROM documents
), items AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)
), places AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), hits AS (
  SELECT doc_id, i, k, item_id FROM places JOIN windows USING (k, win)
), marked AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN marked USING (doc_id) LEFT JOIN found USING (doc_id)
"""

WARC_SQL = """
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(d, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
"""

LEXICAL_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents
), size AS (
  SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_words FROM docs WHERE len(w) > 0
), tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM docs) GROUP BY ALL
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), gains AS (
  SELECT r, doc_id, term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words))) AS g
  FROM tf JOIN df USING (term), size
), terms AS (
  SELECT DISTINCT item_id, unnest({_ALNUM}) AS term FROM benchmark
), scores AS (
  SELECT item_id, r, doc_id, sum(g)::BIGINT AS score FROM terms JOIN gains USING (term) GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""

ORACLE_SQL: dict[str, str] = {
    "op5_warc_zip": WARC_SQL,
    "op6_near_duplicates": NEAR_DUPLICATES_SQL,
    "op9_decontaminate": DECONTAMINATION_SQL,
    "op11_vector_codes": vector_codes_sql(),
    "op13_lexical_search": LEXICAL_SQL,
}
