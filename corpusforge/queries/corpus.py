"""Bodies, boilerplate, quality, entities and redundancy over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions import text
from corpusforge.operators import curation, entities, nearest
from corpusforge.plans.projections import Tables
from corpusforge.queries.registry import query
from corpusforge.queries.shared import DOT, LINES, TOKENS
from corpusforge.sources import files

RATIO, MIN_DOCS = 0.02, 5
#: No two of the driver's embeddings are as alike as the default, 0.96.
DENSE = 0.40


def bodies(t: Tables):
    return curation.body_provenance(t.chunks())


def total(t: Tables):
    return t.read("documents").agg(F.count_distinct("doc_id").alias("total"))


@query(f"WITH {LINES} SELECT * FROM bodies")
def body_hash_df(t: Tables):
    """In how many documents each line stands."""
    return bodies(t)


@query(f"WITH {LINES} SELECT * FROM bodies, (SELECT count(DISTINCT doc_id) AS n FROM documents) WHERE doc_count >= {MIN_DOCS} AND doc_count / n >= {RATIO}".replace("SELECT * FROM bodies,", "SELECT body_hash, doc_count FROM bodies,"))
def boilerplate_bodies(t: Tables):
    return curation.boilerplate(bodies(t), total(t), RATIO, MIN_DOCS)


@query(f"WITH {LINES} SELECT max(n) AS total_documents, count(*) AS distinct_contents, count(*) FILTER (doc_count >= {MIN_DOCS} AND doc_count / n >= {RATIO}) AS boilerplate_contents, max(doc_count) AS max_doc_count FROM bodies, (SELECT count(DISTINCT doc_id) AS n FROM documents)")
def curation_stats(t: Tables):
    return curation.curation_stats(t.chunks(), total(t), RATIO, MIN_DOCS)


@query(f"WITH {LINES} SELECT doc_count, count(*) AS n FROM bodies GROUP BY doc_count")
def df_distribution(t: Tables):
    return bodies(t).groupBy("doc_count").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT ratio::DOUBLE AS ratio, count(body_hash) AS survivors FROM (VALUES (0.001), (0.01), (0.05), (0.5)) AS r(ratio) LEFT JOIN (SELECT body_hash, doc_count / n AS share FROM bodies, (SELECT count(DISTINCT doc_id) AS n FROM documents)) ON share < ratio GROUP BY ratio")
def survivors_by_ratio(t: Tables):
    """How many bodies stay below several boilerplate ratios, in one pass."""
    ratios = (0.001, 0.01, 0.05, 0.5)
    share = bodies(t).join(F.broadcast(total(t))).select((F.col("doc_count") / F.col("total")).alias("share"))  # one row
    counts = share.agg(*[F.count_if(F.col("share") < r).alias(str(i)) for i, r in enumerate(ratios)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(str(i)).alias("survivors")) for i, r in enumerate(ratios)])).alias("x")).select("x.*")


SIGNALS = r"""
words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+') AS w FROM documents
), counts AS (
  SELECT doc_id, text, w, length(text)::BIGINT AS n_chars, len(w)::BIGINT AS n_words,
    len(regexp_extract_all(text, '\p{L}')) AS alpha,
    len(regexp_extract_all(text, '[aeiouAEIOUàèéìòùáéíóúâêîôûäëïöüãõyY]')) AS vowels,
    len(regexp_extract_all(text, '[^\p{L}\p{N}\p{Z}\t\n\x0B\f\r\x1C-\x1F\x{85}]')) AS symbols,
    list_filter(w, lambda x: regexp_matches(x, '\p{L}')) AS aw,
    len(list_distinct(list_transform(w, lambda x: lower(x)))) AS uniq
  FROM words
), signals AS (
  SELECT doc_id, text, n_chars, n_words, len(aw)::BIGINT AS n_alpha_words,
    CASE WHEN n_chars > 0 THEN alpha / n_chars ELSE 0.0 END::DOUBLE AS alpha_ratio,
    CASE WHEN alpha > 0 THEN vowels / alpha ELSE 0.0 END::DOUBLE AS vowel_ratio,
    CASE WHEN n_chars > 0 THEN symbols / n_chars ELSE 0.0 END::DOUBLE AS symbol_ratio,
    CASE WHEN len(aw) > 0 THEN len(list_filter(aw, lambda x: length(x) BETWEEN 2 AND 30 AND regexp_matches(x, '[aeiouAEIOUàèéìòùáéíóúâêîôûäëïöüãõyY]'))) / len(aw) ELSE 0.0 END::DOUBLE AS wordlike_ratio,
    CASE WHEN n_words > 0 THEN uniq / n_words ELSE 0.0 END::DOUBLE AS unique_ratio
  FROM counts
), scored AS (
  SELECT doc_id,
    CASE WHEN trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) = '' THEN 0.0 ELSE round(greatest(0.0, 1.0
      - CASE WHEN alpha_ratio > 0.2 AND vowel_ratio < 0.15 THEN 0.5 ELSE 0 END
      - CASE WHEN n_alpha_words >= 3 AND wordlike_ratio < 0.5 THEN 0.3 ELSE 0 END
      - CASE WHEN n_words < 4 THEN 0.15 ELSE 0 END
      - CASE WHEN symbol_ratio > 0.5 THEN 0.2 ELSE 0 END
      - CASE WHEN n_words >= 20 AND unique_ratio < 0.25 THEN 0.2 ELSE 0 END), 3) END::DOUBLE AS quality_score,
    CASE WHEN trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) = '' THEN 'empty' ELSE concat_ws(',',
      CASE WHEN alpha_ratio > 0.2 AND vowel_ratio < 0.15 THEN 'gibberish' END,
      CASE WHEN n_alpha_words >= 3 AND wordlike_ratio < 0.5 THEN 'non_word' END,
      CASE WHEN n_words < 4 THEN 'short' END,
      CASE WHEN symbol_ratio > 0.5 THEN 'symbol_heavy' END,
      CASE WHEN n_words >= 20 AND unique_ratio < 0.25 THEN 'repetitive' END) END AS flags
  FROM signals
)"""


def scored_of(docs):
    # materialised once: the flags and the score read the same signals
    rows = docs.select("doc_id", "text", text.quality_signals("text").alias("s"))
    return rows.withColumn("q", text.quality("text", "s"))


def scored(t: Tables):
    return scored_of(t.read("documents"))


@query(f"WITH {SIGNALS} SELECT doc_id, n_chars, n_words, n_alpha_words, round(alpha_ratio, 6) AS alpha_ratio, round(vowel_ratio, 6) AS vowel_ratio, round(symbol_ratio, 6) AS symbol_ratio, round(wordlike_ratio, 6) AS wordlike_ratio, round(unique_ratio, 6) AS unique_ratio FROM signals")
def quality_signals(t: Tables):
    rows = t.read("documents").select("doc_id", text.quality_signals("text").alias("s"))
    share = lambda c, name: F.round(F.col(f"s.{c}"), 6).alias(name)
    return rows.select("doc_id", "s.n_chars", "s.n_words", "s.n_alpha_words", share("alpha_ratio", "alpha_ratio"), share("vowel_ratio_in_alpha", "vowel_ratio"), share("symbol_ratio", "symbol_ratio"), share("wordlike_ratio", "wordlike_ratio"), share("unique_ratio", "unique_ratio"))


@query(f"WITH {SIGNALS} SELECT * FROM scored")
def quality_score(t: Tables):
    return scored(t).select("doc_id", "q.quality_score", F.array_join("q.quality_flags", ",").alias("flags"))


@query(f"WITH {SIGNALS} SELECT quality, count(*) AS n, round(avg(quality_score), 6) AS mean_score, count(*) FILTER (quality_score < 1) AS flagged FROM scored JOIN labels USING (doc_id) GROUP BY quality")
def quality_vs_labels(t: Tables):
    """The heuristic score against the labelled quality."""
    joined = scored(t).select("doc_id", "q.quality_score").join(t.read("labels"), "doc_id")
    return joined.groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("mean_score"), F.count_if(F.col("quality_score") < 1).alias("flagged"))


@query(f"WITH {SIGNALS}, kept AS (SELECT source, doc_id, quality_score, max(quality_score >= 0.9) OVER (PARTITION BY source) AS any_kept FROM scored JOIN documents USING (doc_id)) SELECT source, doc_id, quality_score FROM kept WHERE quality_score >= 0.9 OR NOT any_kept")
def quality_filter_failsafe(t: Tables):
    """Each source without its low-quality documents, unless that leaves it empty."""
    from corpusforge.operators.search import suppress_low_quality

    rows = scored(t).select("doc_id", "q.quality_score").join(t.read("documents").select("doc_id", "source"), "doc_id")
    return suppress_low_quality(rows, 0.9, ["source"]).select("source", "doc_id", "quality_score")


def entity_rows(t: Tables, kind: str):
    docs = t.read("documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return entities.extract_entities(docs, kinds=[kind]).select(F.col("chunk_id").alias("doc_id"), "normalized_name")


@query(r"""SELECT DISTINCT doc_id, lower(m) AS normalized_name FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_.+-])([\p{L}\p{N}_][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]*[\p{L}\p{N}_])', 1)) AS m FROM documents)""")
def regex_email(t: Tables):
    return entity_rows(t, "email")


@query(r"""SELECT DISTINCT doc_id, regexp_replace(m, '[\s\p{Z}]+', '', 'g') AS normalized_name FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])(\d{1,3}(?:[.,]\d+)?[\s\p{Z}]?%)', 1)) AS m FROM documents)""")
def regex_percent(t: Tables):
    return entity_rows(t, "percentuale")


@query(r"""SELECT DISTINCT doc_id, m AS normalized_name FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])(\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})(?:$|[^\p{L}\p{N}_])', 1)) AS m FROM documents)""")
def regex_dates(t: Tables):
    return entity_rows(t, "data")


@query()
def pattern_entities(t: Tables):
    """Entities of all rules over whole documents; look-arounds are beyond the twin's dialect."""
    docs = t.read("documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return entities.extract_entities(docs)


@query("SELECT doc_id, type, normalized_name, name, score FROM (SELECT l_orderkey AS doc_id, l_returnflag AS type, (l_partkey % 7)::VARCHAR AS normalized_name, l_partkey AS name, round(1 - 5 * l_discount, 6) AS score, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_partkey % 7 ORDER BY round(1 - 5 * l_discount, 6) DESC, l_linenumber * 10000000 + l_partkey) AS n FROM lineitem) WHERE n = 1")
def entity_dedupe(t: Tables):
    """The best mention of each type and name in a chunk; the first of equals."""
    rows = t.read("lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_returnflag").alias("type"),
        (F.col("l_partkey") % 7).cast("string").alias("normalized_name"),
        F.col("l_partkey").alias("name"),
        F.round(1 - 5 * F.col("l_discount"), 6).alias("score"),
        (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("pos"),
    )
    return entities.dedupe_entities(rows, "doc_id").drop("pos")


@query(rf"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '[\p{{Z}}\t\n\x0B\f\r\x1C-\x1F\x{{85}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w, text FROM documents),
s AS (SELECT doc_id, w, text, unnest(CASE WHEN len(w) <= 300 THEN [0] ELSE list_filter(range(0, len(w), 270), lambda s: s = 0 OR s + 30 < len(w)) END) AS s FROM w)
SELECT doc_id, s::BIGINT AS start, sha256(CASE WHEN len(w) <= 300 THEN text ELSE array_to_string(w[s + 1:s + 300], ' ') END) AS window_sha256 FROM s WHERE text IS NOT NULL""")
def ner_windows(t: Tables):
    """Windows of 300 words that overlap by 30, as models read long texts."""
    rows = t.read("documents").select("doc_id", F.posexplode(text.windows("text")).alias("i", "w"))
    return rows.select("doc_id", (F.col("i") * 270).cast("long").alias("start"), F.sha2("w", 256).alias("window_sha256"))


@query(f"WITH tokens AS (SELECT doc_id, list_filter({TOKENS}, lambda x: length(x) BETWEEN 2 AND 30) AS t FROM documents) SELECT doc_id, len(list_distinct(t))::BIGINT AS n FROM tokens WHERE list_contains(t, 'licensed') AND list_contains(t, 'under')")
def filter_contains(t: Tables):
    """Full-text match of every token of a query."""
    docs = t.read("documents")
    return docs.filter(text.contains_all("text", "Licensed under")).select("doc_id", F.size(F.array_distinct(text.full_text_tokens("text"))).cast("long").alias("n"))


@query(r"""
WITH words AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_.]+') AS w, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS a FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: regexp_full_match(x, '[A-Z]{3,}')))), ',') AS acronyms FROM words WHERE len(list_filter(a, lambda x: regexp_full_match(x, '[A-Z]{3,}'))) > 0""")
def lexical_acronyms(t: Tables):
    """The acronyms among a text's exact terms."""
    found = F.filter(text.lexical_terms("text"), lambda x: x.rlike("^[A-Z]{3,}$"))
    return t.read("documents").select("doc_id", F.array_join(found, ",").alias("acronyms")).filter("acronyms <> ''")


@query()
def lexical_terms(t: Tables):
    """All exact terms of each benchmark item; their look-aheads are beyond the twin's dialect."""
    return t.read("benchmark").select("item_id", F.array_join(text.lexical_terms("text"), "|").alias("terms"))


def vtt(t: Tables):
    """Turns as subtitles: a header, and a cue for each turn."""
    cue = F.concat(text.vtt_timestamp(F.col("chunk_index") * 10.5), F.lit(" --> "), text.vtt_timestamp(F.col("chunk_index") * 10.5 + 9), F.lit("\n"), F.regexp_replace("text", "\\s+", " "), F.lit("\n\n"))
    each = F.array_sort(F.collect_list(F.struct("chunk_index", cue.alias("cue"))))
    return t.turns().groupBy("file_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(each, lambda s: s["cue"]), "")).alias("vtt"))


@query(r"SELECT conv_id, array_to_string(list_filter(list_transform(list(regexp_replace(text, '\s+', ' ', 'g') ORDER BY turn, regexp_replace(text, '\s+', ' ', 'g')), lambda x: trim(x)), lambda x: x <> ''), ' ') AS text FROM conversations GROUP BY conv_id")
def vtt_flatten(t: Tables):
    """Subtitles written from conversations, and read back as text."""
    return vtt(t).select(F.col("file_id").alias("conv_id"), files.vtt_text("vtt").alias("text"))


@query()
def html_sections(t: Tables):
    """Blocks of text of each page, with the headings above them."""
    return files.html_sections(t.read("pages")).select("file_id", "chunk_index", F.array_join("headings", " > ").alias("headings"), "text")


PAIRS = f"pairs AS (SELECT a.vec_id AS id, b.vec_id AS other, round({DOT.format(a='a.embedding', b='b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE round({DOT.format(a='a.embedding', b='b.embedding')}, 6) >= {DENSE})"


@query(f"WITH {PAIRS} SELECT id, other, score FROM pairs WHERE id < other")
def similar_pairs(t: Tables):
    """All pairs of embeddings at least so alike, from products of blocks."""
    return curation.similar_pairs(t.points(), DENSE).filter("id < other")


EDGES = f"""{PAIRS}, dense_edges AS (
  SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS n FROM pairs) WHERE n <= 20
), weights AS (
  SELECT doc_id AS id, term, count(*) AS w FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) GROUP BY ALL
), shared AS (
  SELECT x.id, y.id AS other, sum(x.w * y.w) AS score FROM weights x JOIN weights y USING (term) WHERE x.id <> y.id AND x.id IN (SELECT a FROM dense_edges UNION SELECT b FROM dense_edges) GROUP BY ALL
), sparse_edges AS (
  SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS n FROM shared) WHERE n <= 20
), edges AS (SELECT a, b FROM dense_edges INTERSECT SELECT a, b FROM sparse_edges), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT DISTINCT a, a AS b FROM both_ways UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON e.a = reach.b),
components AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)"""


def clusters(t: Tables):
    """Components of points near by embedding whose documents are also near by words."""
    points = t.points()
    docs = t.read("documents").join(points.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return curation.connected_components(curation.near_duplicate_edges(points, nearest.word_vectors(docs, "doc_id", "text"), DENSE))


@query(f"WITH RECURSIVE {EDGES} SELECT a, b, true AS variant FROM (SELECT a, b FROM dense_edges EXCEPT SELECT a, b FROM sparse_edges) UNION ALL SELECT a, b, false FROM edges")
def redundancy_variants(t: Tables):
    """Near-duplicates, and variants: pairs that are alike by embedding and not by words."""
    points = t.points()
    docs = t.read("documents").join(points.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    both, alone = curation.near_duplicate_parts(points, nearest.word_vectors(docs, "doc_id", "text"), DENSE)
    return both.withColumn("variant", F.lit(False)).unionByName(alone.withColumn("variant", F.lit(True)))


@query(f"WITH RECURSIVE {EDGES} SELECT * FROM components")
def near_dup_clusters(t: Tables):
    """Components of mutual neighbours both by embedding and by words."""
    return clusters(t)


@query(f"WITH RECURSIVE {EDGES} SELECT vec_id AS id, coalesce(id <> first, false) AS redundant FROM embeddings LEFT JOIN (SELECT id, first_value(id) OVER (PARTITION BY component ORDER BY id::VARCHAR) AS first FROM components) ON vec_id = id".replace("SELECT vec_id AS id, coalesce(id <> first, false)", "SELECT vec_id AS id, coalesce(c.id <> c.first, false)").replace("LEFT JOIN (", "LEFT JOIN (").replace(") ON vec_id = id", ") c ON vec_id = c.id"))
def redundant_marking(t: Tables):
    """All of a cluster but its least id, compared as text."""
    return curation.mark_redundant(t.points(), clusters(t)).select("id", "redundant")


@query(f"WITH RECURSIVE {EDGES}, sizes AS (SELECT component, count(*) AS n FROM components GROUP BY component) SELECT (SELECT count(*) FROM embeddings) AS points, count(*) AS clusters, coalesce(sum(n - 1), 0)::BIGINT AS redundant, ((SELECT count(*) FROM embeddings) - coalesce(sum(n - 1), 0))::BIGINT AS kept, round(100 * coalesce(sum(n - 1), 0) / (SELECT count(*) FROM embeddings), 1)::DOUBLE AS pct FROM sizes")
def redundancy_stats(t: Tables):
    points = t.points()
    return curation.redundancy_stats(clusters(t), points.count())


@query(f"""WITH v AS (SELECT vec_id, embedding, sqrt({DOT.format(a='embedding', b='embedding')}) AS n FROM embeddings),
d AS (SELECT i, round(avg(embedding[i]::DOUBLE / n), 12) AS x FROM v, range(1, 65) r(i) GROUP BY i),
c AS (SELECT list(x ORDER BY i) AS c FROM d), u AS (SELECT list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS c FROM c),
s AS (SELECT vec_id AS id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE / n * c[i])), 5) AS similarity FROM v, u)
SELECT id, similarity FROM s WHERE similarity < 0.35""")
def semantic_outliers(t: Tables):
    return curation.semantic_outliers(t.points(), digits=5)


@query()
def semantic_clusters(t: Tables):
    """Profiles of cosine k-means clusters; labels of another implementation would differ."""
    points = t.points()
    found = curation.semantic_clusters(points)
    return curation.cluster_profile(found.join(points.select("id", "category"), "id").withColumn("file_id", F.col("id")))


@query("SELECT label AS cluster, count(*) AS size, count(DISTINCT vec_id) AS files, (label % 3)::VARCHAR AS label, array_to_string(list(vec_id::VARCHAR ORDER BY vec_id)[1:3], ',') AS top_files FROM embeddings GROUP BY label")
def cluster_profile(t: Tables):
    """Profiles of given clusters."""
    rows = t.points().select("id", F.col("category").alias("cluster"), F.col("id").alias("file_id"), (F.col("category") % 3).alias("category"))
    return curation.cluster_profile(rows)


SIMILARITY = f"""v AS (SELECT vec_id, embedding, sqrt({DOT.format(a='embedding', b='embedding')}) AS n FROM embeddings),
d AS (SELECT i, round(avg(embedding[i]::DOUBLE / n), 12) AS x FROM v, range(1, 65) r(i) GROUP BY i),
c AS (SELECT list(x ORDER BY i) AS c FROM d), u AS (SELECT list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS c FROM c),
s AS (SELECT vec_id AS id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE / n * c[i])), 5) AS similarity FROM v, u)"""


@query(f"WITH {SIMILARITY} SELECT count(*) AS points, count(*) FILTER (similarity < 0.35) AS outliers, round(100 * count(*) FILTER (similarity < 0.35) / count(*), 1) AS outlier_pct, round(avg(similarity), 3) AS mean_similarity FROM s")
def outlier_summary(t: Tables):
    """How many points are far from the centroid, and how near they are on average."""
    return curation.outlier_summary(t.points(), digits=5)


@query(f"WITH {SIMILARITY} SELECT id, similarity FROM s ORDER BY similarity, id LIMIT 25")
def outlier_samples(t: Tables):
    """The 25 points least like the centroid."""
    return curation.outlier_samples(t.points(), digits=5)


@query(f"WITH RECURSIVE {EDGES} SELECT component, count(*) AS size FROM components GROUP BY component ORDER BY size DESC, component LIMIT 8")
def largest_clusters(t: Tables):
    """The eight largest clusters of near-duplicates."""
    return curation.largest_clusters(clusters(t))
