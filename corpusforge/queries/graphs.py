"""The graph over orders that mention parts, conversations and page sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions import text
from corpusforge.operators import graph
from corpusforge.plans.projections import Tables
from corpusforge.queries.registry import query
from corpusforge.queries.shared import MENTIONS

MERGED = f"{MENTIONS}, merged AS (SELECT chunk_id, entity_id, max(score) AS score FROM mentions GROUP BY ALL)"
#: Searches start from every row whose id is divisible by this.
EVERY = 20
#: Of the driver's parts none is in half of all orders; this share cuts some.
DF_MAX = 0.0025


def mentions(t: Tables):
    return graph.merge_mentions(t.mentions())


def seeds(t: Tables):
    return t.read("orders").filter(F.col("o_orderkey") % EVERY == 0).select(F.col("o_orderkey").alias("chunk_id"))


def entities(t: Tables):
    """Parts, named by the word of their type and, for some, by a number alone."""
    p = t.read("part")
    return p.select(F.col("p_partkey").alias("entity_id"), F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("1."), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 17 == 0, F.lit("ab")).otherwise(F.col("p_name")).alias("name"))


ENTITIES = "entities AS (SELECT p_partkey AS entity_id, CASE WHEN p_partkey % 10 = 0 THEN '1.' || p_size WHEN p_partkey % 17 = 0 THEN 'ab' ELSE p_name END AS name FROM part)"
RELATIONS = "relations AS (SELECT l_suppkey AS head_id, l_returnflag AS rel_type, l_partkey AS tail_id, max(1 - 5 * l_discount) AS score, list_sort(list_distinct(list(l_orderkey))) AS files FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY ALL)"


def relations(t: Tables):
    return graph.merge_relations(t.relations())


@query(f"WITH {MERGED} SELECT chunk_id, entity_id, round(score, 6) AS score FROM merged")
def mention_merge(t: Tables):
    return mentions(t).withColumn("score", F.round("score", 6))


@query(f"WITH {RELATIONS} SELECT head_id, rel_type, tail_id, round(score, 6) AS score, array_to_string(files, ',') AS files FROM relations")
def relation_merge(t: Tables):
    return relations(t).select("head_id", "rel_type", "tail_id", F.round("score", 6).alias("score"), F.array_join(F.col("files").cast("array<string>"), ",").alias("files"))


@query(f"""WITH {MERGED}, total AS (SELECT count(*) AS n FROM orders),
touched AS (SELECT DISTINCT entity_id FROM merged WHERE chunk_id % {EVERY} = 0),
rare AS (SELECT entity_id, ln(max(n)::DOUBLE / count(*)) AS idf FROM merged, total WHERE entity_id IN (SELECT entity_id FROM touched) GROUP BY entity_id HAVING count(*) / max(n) <= {DF_MAX}),
e AS (SELECT chunk_id, round(sum(idf), 6) AS weight, count(DISTINCT entity_id) AS shared, list_sort(list_distinct(list(entity_id)))[1:3] AS via FROM merged JOIN rare USING (entity_id) WHERE chunk_id % {EVERY} <> 0 GROUP BY chunk_id)
SELECT chunk_id, weight, shared, array_to_string(via, ',') AS via FROM e ORDER BY weight DESC, chunk_id LIMIT 20""")
def expand_mentions_idf(t: Tables):
    """Orders that share rare parts with the seeds."""
    out = graph.expand_mentions(mentions(t), seeds(t), t.read("orders").count(), DF_MAX)
    return out.select("chunk_id", "weight", "shared", F.array_join(F.col("via").cast("array<string>"), ",").alias("via"))


CHAIN = "chain AS (SELECT conv_id AS file_id, conv_id * 1000 + turn AS node, lag(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS src FROM (SELECT DISTINCT conv_id, turn FROM conversations)), edges AS (SELECT src, node AS dst FROM chain WHERE src IS NOT NULL)"


def chain(t: Tables):
    rows = t.turns().select("file_id", "chunk_index").distinct().withColumn("chunk_id", F.col("file_id") * 1000 + F.col("chunk_index"))
    return graph.next_edges(rows)


@query(f"WITH {CHAIN} SELECT * FROM edges")
def next_edges(t: Tables):
    """Each turn after the one before it."""
    return chain(t)


@query(f"WITH {CHAIN}, s AS (SELECT DISTINCT conv_id * 1000 + turn AS id FROM conversations WHERE (conv_id * 1000 + turn) % {EVERY} = 0) SELECT DISTINCT x AS chunk_id FROM (SELECT dst AS x, src AS y FROM edges UNION ALL SELECT src, dst FROM edges) WHERE y IN (SELECT id FROM s) AND x NOT IN (SELECT id FROM s)")
def expand_next(t: Tables):
    """Turns next to a seed, either way."""
    ids = t.turns().select((F.col("file_id") * 1000 + F.col("chunk_index")).alias("chunk_id")).distinct().filter(F.col("chunk_id") % EVERY == 0)
    return graph.expand_next(chain(t), ids)


@query("SELECT 'orders' AS label, count(*) AS n FROM orders UNION ALL SELECT 'parts', count(*) FROM part UNION ALL SELECT 'mentions', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def graph_stats(t: Tables):
    return graph.graph_stats({"orders": t.read("orders"), "parts": t.read("part"), "mentions": mentions(t)})


SOLD_ALONE = "sold_alone AS (SELECT DISTINCT l_suppkey AS head_id, l_partkey AS tail_id FROM lineitem WHERE l_quantity = 1 AND l_suppkey <> l_partkey)"
PRUNED = f"""{MERGED}, {ENTITIES}, {SOLD_ALONE}, named AS (SELECT * FROM entities WHERE length(trim(name)) >= 3 AND NOT regexp_full_match(trim(name), '[0-9.,;:()\\-/ ]+')),
kept AS (SELECT * FROM merged WHERE score >= 0.85 AND entity_id IN (SELECT entity_id FROM named)),
rels AS (SELECT * FROM sold_alone WHERE head_id IN (SELECT entity_id FROM named) AND tail_id IN (SELECT entity_id FROM named)),
entities_left AS (SELECT * FROM named WHERE entity_id IN (SELECT entity_id FROM kept) OR entity_id IN (SELECT head_id FROM rels) OR entity_id IN (SELECT tail_id FROM rels))"""


def some_relations(t: Tables):
    """Relations of parts sold one at a time; the others have none."""
    alone = t.read("lineitem").filter("l_quantity = 1 AND l_suppkey <> l_partkey")
    return alone.select(F.col("l_suppkey").alias("head_id"), F.col("l_partkey").alias("tail_id")).distinct()


@query(f"WITH {PRUNED} SELECT entity_id, name FROM entities_left")
def prune_junk_entities(t: Tables):
    """Parts left after weak mentions, junk names and orphans go."""
    return graph.prune(entities(t), mentions(t), some_relations(t), 0.85)[0].select("entity_id", "name")


@query(f"""WITH {PRUNED} SELECT (SELECT count(*) FROM entities) AS entities_before, (SELECT count(*) FROM entities WHERE NOT (length(trim(name)) >= 3 AND NOT regexp_full_match(trim(name), '[0-9.,;:()\\-/ ]+'))) AS junk_entities,
(SELECT count(*) FROM merged) AS mentions_before, (SELECT count(*) FROM merged WHERE score < 0.85) AS weak_mentions, (SELECT count(*) FROM entities_left) AS entities_after, (SELECT count(*) FROM kept) AS mentions_after""")
def prune_stats(t: Tables):
    return graph.prune_stats(entities(t), mentions(t), some_relations(t), 0.85)


@query(f"WITH {ENTITIES}, {SOLD_ALONE}, m AS (SELECT l_partkey AS e FROM lineitem WHERE l_discount = 0.07 AND l_quantity < 10) SELECT entity_id, name FROM entities WHERE entity_id NOT IN (SELECT e FROM m) AND entity_id NOT IN (SELECT head_id FROM sold_alone) AND entity_id NOT IN (SELECT tail_id FROM sold_alone)")
def orphan_entities(t: Tables):
    """Parts that no small lot at seven per cent names and that were never sold alone."""
    some = t.read("lineitem").filter("l_discount = 0.07 AND l_quantity < 10").select(F.col("l_partkey").alias("entity_id"))
    return graph.orphans(entities(t), some, some_relations(t))


@query(f"WITH {RELATIONS}, c AS (SELECT head_id, rel_type, count(DISTINCT tail_id) AS n, list_sort(list_distinct(list(tail_id)))[1:8] AS tails FROM relations GROUP BY ALL HAVING n >= 2) SELECT head_id, rel_type, n, array_to_string(tails, ',') AS tails FROM c ORDER BY n DESC, head_id, rel_type LIMIT 50")
def relation_conflicts(t: Tables):
    """Suppliers with many parts of one kind of relation."""
    return graph.conflicts(relations(t)).select("head_id", "rel_type", "n", F.array_join(F.col("tails").cast("array<string>"), ",").alias("tails"))


@query(f"WITH {MERGED} SELECT entity_id, count(DISTINCT o_custkey) AS n_files FROM merged JOIN orders ON chunk_id = o_orderkey GROUP BY entity_id HAVING n_files > 1")
def cross_doc_entities(t: Tables):
    """Parts that several customers ordered."""
    files = t.read("orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("file_id"))
    return graph.cross_document_entities(mentions(t), files)


@query(f"WITH {RELATIONS} SELECT DISTINCT head_id AS src, tail_id AS dst FROM relations WHERE head_id % {EVERY} = 0 AND tail_id % {EVERY} = 0 AND head_id IN (SELECT p_partkey FROM part) AND tail_id IN (SELECT p_partkey FROM part)")
def subgraph_links(t: Tables):
    """Relations with both ends among the parts of a query set."""
    nodes = t.read("part").filter(F.col("p_partkey") % EVERY == 0).select(F.col("p_partkey").alias("id"))
    return graph.links_among(relations(t).select(F.col("head_id").alias("src"), F.col("tail_id").alias("dst")), nodes)


@query("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <> l_partkey AND l_suppkey IN (SELECT p_partkey FROM part ORDER BY 1 LIMIT 60) AND l_partkey IN (SELECT p_partkey FROM part ORDER BY 1 LIMIT 60)")
def graph_export(t: Tables):
    """Links of an export that is capped at sixty nodes."""
    nodes = t.read("part").select(F.col("p_partkey").alias("id"))
    return graph.export(nodes, relations(t).select(F.col("head_id").alias("src"), F.col("tail_id").alias("dst")), 60)[1]


HEADINGS = ["o_orderstatus", "o_orderpriority"]


def headed(t: Tables):
    """Orders as chunks under the headings of their status and priority; a customer is a file."""
    return t.read("orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("chunk_index"), F.when(F.col("o_orderkey") % 9 != 0, F.array(*HEADINGS)).otherwise(F.array().cast("array<string>")).alias("headings"))


@query("""WITH h AS (SELECT o_custkey AS f, o_orderstatus AS a, o_orderpriority AS b FROM orders WHERE o_orderkey % 9 <> 0)
SELECT DISTINCT f || '::s::' || a AS section_id, f AS file_id, a AS title, 1::BIGINT AS level, a AS path, NULL AS parent_id FROM h
UNION ALL SELECT DISTINCT f || '::s::' || a || ' > ' || b, f, b, 2, a || ' > ' || b, f || '::s::' || a FROM h""")
def section_paths(t: Tables):
    return graph.sections(headed(t))


@query("SELECT o_custkey || '::c' || o_orderkey AS chunk_id, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey || '::s::' || o_orderstatus || ' > ' || o_orderpriority ELSE o_custkey::VARCHAR END AS parent_id, 'HAS_CHUNK' AS type FROM orders")
def chunk_parents(t: Tables):
    """The leaf section of each chunk, or its document."""
    return graph.chunk_parents(headed(t))


@query("""WITH RECURSIVE e(parent, child) AS (SELECT 'r' || r_regionkey, 'n' || n_nationkey FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
w(id, depth) AS (SELECT 'r1', 0::BIGINT UNION ALL SELECT child, depth + 1 FROM w JOIN e ON parent = id WHERE depth < 100) SELECT id, depth FROM w""")
def folder_walk(t: Tables):
    """All nations and customers below a region, by a recursive query."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    one = t.read("nation").select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"))
    two = t.read("customer").select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child"))
    return graph.descendants(one.unionByName(two), "r1")


@query("SELECT p_partkey AS id, substring(p_name, 1, 70) AS display FROM part")
def display_names(t: Tables):
    return t.read("part").select(F.col("p_partkey").alias("id"), text.display_name(F.lit("Chunk"), "p_name", "p_name").alias("display"))


def hit_graph(t: Tables):
    """The graph around orders divisible by EVERY, as a search's hits."""
    files = t.read("orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("file_id"))
    return graph.around_hits(seeds(t).select(F.col("chunk_id").alias("id")), files, t.mentions(), t.relations())


HITS = f"""hits AS (SELECT o_orderkey AS chunk_id, o_custkey AS file_id FROM orders WHERE o_orderkey % {EVERY} = 0),
said AS (SELECT DISTINCT l_orderkey AS chunk_id, l_partkey AS entity_id FROM lineitem WHERE l_orderkey IN (SELECT chunk_id FROM hits)),
ents AS (SELECT DISTINCT entity_id FROM said)"""


@query(f"WITH {HITS} SELECT 'chunk' AS kind, chunk_id::VARCHAR AS id, true AS seed FROM hits UNION ALL SELECT DISTINCT 'document', file_id::VARCHAR, false FROM hits UNION ALL SELECT 'entity', entity_id::VARCHAR, false FROM ents")
def search_graph_nodes(t: Tables):
    """The hits of a search, their documents and the entities they mention."""
    return hit_graph(t)[0]


@query(f"""WITH {HITS} SELECT file_id::VARCHAR AS src, 'HAS_CHUNK' AS type, chunk_id::VARCHAR AS dst FROM hits UNION ALL SELECT chunk_id::VARCHAR, 'MENTIONS', entity_id::VARCHAR FROM said
UNION ALL SELECT DISTINCT l_suppkey::VARCHAR, l_returnflag, l_partkey::VARCHAR FROM lineitem WHERE l_suppkey IN (SELECT entity_id FROM ents) AND l_partkey IN (SELECT entity_id FROM ents)""")
def search_graph_links(t: Tables):
    """The links among a search's hits, documents and entities."""
    return hit_graph(t)[1]
