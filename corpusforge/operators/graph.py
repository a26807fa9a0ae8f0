"""The document graph as DataFrames: derivation, expansion, pruning, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions import text

SECTION_SEPARATOR = " > "
#: Bytes of rows of ids in one partition, by the plan's estimate, and partitions at most.
PART_BYTES, MOST_PARTS = 1 << 20, 4_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of ids, dealt by a key over partitions that grow in number with them.

    Ids shuffle into few bytes, so partitions cut by their bytes hold many times as much
    in memory. Fewer partitions than the session's would be shuffled again by a join; few
    rows are left as they are.
    """
    spark = rows.sparkSession
    parts = -(-int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // PART_BYTES)
    if parts <= spark.sparkContext.defaultParallelism:
        return rows
    return rows.repartition(max(min(MOST_PARTS, parts), int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def sections(chunks: DataFrame) -> DataFrame:
    """One row for each section path of a file, with its parent (null at the top)."""
    clean = F.filter("headings", lambda h: h.isNotNull() & (h != ""))
    rows = chunks.select("file_id", clean.alias("h")).filter(F.size("h") > 0)
    path = lambda n: F.array_join(F.slice("h", 1, n), SECTION_SEPARATOR)
    ident = lambda p: F.concat(F.col("file_id").cast("string"), F.lit("::s::"), p)
    levels = rows.select("file_id", "h", F.explode(F.sequence(F.lit(1), F.size("h"))).alias("level"))
    out = levels.select(
        ident(path(F.col("level"))).alias("section_id"),
        "file_id",
        F.element_at("h", F.col("level")).alias("title"),
        F.col("level").cast("long").alias("level"),
        path(F.col("level")).alias("path"),
        F.when(F.col("level") > 1, ident(path(F.col("level") - 1))).alias("parent_id"),
    )
    return out.distinct()


def chunk_id():
    return F.concat(F.col("file_id").cast("string"), F.lit("::c"), F.col("chunk_index").cast("string"))


def chunk_parents(chunks: DataFrame) -> DataFrame:
    """(chunk_id, parent_id, type): the leaf section, or the document without headings."""
    h = F.filter("headings", lambda x: x.isNotNull() & (x != ""))
    leaf = F.concat(F.col("file_id").cast("string"), F.lit("::s::"), F.array_join(h, SECTION_SEPARATOR))
    return chunks.select(chunk_id().alias("chunk_id"), F.when(F.size(h) > 0, leaf).otherwise(F.col("file_id").cast("string")).alias("parent_id"), F.lit("HAS_CHUNK").alias("type"))


def next_edges(chunks: DataFrame, key: str = "file_id", order: str = "chunk_index", node: str = "chunk_id", stretch: int = 100_000) -> DataFrame:
    """(src, dst): each chunk after the one before it in its file.

    Files are cut into stretches of positions, each with a window of its own; what
    comes before a stretch is the last chunk of the stretch before it, of which a
    file has few.
    """
    rows = chunks.select(F.col(key).alias("f"), F.col(order).alias("o"), F.col(node).alias("dst")).withColumn("s", F.floor(F.col("o") / stretch))
    within = rows.withColumn("src", F.lag("dst").over(Window.partitionBy("f", "s").orderBy("o")))
    ends = rows.groupBy("f", "s").agg(F.max_by("dst", "o").alias("last"))
    before = ends.select(F.col("f").alias("_f"), F.col("s").alias("_s"), F.lag("last").over(Window.partitionBy("f").orderBy("s")).alias("_last")).filter(F.col("_last").isNotNull())
    joined = within.join(before, (F.col("f") == F.col("_f")) & (F.col("s") == F.col("_s")) & F.col("src").isNull(), "left")
    return joined.select(F.coalesce("src", "_last").alias("src"), "dst").filter(F.col("src").isNotNull())


def merge_mentions(mentions: DataFrame) -> DataFrame:
    """One mention for each chunk and entity, with its best score."""
    return mentions.groupBy("chunk_id", "entity_id").agg(F.max("score").alias("score"))


def merge_relations(relations: DataFrame) -> DataFrame:
    """(head_id, rel_type, tail_id): best score and all files; relations to itself go."""
    kept = relations.filter("head_id <> tail_id")
    return kept.groupBy("head_id", "rel_type", "tail_id").agg(F.max("score").alias("score"), F.sort_array(F.collect_set("file_id")).alias("files"))


def graph_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(label, n) for each table of nodes or edges."""
    out = None
    for label, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def expand_mentions(mentions: DataFrame, seeds: DataFrame, total: int, df_max: float = 0.5, limit: int = 20, digits: int = 6) -> DataFrame:
    """Chunks that share entities with the seeds (chunk_id), weighted by how rare those are."""
    return expand_mentions_each(mentions, seeds.withColumn("query_id", F.lit(0)), total, df_max, limit, digits).drop("query_id")


def expand_mentions_each(mentions: DataFrame, seeds: DataFrame, total: int, df_max: float = 0.5, limit: int = 20, digits: int = 6) -> DataFrame:
    """The same for each query of the seeds (query_id, chunk_id).

    Entities in more than ``df_max`` of all chunks go before the fan-out: they
    would link all to all, and are what skews the join.
    """
    total = max(total, 1)
    of_seeds = mentions.join(seeds, "chunk_id").select("query_id", "entity_id").distinct()
    degree = mentions.join(of_seeds.select("entity_id").distinct(), "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("deg"))
    rare = degree.filter(F.col("deg") / total <= df_max).select("entity_id", F.log(F.lit(float(total)) / F.col("deg")).alias("idf"))
    near = mentions.join(of_seeds.join(rare, "entity_id"), "entity_id").join(seeds, ["query_id", "chunk_id"], "left_anti")
    out = near.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum("idf"), digits).alias("weight"),
        F.count_distinct("entity_id").alias("shared"),
        F.slice(F.sort_array(F.collect_set("entity_id")), 1, 3).alias("via"),
    )
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "chunk_id"))
    return out.withColumn("_n", nth).filter(F.col("_n") <= limit).drop("_n")


def expand_next(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Chunks next to a seed (chunk_id), either way, that are no seeds."""
    return expand_next_each(edges, seeds.withColumn("query_id", F.lit(0))).drop("query_id")


def expand_next_each(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The same for each query of the seeds (query_id, chunk_id)."""
    both = edges.select(F.col("src").alias("x"), F.col("dst").alias("chunk_id")).union(edges.select("dst", "src"))
    found = both.join(seeds.select("query_id", F.col("chunk_id").alias("x")), "x").select("query_id", "chunk_id").distinct()
    return found.join(seeds, ["query_id", "chunk_id"], "left_anti")


def is_junk(name, min_len: int = 3, drop_numeric: bool = True):
    n = F.trim(F.coalesce(text.col(name), F.lit("")))
    junk = F.length(n) < min_len
    return junk | n.rlike(r"^[0-9.,;:()\-/ ]+$") if drop_numeric else junk


def orphans(entities: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities without a mention and without a relation either way."""
    out = entities.join(mentions.select("entity_id"), "entity_id", "left_anti")
    for end in ("head_id", "tail_id"):
        out = out.join(relations.select(F.col(end).alias("entity_id")), "entity_id", "left_anti")
    return out


def prune(entities: DataFrame, mentions: DataFrame, relations: DataFrame, min_score: float = 0.6, min_len: int = 3, drop_numeric: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, mentions and relations without weak mentions, junk names and orphans."""
    named = entities.filter(~is_junk("name", min_len, drop_numeric))
    kept = mentions.filter(F.col("score") >= min_score).join(named.select("entity_id"), "entity_id", "left_semi")
    rels = relations
    for end in ("head_id", "tail_id"):
        rels = rels.join(named.select(F.col("entity_id").alias(end)), end, "left_semi")
    alone = orphans(named, kept, rels).select("entity_id")
    return named.join(alone, "entity_id", "left_anti"), kept, rels


def prune_stats(entities: DataFrame, mentions: DataFrame, relations: DataFrame, min_score: float = 0.6, min_len: int = 3) -> DataFrame:
    """Counts before, of what is weak or junk, and after (one row)."""
    left, kept, _ = prune(entities, mentions, relations, min_score, min_len)
    before = entities.agg(F.count("*").alias("entities_before"), F.count_if(is_junk("name", min_len)).alias("junk_entities"))
    weak = mentions.agg(F.count("*").alias("mentions_before"), F.count_if(F.col("score") < min_score).alias("weak_mentions"))
    after = left.agg(F.count("*").alias("entities_after"))
    return before.join(weak).join(after).join(kept.agg(F.count("*").alias("mentions_after")))  # one row each


def conflicts(relations: DataFrame, top: int = 50, samples: int = 8) -> DataFrame:
    """Heads with two or more tails of one relation type, most first, with the least tails."""
    pairs = relations.select("head_id", "rel_type", "tail_id").distinct()
    worst = pairs.groupBy("head_id", "rel_type").agg(F.count("*").alias("n")).filter("n >= 2").orderBy(F.desc("n"), "head_id", "rel_type").limit(top)
    nth = F.row_number().over(Window.partitionBy("head_id", "rel_type").orderBy("tail_id"))
    some = pairs.join(F.broadcast(worst), ["head_id", "rel_type"]).withColumn("_r", nth).filter(F.col("_r") <= samples)  # top rows
    out = some.groupBy("head_id", "rel_type").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("tail_id")).alias("tails"))
    return out.orderBy(F.desc("n"), "head_id", "rel_type")


def cross_document_entities(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """Entities in more than one file (files: chunk_id, file_id), most first."""
    return mentions.join(files, "chunk_id").groupBy("entity_id").agg(F.count_distinct("file_id").alias("n_files")).filter("n_files > 1")


def links_among(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with both ends among the nodes (a frame with one column, id)."""
    ids = nodes.select("id").distinct()
    out = edges
    for end in (src, dst):
        out = dealt(out, end).join(ids.withColumnRenamed("id", end), end)  # a semi join would go below the dealing
    return out.select(*edges.columns).distinct()


def around_hits(hits: DataFrame, files: DataFrame, mentions: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of a search: nodes (kind, id, seed) and links (src, type, dst), ids as text.

    Hits (id) are chunks; with them come their documents (files: chunk_id, file_id),
    the entities they mention and the relations between those.
    """
    text = lambda c: F.col(c).cast("string")
    chunks = hits.select(F.col("id").alias("chunk_id")).distinct()
    among = lambda rows, c: dealt(rows.select("chunk_id", c), "chunk_id").join(chunks, "chunk_id").distinct()
    of, said = among(files, "file_id"), among(mentions, "entity_id")
    entities = said.select(F.col("entity_id").alias("id")).distinct()
    between = links_among(relations.select("head_id", "rel_type", "tail_id"), entities, "head_id", "tail_id")
    node = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), text(c).alias("id"), F.lit(kind == "chunk").alias("seed"))
    link = lambda df, src, kind, dst: df.select(text(src).alias("src"), kind.alias("type"), text(dst).alias("dst"))
    nodes = node(chunks, "chunk", "chunk_id").unionByName(node(of.select("file_id").distinct(), "document", "file_id")).unionByName(node(entities, "entity", "id"))
    links = link(of, "file_id", F.lit("HAS_CHUNK"), "chunk_id").unionByName(link(said, "chunk_id", F.lit("MENTIONS"), "entity_id")).unionByName(link(between, "head_id", F.col("rel_type"), "tail_id"))
    return nodes, links


def export(nodes: DataFrame, edges: DataFrame, cap: int) -> tuple[DataFrame, DataFrame, bool]:
    """At most ``cap`` nodes by id, the edges among them, and whether nodes were left out."""
    kept = nodes.orderBy("id").limit(cap)
    return kept, links_among(edges, kept.select("id")), nodes.limit(cap + 1).count() > cap


def purge_file(file_id, mentions: DataFrame, chunks: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions, chunks and relations without a file; relations left with no file go."""
    gone = chunks.filter(F.col("file_id") == F.lit(file_id)).select("chunk_id")
    rels = relations.withColumn("files", F.array_remove("files", F.lit(file_id))).filter(F.size("files") > 0)
    return mentions.join(gone, "chunk_id", "left_anti"), chunks.filter(F.col("file_id") != F.lit(file_id)), rels


def descendants(edges: DataFrame, root: str, max_depth: int = 100) -> DataFrame:
    """(id, depth) below a root of an acyclic (parent, child) table, by a recursive query."""
    spark = edges.sparkSession
    edges.createOrReplaceTempView("_walk_edges")
    return spark.sql(
        f"""
        WITH RECURSIVE walk(id, depth) AS (
          SELECT CAST(:root AS STRING), CAST(0 AS BIGINT)
          UNION ALL
          SELECT e.child, w.depth + 1 FROM walk w JOIN _walk_edges e ON e.parent = w.id WHERE w.depth < {int(max_depth)}
        ) SELECT id, depth FROM walk
        """,
        args={"root": root},
    )


def neighbourhood(edges: DataFrame, node: str) -> DataFrame:
    """Ids within one hop of a node, itself included."""
    near = edges.filter((F.col("src") == node) | (F.col("dst") == node))
    return near.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
