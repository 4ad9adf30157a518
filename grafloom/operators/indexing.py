"""Versioned indexing of single laws: new versions replace their chunks, and chunks, nodes and edges follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafloom.operators.lexical import is_small
from grafloom.operators.merge import upsert, versions


def replace_chunks(chunks: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """``chunks`` (code, version, ...) after ``changed`` (code, version): what they held of these versions goes, and
    ``fresh`` chunks of these versions come; other versions stay as they are."""
    keys = changed.select("code", "version").distinct()
    return chunks.join(keys, ["code", "version"], "left_anti").unionByName(fresh.join(keys, ["code", "version"], "left_semi").select(*chunks.columns))


def index_candidates(registry: DataFrame, chunks: DataFrame, candidates: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry, chunks) after candidates (code, checksum, status) and the chunks of their texts (code, ...).

    An equal checksum changes the state only; another one makes the next version, whose chunks replace what that version
    held.
    """
    after = versions(registry.select("code", "checksum", "version", "status"), candidates.select("code", "checksum", "status"))
    changed = after.filter("changed").select("code", "version")
    numbered = fresh.drop("version").join(changed, "code")
    return after, replace_chunks(chunks, numbered.select(*chunks.columns), changed)


def first_chunks(chunks: DataFrame, order: str = "ordinal") -> DataFrame:
    """One chunk an id, the first."""
    return chunks.groupBy("chunk_id").agg(F.min_by(F.struct(*[c for c in chunks.columns if c != "chunk_id"]), order).alias("x")).select("chunk_id", "x.*").select(*chunks.columns)


def graph_of(laws: DataFrame, chunks: DataFrame, old: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of laws (code, version, doc_id, title, status, replaces) and their chunks (chunk_id, code, version,
    node_id, chunk_type, citation, text, ordinal): a node a law and a node a section; sections belong to laws, chunks to
    sections, and a law replaces all ``old`` nodes (node_id, code) of the law that it names."""
    law_id = F.concat(F.lit("law:"), "code", F.lit(":v"), F.col("version").cast("string"))
    none = F.lit(None).cast("string")
    heads = laws.select(law_id.alias("node_id"), F.lit("document").alias("node_type"), "doc_id", "code", "title", none.alias("text"), F.lit(None).cast("long").alias("ordinal"))
    parts = chunks.join(laws.select("code", "version", "doc_id"), ["code", "version"])
    sections = parts.select("node_id", F.col("chunk_type").alias("node_type"), "doc_id", none.alias("code"), F.col("citation").alias("title"), "text", F.col("ordinal").cast("long").alias("ordinal")).dropDuplicates(["node_id"])
    nodes = heads.unionByName(sections)
    known = heads.select("node_id", "code") if old is None else upsert(old.select("node_id", "code"), heads.select("node_id", "code"), "node_id")
    edge = lambda a, relation, b: (F.col(a).alias("source_id"), F.lit(relation).alias("relation"), F.col(b).alias("target_id"))
    of_chunks = chunks.select(*edge("chunk_id", "CHUNK_OF", "node_id"))
    of_sections = chunks.select("node_id", law_id.alias("law")).select(*edge("node_id", "BELONGS_TO", "law"))
    new = laws.filter("replaces is not null").select(law_id.alias("new"), F.col("replaces").alias("old_code"))
    replaced = new.join(known.select(F.col("node_id").alias("old"), F.col("code").alias("old_code")), "old_code").filter("new <> old").select(*edge("new", "REPLACES", "old"))
    return nodes, of_chunks.unionByName(of_sections).unionByName(replaced).distinct()


#: Edges of a row of ``of_type``, on average.
ROW = 4096


def of_type(edges: DataFrame, relation: str = "rel_type") -> DataFrame:
    """(relation, block, n, edges): the edges of each type in rows of some ``ROW`` edges, for a store that loads them by
    type.  A type has as many blocks as it has edges for, and edges are dealt to these by both ends, so neither a type nor
    a source that most edges have makes a long row; copies of one edge are in one row."""
    blocks = edges.groupBy(F.col(relation).alias("of")).agg(F.ceil(F.count(F.lit(1)) / ROW).alias("blocks"))
    joined = edges.join(F.broadcast(blocks) if is_small(blocks) else blocks, F.col(relation).eqNullSafe(F.col("of")))
    block = F.pmod(F.xxhash64("source_id", "target_id"), F.col("blocks"))
    return joined.groupBy(relation, block.alias("block")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("source_id", "target_id"))).alias("edges"))


def write_by_key(tables: dict[str, DataFrame], path: str) -> None:
    """Tables laid out by what they are looked up by: edges in folders by relation and sorted by their source, nodes in
    folders by type and sorted by document, chunks sorted by node; so that readers skip files and row groups."""
    tables["edges"].repartitionByRange("relation", "source_id").sortWithinPartitions("source_id").write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")
    tables["nodes"].repartitionByRange("node_type", "doc_id").sortWithinPartitions("doc_id", "node_id").write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/nodes")
    tables["chunks"].repartitionByRange("node_id").sortWithinPartitions("node_id", "ordinal").write.mode("overwrite").parquet(f"{path}/chunks")
