"""The public surface: build an index from lines, ask it a batch of questions, look at its statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.functions.text import fulltext_terms, graph_terms, lexical_terms, notebook_terms, strip_accents
from grafloom.operators import chunking, dense, expand, fusion, lexical, local, rules, structure
from grafloom.operators.embedding import Embedder, hashed
from grafloom.operators.term_index import TermIndex
from grafloom.sources.shared import dealt, kept
from grafloom.sources.sinks import read_index, write_index

#: Names of retrievers, and what else they are called.
MODES = {
    "rag": "rag", "postgres": "rag", "pgvector": "rag",
    "hybrid": "hybrid", "hybrid_rag": "hybrid", "auto": "hybrid", "neo4j_postgres": "hybrid",
    "graph": "graph", "graphrag": "graph", "neo4j": "graph",
    "local": "local", "local_graphrag": "local", "sqlite": "local", "notebook": "notebook",
    "lexical": "lexical", "bm25": "lexical", "dense": "dense", "vector": "dense",
}


#: What questions ask the word lists of these retrievers for, and how those are weighed; others ask for ``lexical_terms``.
ASKED = {"local": (fulltext_terms, lexical.FULLTEXT), "notebook": (notebook_terms, lexical.FULLTEXT), "graph": (graph_terms, lexical.GRAPH)}


def mode_of(name: str | None) -> str:
    """The retriever that a setting names; none means the default one."""
    key = (name or "hybrid_rag").strip().lower().replace("-", "_")
    if key not in MODES:
        raise ValueError(f"no retriever is called {name}")
    return MODES[key]


def searched() -> Column:
    """What is searched of a chunk."""
    return F.concat_ws(" ", "title", "citation", "text")


@dataclass
class Index:
    docs: DataFrame
    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    terms: TermIndex
    embedder: Embedder

    def retrieve(self, queries: DataFrame, mode: str | None = None, top_k: int = 10) -> DataFrame:
        """(query_id, rank, chunk_id, score, reasons) for questions (query_id, text)."""
        mode = mode_of(mode)
        if mode in ("local", "notebook"):
            variant = local.FULL if mode == "local" else local.NOTEBOOK
            many = max(24, 4 * top_k)
            return local.retrieve(self._words(queries, many, mode), self._vectors(queries, many), queries, self.chunks, self._parents(), self._edges(), "query_id", top_k, variant)
        seeds = kept(self._seeds(queries, mode, max(32, 5 * top_k)))
        if mode in ("graph", "hybrid"):
            seeds = self._with_graph(seeds)
        best = lexical.top(seeds, top_k, "query_id", "chunk_id")
        return best.select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"), "reasons")

    def _parents(self) -> DataFrame:
        return self.nodes.select(F.col("node_id").alias("node"), F.col("parent_id").alias("parent"))

    def _edges(self) -> DataFrame:
        relations = F.broadcast(expand.relation_table(self.nodes.sparkSession)).select("native", "rel_type")  # 26 fixed rows
        typed = self.edges.join(relations, F.upper(strip_accents(F.col("relation"))) == F.col("native"), "left")
        return typed.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.coalesce("rel_type", F.lit("RELATED_TO")).alias("rel"))

    def _with_graph(self, seeds: DataFrame) -> DataFrame:
        """Seeds and the chunks of what the graph reaches from their nodes, with reasons."""
        own = seeds.join(self.chunks.select("chunk_id", "node_id"), "chunk_id").groupBy("query_id", F.col("node_id").alias("node")).agg(F.max("score").alias("score"))
        own = kept(own)
        new = own.select("query_id", "node", F.lit(True).alias("seed"))
        nodes = expand.expand(own, self._parents(), self._edges(), "query_id").join(new, ["query_id", "node"], "left")
        reached = expand.fetch(nodes, self.chunks, "query_id", "chunk_id", "seed")
        reached = reached.select("query_id", "chunk_id", "score", F.lit(None).cast("array<string>").alias("reasons"), F.col("seed").isNull().alias("by_graph"))
        every = seeds.select("query_id", "chunk_id", "score", "reasons", F.lit(False).alias("by_graph")).unionByName(reached)
        best = every.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.max("reasons").alias("own"), F.bool_or("by_graph").alias("by_graph"))
        graph = F.array(F.lit(fusion.BY_GRAPH))
        reasons = F.when(F.col("own").isNull(), graph).when(F.col("by_graph"), F.concat("own", graph)).otherwise(F.col("own"))
        return best.select("query_id", "chunk_id", "score", reasons.alias("reasons"))

    def _words(self, queries: DataFrame, many: int, mode: str) -> DataFrame:
        words, form = ASKED.get(mode, (lexical_terms, lexical.PLAIN))
        terms = lexical.asked(queries, "query_id", words(F.col("text")), form)
        return lexical.top(self.terms.bm25(terms, "query_id", form), many, "query_id", "chunk_id")

    def _vectors(self, queries: DataFrame, many: int) -> DataFrame:
        asked = queries.select("query_id", self.embedder.column(F.col("text")).alias("vector"))
        return dense.similarities(self.chunks, asked, many, "chunk_id", "vector", "query_id")

    def _seeds(self, queries: DataFrame, mode: str, candidates: int) -> DataFrame:
        lists = []
        if mode in ("dense", "rag", "hybrid"):
            lists.append((self._vectors(queries, candidates), fusion.DENSE, fusion.BY_VECTOR))
        if mode != "dense":
            lists.append((self._words(queries, candidates, mode), fusion.LEXICAL, fusion.BY_SEED if mode == "graph" else fusion.BY_WORDS))
        if len(lists) == 1:
            ranked, _, reason = lists[0]
            ranked = ranked.withColumn("reasons", F.array(F.lit(reason)))
        else:
            fused = fusion.rrf([x[:2] for x in lists], "query_id", "chunk_id", reasons=tuple(x[2] for x in lists))
            ranked = lexical.top(fused, 2 * candidates, "query_id", "chunk_id")
        ranked = kept(ranked.select("query_id", "chunk_id", "score", "rank", "reasons"))
        asked = fusion.asked(queries.select("query_id", "text"), "text").drop("text")
        joined = dealt(ranked, "chunk_id").join(fusion.seen(self.chunks.select("chunk_id", "title", "citation", "text", "chunk_type"), ranked, "chunk_id"), "chunk_id").join(asked, "query_id")
        score = fusion.rerank(*[F.col(c) for c in ("score", "rank", "plain", "terms", "hay", "chunk_type")])
        return lexical.top(joined.select("query_id", "chunk_id", score.alias("score"), "reasons"), candidates, "query_id", "chunk_id").select("query_id", "chunk_id", "score", "reasons")

    def stats(self) -> DataFrame:
        """One row: how many nodes, edges and chunks there are, of which kinds."""
        count = lambda df, c, name: df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias(name), F.map_from_entries(F.collect_list(F.struct(c, "n"))).alias(f"{name}_by"))
        return count(self.nodes, "node_type", "nodes").join(count(self.edges, "relation", "edges")).join(count(self.chunks, "chunk_type", "chunks"))

    def write(self, path: str) -> str:
        """Publishes the index below ``path``; the name of its snapshot."""
        tables = {"docs": self.docs, "nodes": self.nodes, "edges": self.edges, "chunks": self.chunks, "postings": self.terms.blocks, "corpus": self.terms.corpus}
        return write_index(tables, path, self.embedder.meta())


class Engine:
    def __init__(self, spark: SparkSession, dim: int = 384, embedder: Embedder | None = None):
        self.spark, self.embedder = spark, embedder or hashed(dim)

    def build(self, lines: DataFrame) -> Index:
        """An index of documents given as lines (doc_id, n, line, and filename if there is one): their descriptions,
        hierarchy, relations, citations and semantic layers as a graph without open ends, and chunks of all its nodes."""
        nodes, up = structure.parse(lines)
        docs = kept(structure.documents(lines))
        nodes, issued = structure.described(nodes, docs)
        nodes = kept(nodes)
        relations = kept(structure.documents_by_alias(docs.select("doc_id", "doc_type", "text"), structure.aliases(docs)))
        found = structure.citations(nodes.filter("doc_id is not null"), structure.guides(relations))
        fixed, stages = rules.stages(self.spark)
        meant, layers = rules.layers(nodes)
        edges = [x.select("source_id", "target_id", "relation", "evidence") for x in (up, issued, relations, found, layers, stages)]
        edges = kept(structure.dedup_edges(structure.union(edges)))
        every = [x.select(*nodes.columns) for x in (nodes, fixed, meant)]
        nodes = kept(structure.union(every))
        labels = expand.path_labels(nodes.select(F.col("node_id").alias("node"), F.col("parent_id").alias("parent"), "label", F.col("node_type").alias("kind")), skip=("CơQuanBanHành",))
        named = nodes.join(labels, nodes["node_id"] == labels["node"], "left").drop("node")
        chunks = chunking.node_chunks(named).withColumn("vector", self.embedder.column(chunking.embedding_text(F.col("title"), F.col("citation"), F.col("text"))))
        chunks = kept(chunks)
        return Index(structure.with_system(docs), kept(named), edges, chunks, TermIndex.build(chunks, "chunk_id", searched()), self.embedder)

    def open(self, path: str, snapshot: str | None = None) -> Index:
        """The index that was published last below ``path``, or a named snapshot; it stays this one while it is used."""
        tables = read_index(self.spark, path, self.embedder.meta(), snapshot)
        terms = TermIndex(tables.pop("postings"), tables.pop("corpus"), "chunk_id")
        return Index(terms=terms, embedder=self.embedder, **tables)
