"""Queries over the graph: structure, rules, closure, breadcrumbs, deduplication, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.functions import text as X
from grafloom.operators import expand, rules, structure
from grafloom.plans import law_sql
from grafloom.plans.book import Book, table
from grafloom.plans.retrieval import GRAPH, edges, parents
from grafloom.plans.texts import STRIP
from grafloom.sources.shared import kept

BOOK = Book()


def law_lines(spark: SparkSession, d: str) -> DataFrame:
    """The documents' lines set as law texts: their place gives each a marker."""
    lines = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    lines = lines.withColumn("line", X.normalize_space(F.col("line"))).filter("line <> ''")
    n, line = F.col("n"), F.col("line")
    marker = F.when(n % 12 == 1, F.concat(F.lit("Chương "), (F.floor(n / 12) + 1).cast("string"), F.lit(". "), line)).when(n % 12 == 3, F.concat(F.lit("Mục 1. "), line)).when(n % 3 == 2, F.concat(F.lit("Điều "), n.cast("string"), F.lit(". "), line)).when(n % 4 == 0, F.concat((n % 9 + 1).cast("string"), F.lit(". "), line)).when(n % 7 == 0, F.concat(F.lit("a) "), line))
    return lines.withColumn("line", F.coalesce(marker, line))


@BOOK.add(law_sql.NODES_SQL)
def structure_parse(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = structure.parse(law_lines(spark, d))
    return nodes.select("node_id", "doc_id", "node_type", "label", "number", "title", "parent_id", "ordinal", F.md5("text").alias("text_md5"))


def law_like(spark: SparkSession, d: str) -> DataFrame:
    """Every document as one article, with keywords of the rules added by its id."""
    words = F.array(*[F.lit(w) for w in law_sql.POOL])
    i = F.col("doc_id")
    picks = F.transform(F.sequence(F.lit(0), F.lit(law_sql.PICKS - 1)), lambda k: F.element_at(words, ((i * 7 + k * k * 5 + k) % len(law_sql.POOL) + 1).cast("int")))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.array_join(picks, " "))
    return table(spark, d, "documents").select(F.concat(F.lit("dieu:"), i, F.lit(":1")).alias("node_id"), i.cast("string").alias("doc_id"), F.lit("Điều").alias("node_type"), F.concat(F.lit("Điều "), (i % 60).cast("string")).alias("label"), (i % 3).alias("ordinal"), text.alias("text"))


@BOOK.add(law_sql.LAYER_EDGES_SQL)
def semantic_edges(spark: SparkSession, d: str) -> DataFrame:
    return rules.layers(law_like(spark, d))[1]


@BOOK.add(law_sql.LAYER_NODES_SQL)
def semantic_nodes(spark: SparkSession, d: str) -> DataFrame:
    return rules.layers(law_like(spark, d))[0].drop("number", "ordinal")


@BOOK.add(law_sql.EDGES_SQL)
def structure_edges(spark: SparkSession, d: str) -> DataFrame:
    return structure.parse(law_lines(spark, d))[1]


@BOOK.add("SELECT 'edge:' || substring(sha1(source || '|' || relation || '|' || target || '|' || substring(ev, 1, 80)), 1, 20) AS edge_id, source AS source_id, target AS target_id, relation, substring(min(ev), 1, 500) AS evidence FROM (SELECT 'src:' || source AS source, 'lang:' || lang AS target, 'THUỘC_VỀ' AS relation, substring(text, 1, 600) AS ev FROM documents) GROUP BY ALL")
def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    e = docs.select(F.concat(F.lit("src:"), "source").alias("source_id"), F.concat(F.lit("lang:"), "lang").alias("target_id"), F.lit("THUỘC_VỀ").alias("relation"), F.col("text").alias("evidence"))
    return structure.dedup_edges(e)


BOOK.sql["edge_dedup"] = "SELECT edge_id, source_id, target_id, relation, substring(min(ev), 1, 500) AS evidence FROM (SELECT 'edge:' || substring(sha1('src:' || source || '|THUỘC_VỀ|lang:' || lang || '|' || substring(text, 1, 80)), 1, 20) AS edge_id, 'src:' || source AS source_id, 'lang:' || lang AS target_id, 'THUỘC_VỀ' AS relation, text AS ev FROM documents) GROUP BY ALL"


@BOOK.add("SELECT source AS node_id, arg_min(lang, doc_id) AS label, arg_min(doc_id, doc_id) AS first_doc, md5(arg_max(text, doc_id)) AS text_md5 FROM documents GROUP BY source")
def node_first_writer(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("node_id"), "doc_id", F.col("lang").alias("label"), F.col("doc_id").alias("first_doc"), "text")
    return structure.first_writer(rows, "node_id", "doc_id", ["label", "first_doc"], "text").withColumn("text_md5", F.md5("text")).drop("text")


@BOOK.add(f"WITH {GRAPH} SELECT node, parent AS ancestor, 1 AS depth FROM par UNION ALL SELECT a.node, b.parent, 2 FROM par a JOIN par b ON b.node = a.parent")
def ancestor_closure(spark: SparkSession, d: str) -> DataFrame:
    return expand.ancestors(parents(spark, d))


@BOOK.add(f"WITH {GRAPH} SELECT node, CASE WHEN node LIKE 'doc:%' THEN 'root > ' || parent || ' > ' || node ELSE 'root > ' || node END AS path_label FROM par UNION ALL SELECT 'root', 'root'")
def path_labels(spark: SparkSession, d: str) -> DataFrame:
    own = parents(spark, d).withColumn("label", F.col("node")).withColumn("kind", F.lit("node"))
    root = spark.createDataFrame([("root", None, "root", "node")], own.schema)
    return expand.path_labels(own.unionByName(root), skip=("issuer",))


@BOOK.add(
    "WITH a AS (SELECT item_id, lower(" + STRIP.format("substring(text, 1, 60)") + ") AS alias FROM benchmark), h AS (SELECT doc_id, lower(" + STRIP.format("'thay thế ' || substring(text, 1, 7991)") + ") AS hay FROM documents) SELECT doc_id, item_id, CASE WHEN doc_id % 2 = 0 THEN 'HƯỚNG_DẪN' WHEN regexp_matches(hay, '(sua doi|bo sung)') THEN 'SỬA_ĐỔI' ELSE 'THAY_THẾ' END AS relation, alias AS evidence FROM h JOIN a ON contains(hay, alias) WHERE length(alias) >= 6"
)
def doc_aliases_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents that name another by an alias (first 60 characters of a benchmark text) in their first 8000."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 2 == 0, "Nghị định").otherwise("Văn bản").alias("doc_type"), F.concat_ws(" ", F.lit("thay thế"), F.substring("text", 1, 7991)).alias("text"))
    alias = F.lower(X.strip_accents(F.substring("text", 1, 60)))
    names = table(spark, d, "benchmark").select(F.concat(F.lit("i"), "item_id").alias("doc_id"), F.lit("Luật").alias("doc_type"), alias.alias("alias")).filter(F.length("alias") >= 6)
    found = structure.documents_by_alias(docs, names)
    return found.select(F.substring("source_id", 5, 99).cast("long").alias("doc_id"), F.substring("target_id", 6, 99).cast("long").alias("item_id"), "relation", "evidence")


RULES = (("license", "GIẤY_PHÉP"), ("the", "MẠO_TỪ"), ("der", "MẠO_TỪ"), ("trash", "ĐỘC_HẠI"), ("email", "LIÊN_HỆ"))


@BOOK.add("SELECT d.doc_id, r.kw, r.relation, CASE WHEN contains(lower(d.text), r.kw || ' of') OR contains(lower(d.text), r.kw || ' die') THEN 'definition' ELSE 'usage' END AS evidence FROM documents d JOIN (VALUES " + ", ".join(f"('{k}', '{r}')" for k, r in RULES) + ") r(kw, relation) ON contains(lower(d.text), r.kw)")
def keyword_rule_edges(spark: SparkSession, d: str) -> DataFrame:
    low = table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    hit = rules.matches(low, RULES, "kw", "relation")
    defined = F.contains("low", F.concat("kw", F.lit(" of"))) | F.contains("low", F.concat("kw", F.lit(" die")))
    return hit.select("doc_id", "kw", "relation", F.when(defined, "definition").otherwise("usage").alias("evidence"))


@BOOK.add(f"WITH {GRAPH} SELECT rel, count(*) AS n, count(DISTINCT source) AS sources FROM edg GROUP BY rel UNION ALL SELECT 'BELONGS_TO', count(*), count(DISTINCT node) FROM par")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    up = parents(spark, d).select(F.col("node").alias("source"), F.lit("BELONGS_TO").alias("rel"))
    return edges(spark, d).select("source", "rel").unionByName(up).groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


@BOOK.add(law_sql.CITATIONS_SQL)
def citations(spark: SparkSession, d: str) -> DataFrame:
    """References between articles of the law-like documents, to each of which a reference is added by its id."""
    nodes = kept(structure.parse(law_lines(spark, d))[0])
    part = lambda at: F.conv(F.substring(F.md5("node_id"), at, 4), 16, 10).cast("int")
    named = F.concat(F.lit("theo khoản "), (part(1) % 9 + 1).cast("string"), F.lit(" Điều "), (part(5) % 5 * 3 + 2).cast("string"))
    guides = nodes.select("doc_id").distinct().select("doc_id", (F.floor(F.col("doc_id").cast("long") / 2)).cast("string").alias("target"))
    return structure.citations(nodes.withColumn("text", F.concat_ws(" ", "text", named)), guides)


LAYERS = f"WITH layer AS ({law_sql.LAYER_EDGES_SQL}), used AS (SELECT target_id AS node_id, count(*) AS n FROM layer GROUP BY target_id)"


def used(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, n): how many edges of the documents' layers lead to a node."""
    return rules.layers(law_like(spark, d))[1].groupBy(F.col("target_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))


@BOOK.add(f"{LAYERS} SELECT f.*, coalesce(a.n, 0) AS from_documents, coalesce(b.n, 0) AS to_documents FROM ({law_sql.following()}) f LEFT JOIN used a ON a.node_id = f.source_id LEFT JOIN used b ON b.node_id = f.target_id")
def life_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Steps of both life cycles, and how many edges of documents lead to either end."""
    n = kept(used(spark, d))
    out = rules.stages(spark)[1]
    for end, name in (("source_id", "from_documents"), ("target_id", "to_documents")):
        out = out.join(n.select(F.col("node_id").alias(end), F.col("n").alias(name)), end, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("from_documents", "to_documents")})


@BOOK.add(f"{LAYERS} SELECT f.*, coalesce(used.n, 0) AS n_edges FROM ({law_sql.fixed_nodes()}) f LEFT JOIN used USING (node_id)")
def fixed_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that no text makes, and how many edges of documents lead to them."""
    fixed = rules.stages(spark)[0].select("node_id", "node_type", "label", "text")
    return fixed.join(used(spark, d), "node_id", "left").withColumn("n_edges", F.coalesce("n", F.lit(0))).drop("n")
