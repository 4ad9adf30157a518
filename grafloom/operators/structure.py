"""Law texts into a hierarchy, without a loop over lines: markers are carried forward by windows.

Levels are chapter, section, article, clause and point.  A marker holds until one of a higher level comes, so the
current marker of a level is its last line, if that is later than the last line of every level above.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafloom.functions import rules as R
from grafloom.functions import text as X
from grafloom.functions import words as W
from grafloom.operators.search import containing

#: Lines before the first article that a document's own text keeps.
INTRO = 50
#: Lines in which a document's kind and number are looked for.
HEAD = 5


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from (doc_id, n, line): nodes are (node_id, doc_id, node_type, label, number, title, parent_id,
    ordinal, text), edges lead from each node to its parent.

    A node that a document opens again keeps its first attributes, and its text goes on.
    """
    line = F.col("line")
    by_doc = Window.partitionBy("doc_id").orderBy("n")
    so_far = by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    kind = F.when(line.rlike(X.CHAPTER), 1).when(line.rlike(X.SECTION), 2).when(line.rlike(X.ARTICLE), 3).when(line.rlike(X.CLAUSE), 4).when(line.rlike(X.POINT), 5).otherwise(0)
    rows = lines.withColumn("kind", kind)
    inline = F.when(F.col("kind") == 1, F.regexp_extract("line", X.CHAPTER, 2)).when(F.col("kind") == 2, F.regexp_extract("line", X.SECTION, 2)).when(F.col("kind") == 3, F.regexp_extract("line", X.ARTICLE, 2)).otherwise("")
    rows = rows.withColumn("inline", X.normalize_space(inline)).withColumn("next", F.lead("line").over(by_doc))
    takes = F.col("kind").isin(1, 2) & (F.col("inline") == "") & F.coalesce(X.is_heading_title(F.col("next")), F.lit(False))
    # A heading that is taken is no marker itself and takes none, so looking back one line is enough.
    rows = rows.withColumn("takes", takes).withColumn("taken", F.coalesce(F.lag("takes").over(by_doc), F.lit(False))).filter("not taken")
    rows = rows.withColumn("title", F.when(F.col("takes"), F.col("next")).otherwise(F.col("inline")))
    number = F.when(F.col("kind") == 1, F.upper(F.regexp_extract("line", X.CHAPTER, 1))).when(F.col("kind") == 2, F.upper(F.regexp_extract("line", X.SECTION, 1))).when(F.col("kind") == 3, F.regexp_extract("line", X.ARTICLE, 1)).when(F.col("kind") == 4, F.regexp_extract("line", X.CLAUSE, 1)).when(F.col("kind") == 5, F.lower(F.regexp_extract("line", X.POINT, 1)))
    rows = rows.withColumn("number", number)

    def last(level: Column, what: str) -> Column:
        return F.last(F.when(level, F.col(what)), ignorenulls=True).over(so_far)

    for k, name in ((1, "chapter"), (2, "section"), (3, "article")):
        rows = rows.withColumn(f"{name}_n", last(F.col("kind") == k, "n")).withColumn(f"{name}_no", last(F.col("kind") == k, "number"))
    none = F.lit(-1)
    after = lambda a, *b: F.col(a).isNotNull() & (F.col(a) > F.greatest(none, *[F.coalesce(F.col(x), none) for x in b]))
    rows = rows.withColumn("has_chapter", F.col("chapter_n").isNotNull())
    rows = rows.withColumn("has_section", after("section_n", "chapter_n")).withColumn("has_article", after("article_n", "chapter_n", "section_n"))
    # Clauses and points count within an article only.
    rows = rows.withColumn("kind", F.when(F.col("kind").isin(4, 5) & ~F.col("has_article"), 0).otherwise(F.col("kind")))
    rows = rows.withColumn("clause_n", last(F.col("kind") == 4, "n")).withColumn("clause_no", last(F.col("kind") == 4, "number"))
    rows = rows.withColumn("has_clause", F.col("has_article") & after("clause_n", "article_n"))
    rows = rows.withColumn("point_n", last(F.col("kind") == 5, "n")).withColumn("point_no", last(F.col("kind") == 5, "number"))
    rows = rows.withColumn("has_point", F.col("has_article") & after("point_n", "article_n") & (~F.col("has_clause") | (F.col("point_n") > F.col("clause_n"))))

    doc = F.concat(F.lit("doc:"), "doc_id")
    slug = X.slugify
    chapter = F.when(F.col("has_chapter"), F.concat_ws(":", F.lit("chuong"), "doc_id", slug(F.col("chapter_no"))))
    above_section = F.coalesce(chapter, doc)
    section = F.when(F.col("has_section"), F.concat_ws(":", F.lit("muc"), "doc_id", slug(above_section), slug(F.col("section_no"))))
    article = F.when(F.col("has_article"), F.concat_ws(":", F.lit("dieu"), "doc_id", slug(F.col("article_no"))))
    clause = F.when(F.col("has_clause"), F.concat_ws(":", F.lit("khoan"), "doc_id", slug(F.col("article_no")), F.col("clause_no")))
    clause_or_none = F.when(F.col("has_clause"), F.col("clause_no")).otherwise(F.lit("0"))
    point = F.when(F.col("has_point"), F.concat_ws(":", F.lit("diem"), "doc_id", slug(F.col("article_no")), slug(clause_or_none), slug(F.col("point_no"))))
    rows = rows.withColumns({"doc_node": doc, "chapter": chapter, "section": section, "article": article, "clause": clause, "point": point})

    at = F.col("kind")
    titled = lambda word: F.concat(F.lit(word + " "), "number", F.when(F.col("title") != "", F.concat(F.lit(". "), "title")).otherwise(""))
    label = F.when(at == 1, titled("Chương")).when(at == 2, titled("Mục")).when(at == 3, F.concat(F.lit("Điều "), "number", F.lit(". "), "title")).when(at == 4, F.concat(F.lit("Khoản "), "number")).when(at == 5, F.concat(F.lit("Điểm "), "number"))
    body = F.when(at == 4, F.concat("number", F.lit(". "), X.normalize_space(F.regexp_extract("line", X.CLAUSE, 2)))).when(at == 5, F.concat("number", F.lit(") "), X.normalize_space(F.regexp_extract("line", X.POINT, 2)))).when(at > 0, label).otherwise(line)
    own = F.when(at == 1, F.col("chapter")).when(at == 2, F.col("section")).when(at == 3, F.col("article")).when(at == 4, F.col("clause")).when(at == 5, F.col("point"))
    parent = F.when(at == 1, F.col("doc_node")).when(at == 2, F.coalesce("chapter", "doc_node")).when(at == 3, F.coalesce("section", "chapter", "doc_node")).when(at == 4, F.col("article")).when(at == 5, F.coalesce("clause", "article"))
    types = F.element_at(F.array(*[F.lit(t) for t in ("Chương", "Mục", "Điều", "Khoản", "Điểm")]), at)
    intro = (at == 0) & F.col("article").isNull()
    to = F.when(at.isin(1, 2, 3), F.array(own)).when(intro, F.array("doc_node")).otherwise(F.filter(F.array("article", "clause", "point"), lambda x: x.isNotNull()))
    rows = rows.withColumns({"own": own, "parent": parent, "label": label, "body": body, "type": F.when(at > 0, types), "to": to, "intro": intro})
    rows = rows.withColumn("ordinal", F.count_if(at > 0).over(so_far)).withColumn("intro_no", F.count_if(F.col("intro")).over(so_far))

    first = F.struct("n", "type", "label", "number", F.when(at < 4, F.col("title")).otherwise("").alias("title"), "parent", "ordinal")
    nodes = rows.filter(at > 0).groupBy(F.col("own").alias("node_id"), "doc_id").agg(F.min(first).alias("x"))
    nodes = nodes.select("node_id", "doc_id", F.col("x.type").alias("node_type"), "x.label", "x.number", "x.title", F.col("x.parent").alias("parent_id"), "x.ordinal")
    roots = lines.select("doc_id").distinct().select(F.concat(F.lit("doc:"), "doc_id").alias("node_id"), "doc_id", F.lit("VănBản").alias("node_type"), F.col("doc_id").alias("label"), F.lit("").alias("number"), F.lit("").alias("title"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("ordinal"))
    parts = rows.filter(~F.col("intro") | (F.col("intro_no") <= INTRO)).select(F.explode("to").alias("node_id"), F.struct("n", "body").alias("x"), "intro")
    joined = parts.groupBy("node_id").agg(F.array_sort(F.collect_list("x")).getField("body").alias("b"), F.max("intro").alias("intro"))
    texts = joined.select("node_id", F.when(F.col("intro"), F.array_join("b", "\n")).otherwise(F.array_join("b", " ")).alias("text"))
    nodes = roots.unionByName(nodes).join(texts, "node_id", "left")
    edges = rows.filter(at > 0).select(F.col("own").alias("source_id"), F.col("parent").alias("target_id"), F.lit("THUỘC_VỀ").alias("relation"), F.when(at < 4, F.col("label")).otherwise(F.concat("label", F.lit(" Điều "), F.col("article_no"))).alias("evidence"), "n")
    return nodes, dedup_edges(edges, "n")


def documents(lines: DataFrame) -> DataFrame:
    """(doc_id, filename, title, code, doc_type, issuer, text) from (doc_id, n, line), and the file name of each document
    if ``lines`` has the column ``filename``; else its id stands for it."""
    name = F.col("filename") if "filename" in lines.columns else F.col("doc_id")
    whole = lines.groupBy("doc_id").agg(F.min(name).alias("filename"), F.array_sort(F.collect_list(F.struct("n", "line"))).getField("line").alias("lines"))
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    head = F.array_join(F.slice("lines", 1, HEAD), " ")
    named = whole.select("doc_id", "filename", X.smart_title(F.col("lines"), stem).alias("title"), X.detect_code(stem, head).alias("code"), F.lower(F.concat_ws(" ", "filename", head)).alias("blob"), F.array_join("lines", "\n").alias("text"))
    issuer = X.cascade(F.upper(X.strip_accents(F.concat_ws(" ", "code", "filename"))), W.ISSUERS, W.ISSUER)
    return named.select("doc_id", "filename", "title", "code", X.cascade(F.col("blob"), W.DOC_TYPES, W.DOC_TYPE).alias("doc_type"), issuer.alias("issuer"), "text")


def described(nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with the titles and numbers of their documents and a node for each issuer; and the issuers' edges."""
    own = docs.select("doc_id", F.col("title").alias("t"), F.col("code").alias("c"))
    root = F.col("node_type") == "VănBản"
    label = F.when(F.coalesce("c", F.lit("")) != "", F.concat("t", F.lit(" ("), "c", F.lit(")"))).otherwise(F.col("t"))
    roots = nodes.filter(root).join(own, "doc_id")
    roots = roots.withColumns({"label": label, "number": F.coalesce("c", F.lit("")), "title": F.col("t")}).select(*nodes.columns)
    issuer = F.concat(F.lit("issuer:"), X.slugify(F.col("issuer")))
    issuers = docs.select(issuer.alias("node_id"), F.col("issuer").alias("label")).distinct()
    none = F.lit(None).cast("string")
    issuers = issuers.select("node_id", none.alias("doc_id"), F.lit("CơQuanBanHành").alias("node_type"), "label", F.lit("").alias("number"), F.col("label").alias("title"), none.alias("parent_id"), F.lit(0).cast("long").alias("ordinal"), F.lit("").alias("text"))
    issued = docs.select(issuer.alias("source_id"), F.concat(F.lit("doc:"), "doc_id").alias("target_id"), F.lit("BAN_HÀNH").alias("relation"), F.col("issuer").alias("evidence"))
    return union([nodes.filter(~root), roots, issuers.select(*nodes.columns)]), dedup_edges(issued)


def with_system(docs: DataFrame) -> DataFrame:
    """``docs`` and the document of what belongs to no other."""
    doc_id, title, code, kind, issuer, text = R.SYSTEM
    row = docs.sparkSession.createDataFrame([(doc_id, "system", title, code, kind, issuer, text)], docs.schema)
    return docs.unionByName(row)


def guides(relations: DataFrame) -> DataFrame:
    """(doc_id, target) of the documents that others guide, from edges between documents."""
    return relations.filter("relation = 'HƯỚNG_DẪN'").select(F.substring("source_id", 5, 1 << 20).alias("doc_id"), F.substring("target_id", 5, 1 << 20).alias("target")).distinct()


def dedup_edges(edges: DataFrame, *order: str) -> DataFrame:
    """Edges with ids from their ends, relation and the first 80 characters of evidence; loops and open ends go; of
    equal ids the first stays; evidence is cut to 500 characters."""
    whole = edges.filter("source_id is not null and target_id is not null and source_id <> '' and target_id <> '' and source_id <> target_id")
    key = F.concat_ws("|", "source_id", "relation", "target_id", F.substring("evidence", 1, 80))
    named = whole.withColumn("edge_id", F.concat(F.lit("edge:"), F.substring(F.sha1(key), 1, 20)))
    row = F.struct(*order, "evidence") if order else F.struct("evidence")
    kept = named.groupBy("edge_id", "source_id", "target_id", "relation").agg(F.min(row).alias("x"))
    return kept.select("edge_id", "source_id", "target_id", "relation", F.substring("x.evidence", 1, 500).alias("evidence"))


def documents_by_alias(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges between documents that name each other: (source_id, target_id, relation, evidence) from documents
    (doc_id, doc_type, text) and aliases (doc_id, alias, doc_type); the longest alias is the evidence."""
    hay = docs.select(F.col("doc_id").alias("s"), F.lower("doc_type").alias("s_type"), F.lower(X.strip_accents(F.substring("text", 1, 8000))).alias("hay"))
    names = aliases.select(F.col("doc_id").alias("t"), F.col("doc_type").alias("t_type"), "alias")
    held = containing(hay.select("s", "hay"), "s", "hay", names.select("alias").distinct(), "alias")
    found = held.join(names, "alias").filter("s <> t").join(hay.select("s", "s_type", "hay"), "s")
    law = F.col("t_type").isin("Luật", "Bộ luật")
    relation = F.when(F.col("s_type").isin("nghị định", "thông tư") & law, "HƯỚNG_DẪN").when(F.col("hay").rlike("(sua doi|bo sung)") & law, "SỬA_ĐỔI").when(F.contains("hay", F.lit("thay the")), "THAY_THẾ")
    best = found.withColumn("relation", relation).filter("relation is not null").groupBy("s", "t", "relation").agg(F.min(F.struct((-F.length("alias")).alias("l"), "alias")).alias("x"))
    return best.select(F.concat(F.lit("doc:"), "s").alias("source_id"), F.concat(F.lit("doc:"), "t").alias("target_id"), "relation", F.col("x.alias").alias("evidence"))


def aliases(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_type, alias) from (doc_id, doc_type, title, code): accent-free names of six characters or more."""
    title, code = F.lower(X.strip_accents(F.col("title"))), F.coalesce("code", F.lit(""))
    names = F.array(title, F.lower(X.strip_accents(code)), F.lower(X.strip_accents(F.replace(code, F.lit("/"), F.lit("-")))), F.trim(F.regexp_replace(title, r"^(bo luat|luat|nghi dinh|thong tu)\s+", "")))
    return docs.select("doc_id", "doc_type", F.explode(F.array_distinct(F.filter(names, lambda a: F.length(a) >= 6))).alias("alias"))


#: Fixed value: a reference to an article, with its clause and point if they are named.
REFERENCE = r"(?:(?:điểm)\s+([a-zđ](?:\d+)?)\s+)?(?:(?:khoản)\s+(\d{1,3})\s+)?Điều\s+(\d+[a-zA-Z]?)"


def references(nodes: DataFrame) -> DataFrame:
    """(node_id, doc_id, k, point, clause, article, window): every reference in the texts of articles, clauses and
    points, with 90 characters before and 120 after (an Arrow UDF finds the places)."""

    @F.pandas_udf("array<struct<point:string,clause:string,article:string,window:string>>")
    def find(s: pd.Series) -> pd.Series:
        import re

        pattern = re.compile(REFERENCE, re.I)

        def one(text):
            return [{"point": m[1] and m[1].lower(), "clause": m[2], "article": m[3].lower(), "window": text[max(0, m.start() - 90) : m.end() + 120]} for m in pattern.finditer(text or "")]

        return s.map(one)

    some = nodes.filter(F.col("node_type").isin("Điều", "Khoản", "Điểm"))
    out = some.select("node_id", "doc_id", F.posexplode(find("text")).alias("k", "r")).select("node_id", "doc_id", "k", "r.*")
    return out.filter(~F.contains("window", F.lit("Điều này")))


def citations(nodes: DataFrame, guides: DataFrame) -> DataFrame:
    """Edges from references to what they name, in the own document and those that it guides (doc_id, target): the
    point if clause and point are named and there, else the article; the clause if only that is named."""
    own = nodes.select("doc_id", F.col("doc_id").alias("target")).distinct()
    targets = own.unionByName(guides.select("doc_id", "target")).distinct()
    refs = references(nodes).join(targets, "doc_id")
    slug = lambda c: X.slugify(F.col(c))
    point = F.concat_ws(":", F.lit("diem"), "target", slug("article"), "clause", slug("point"))
    clause = F.concat_ws(":", F.lit("khoan"), "target", slug("article"), "clause")
    article = F.concat_ws(":", F.lit("dieu"), "target", slug("article"))
    wanted = refs.withColumn("first", F.when(F.col("point").isNotNull() & F.col("clause").isNotNull(), point).when(F.col("clause").isNotNull(), clause)).withColumn("second", article)
    ids = nodes.select(F.col("node_id").alias("id"))
    found = wanted.join(ids.withColumnRenamed("id", "first_id"), F.col("first") == F.col("first_id"), "left").join(ids.withColumnRenamed("id", "second_id"), F.col("second") == F.col("second_id"), "left")
    edges = found.select(F.col("node_id").alias("source_id"), F.coalesce("first_id", "second_id").alias("target_id"), F.lit("DẪN_CHIẾU_ĐẾN").alias("relation"), X.normalize_space(F.col("window")).alias("evidence"), "k")
    return dedup_edges(edges, "k")


def first_writer(rows: DataFrame, key: str, order: str, attributes: list[str], text: str) -> DataFrame:
    """One row a key: attributes of the first row by ``order``, the text of the last."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*attributes), order).alias("a"), F.max_by(text, order).alias(text)).select(key, *[F.col(f"a.{c}").alias(c) for c in attributes], text)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
