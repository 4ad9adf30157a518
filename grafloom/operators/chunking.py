"""Documents into chunks: word windows, character windows, sections at headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafloom.functions.text import normalize_space

#: Words in a window and between windows' starts, least words of a last window, words that need none.
WINDOW, STEP, TAIL, SINGLE = 360, 290, 80, 440


def sliding(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, words): texts of up to ``SINGLE`` words whole, longer ones in overlapping windows; windows
    after the first need ``TAIL`` words."""
    words = docs.select("doc_id", F.split(normalize_space(F.col("text")), " ").alias("w"))
    n = F.size("w")
    starts = F.when(n <= SINGLE, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(STEP)))
    cut = words.select("doc_id", "w", F.explode(starts).alias("s"))
    part = F.when(F.size("w") <= SINGLE, F.col("w")).otherwise(F.slice("w", F.col("s") + 1, F.lit(WINDOW)))
    out = cut.select("doc_id", (F.col("s") / STEP).cast("long").alias("ordinal"), part.alias("words"))
    return out.filter((F.col("ordinal") == 0) | (F.size("words") >= TAIL))


def char_windows(docs: DataFrame, size: int = 3500, overlap: int = 350) -> DataFrame:
    """(doc_id, ordinal, part): windows of ``size`` characters that overlap."""
    step = size - overlap
    cut = docs.filter(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))).alias("s"))
    return cut.select("doc_id", (F.col("s") / step).cast("long").alias("ordinal"), F.substring(F.col("text"), F.col("s") + 1, F.lit(size)).alias("part"))


def sections(docs: DataFrame, heading: str) -> DataFrame:
    """(doc_id, ordinal, part): texts cut before each match of ``heading`` (a look-ahead), empty parts left out."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", heading)).alias("p", "part"))
    parts = parts.select("doc_id", F.col("p").cast("long").alias("ordinal"), F.trim(F.col("part"), F.lit(" \t\n")).alias("part"))
    return parts.filter("part <> ''")


def law_sections(docs: DataFrame, article: str, clause: str, limit: int = 5500, keep_lead: bool = True) -> DataFrame:
    """(doc_id, ordinal, heading, part): articles; those longer than ``limit`` by clauses, if they have several.
    ``keep_lead`` keeps what stands before the first clause as a part of its own."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", f"(?m)(?={article})")).alias("a", "section"))
    parts = parts.select("doc_id", "a", F.trim(F.col("section"), F.lit(" \t\n")).alias("section")).filter("section <> ''")
    pieces = F.split("section", f"(?m)(?={clause})")
    many = (F.length("section") > limit) & (F.size(F.filter(pieces, lambda p: p.rlike(f"^(?:{clause})"))) > 1)
    chosen = F.when(many, pieces if keep_lead else F.filter(pieces, lambda p: p.rlike(f"^(?:{clause})"))).otherwise(F.array("section"))
    out = parts.select("doc_id", "a", F.split_part("section", F.lit("\n"), F.lit(1)).alias("heading"), F.posexplode(chosen).alias("b", "part"))
    out = out.select("doc_id", "heading", F.struct("a", "b").alias("at"), F.trim(F.col("part"), F.lit(" \t\n")).alias("part")).filter("part <> ''")
    from pyspark.sql import Window

    return out.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).cast("long").alias("ordinal"), "heading", "part")


def embedding_text(title: Column, path: Column, text: Column) -> Column:
    return F.concat_ws("\n", title, path, text)


def node_chunks(nodes: DataFrame) -> DataFrame:
    """Chunks of graph nodes (node_id, doc_id, node_type, label, path_label, ordinal, text), by what the node is:
    (chunk_id, doc_id, node_id, chunk_type, title, citation, text, token_count, ordinal).

    Long articles give sliding windows besides.  Texts of fewer than four tokens give none, but keep their ordinal,
    which follows the order of nodes in their document.
    """
    from pyspark.sql import Window

    from grafloom.functions.text import slugify, token_count

    kinds = {"Chương": "structure", "Mục": "structure", "VănBản": "document_intro", "Điều": "article", "Khoản": "clause", "Điểm": "point"}
    kind = None
    for name, value in kinds.items():
        kind = F.when(F.col("node_type") == name, value) if kind is None else kind.when(F.col("node_type") == name, value)
    text = F.coalesce(F.nullif("text", F.lit("")), "label")
    words = F.filter(F.split(normalize_space(text), " "), lambda w: w != "")
    long = (F.col("node_type") == "Điều") & (token_count(text) > SINGLE)
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1, F.lit(STEP)), lambda s: F.size(words) - s >= TAIL)
    windows = F.when(long, F.transform(starts, lambda s: F.struct(F.lit("sliding").alias("chunk_type"), F.array_join(F.slice(words, s + 1, F.lit(WINDOW)), " ").alias("text"))))
    first = F.array(F.struct(kind.otherwise("semantic").alias("chunk_type"), normalize_space(text).alias("text")))
    rows = nodes.filter("doc_id is not null").select("doc_id", "node_id", F.col("label").alias("title"), F.col("path_label").alias("citation"), F.col("ordinal").alias("o"), F.posexplode(F.concat(first, F.coalesce(windows, F.slice(first, 1, 0)))).alias("k", "c"))
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("o", "node_id", "k")) - 1)
    out = rows.select("doc_id", "node_id", "c.chunk_type", "title", "citation", "c.text", token_count(F.col("c.text")).alias("token_count"), "ordinal").filter("token_count >= 4")
    return out.withColumn("chunk_id", F.concat_ws(":", F.lit("chunk"), "doc_id", slugify(F.col("node_id")), "chunk_type", "ordinal"))
