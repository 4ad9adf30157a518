"""The local pipeline: two ranked lists added up, reranked by wording and numbers, and expanded along the graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafloom.functions.text import key_terms, strip_accents, tokens
from grafloom.operators import expand, fusion, lexical
from grafloom.operators.lexical import is_small
from grafloom.sources.shared import dealt, kept


@dataclass(frozen=True)
class Variant:
    """Fixed values of a form of the pipeline: characters of a chunk that are read, terms that make full coverage, whether
    stop words, wording and numbers count, whether edges are followed, and to which depth ancestors are."""

    chars: int = 600
    full: int = 10
    stop_words: bool = True
    boosts: bool = True
    edges: bool = True
    depth: int | None = None


FULL = Variant()
#: The form in notebooks: all terms count, and of the graph only ancestors.
NOTEBOOK = Variant(chars=800, full=12, stop_words=False, boosts=False, edges=False, depth=6)


def combined(lex: DataFrame, den: DataFrame, query: str, id_col: str) -> DataFrame:
    """(query, id, score, reasons) from the lists of words (query, id, rank) and vectors (query, id, rank, score)."""
    words = lex.select(query, id_col, (1.25 / (F.col("rank") + 2)).alias("part"), F.lit("FTS").alias("why"))
    near = den.select(query, id_col, (F.greatest("score", F.lit(0.0)) / F.sqrt(F.col("rank") + 1.0)).alias("part"), F.lit("vector").alias("why"))
    return words.unionByName(near).groupBy(query, id_col).agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("why")).alias("reasons"))


def terms_of(text: Column, variant: Variant) -> Column:
    """A question's terms; without stop words, equal ones count each."""
    return key_terms(text) if variant.stop_words else F.filter(tokens(F.lower(strip_accents(text))), lambda t: F.length(t) >= 2)


def scored(found: DataFrame, questions: DataFrame, chunks: DataFrame, query: str, variant: Variant = FULL) -> DataFrame:
    """(query, chunk_id, node_id, score, reasons) of ``found`` (query, chunk_id, score, reasons) for questions (query, text)
    and chunks (chunk_id, node_id, title, citation, text, chunk_type)."""
    found = kept(found)
    text = F.col("text")
    asked = questions.select(query, F.lower(strip_accents(text)).alias("plain"), terms_of(text, variant).alias("terms"), fusion.numbers(text, "điều", r"\d+[a-zA-Z]?").alias("articles"), fusion.numbers(text, "khoản", r"\d{1,3}").alias("clauses"))
    asked = F.broadcast(asked) if is_small(questions) else asked
    read = chunks.withColumn("low", F.lower(F.concat_ws(" ", "title", "citation", F.substring("text", 1, variant.chars))))
    seen = fusion.seen(read.select("chunk_id", "node_id", "title", "citation", "text", "chunk_type", "low"), found, "chunk_id", variant.chars)
    rows = dealt(found, "chunk_id").join(seen, "chunk_id").join(asked, query)
    share = F.when(F.size("terms") > 0, F.size(F.filter("terms", lambda t: F.contains(F.col("hay"), t))) / F.least(F.size("terms"), F.lit(variant.full))).otherwise(F.lit(0.0))
    score = (F.col("score") + share * 0.9) * F.when((F.size("terms") > 0) & (share < 0.18), 0.45).otherwise(F.lit(1.0))
    if not variant.boosts:
        return kept(rows.select(query, "chunk_id", "node_id", score.alias("score"), "reasons"))
    none = F.array().cast("array<string>")
    score = score + fusion.wording(F.col("plain"), F.col("hay")) + fusion.in_domain(F.col("plain"), F.col("hay"))
    score = score + F.when(F.col("chunk_type").isin(*fusion.TYPES), 0.08).otherwise(F.lit(0.0))
    rows = rows.withColumns({"art": fusion.named(F.col("articles"), F.col("low"), "điều"), "cla": fusion.named(F.col("clauses"), F.col("low"), "khoản")})
    reasons = F.concat("reasons", F.when(F.col("art") > 0, F.array(F.lit("exact-article"))).otherwise(none), F.when(F.col("cla") > 0, F.array(F.lit("exact-clause"))).otherwise(none))
    return kept(rows.select(query, "chunk_id", "node_id", (score + F.col("art") * 0.75 + F.col("cla") * 0.45).alias("score"), reasons.alias("reasons")))


def to_places(score: Column) -> Column:
    """A score to four places, halves up; sums in another order may fall 1e-10 short of a half."""
    return F.floor(score * 10000 + 0.500001) / 10000


def retrieve(lex: DataFrame, den: DataFrame, questions: DataFrame, chunks: DataFrame, parents: DataFrame, edges: DataFrame, query: str, k: int, variant: Variant = FULL) -> DataFrame:
    """(query, rank, chunk_id, score, reasons): the k best after expansion of the max(2 k, 12) best."""
    found = scored(combined(lex, den, query, "chunk_id"), questions, chunks, query, variant)
    base = kept(lexical.top(found, max(2 * k, 12), query, "chunk_id").select(query, "chunk_id", "node_id", "score", F.col("rank").alias("place")))
    if variant.edges:
        wide = expand.expand_local(base, parents, edges, chunks, query, found)
    else:
        wide = expand.expand_up(base, parents, chunks, query, found, variant.depth)
    return lexical.top(wide, k, query, "chunk_id").select(query, "rank", "chunk_id", to_places(F.col("score")).alias("score"), "reasons")
