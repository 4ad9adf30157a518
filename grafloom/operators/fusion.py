"""Fusion of ranked lists and reranking by features of question and chunk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafloom.functions.text import key_terms, strip_accents
from grafloom.sources.shared import dealt

#: Weights of the vector and the lexical list, rank constant.
DENSE, LEXICAL, RANK = 0.55, 0.45, 60
#: The phrase that earns a bonus, and what a question must hold for it.
PHRASE = "quyen don phuong cham dut hop dong lao dong cua nguoi su dung lao dong"
ASKED = ("nguoi su dung lao dong", "don phuong", "cham dut")
TYPES = ("article", "clause", "point")
#: Words of which one in the question, and which one in the chunk, show the domain.
DOMAIN, IN_DOMAIN = ("lao dong", "hop dong", "nguoi lao dong", "nguoi su dung"), ("lao dong", "hop dong lao dong")
#: Why a chunk was found: by vectors, by words, by words as seeds of the graph, by the graph.
BY_VECTOR, BY_WORDS, BY_SEED, BY_GRAPH = "postgres_vector_cosine", "postgres_bm25", "neo4j_fulltext", "neo4j_graph"


def rrf(rankings: list[tuple[DataFrame, float]], query_col: str, id_col: str, constant: int = RANK, reasons: tuple[str, ...] | None = None) -> DataFrame:
    """(query, id, score) from lists of (query, id, rank); an id that a list holds twice counts at its first rank.  With a
    reason for each list, also the reasons of the lists that hold the id, in the lists' order."""
    top_rank = max(constant, 1)

    def one(ranking: DataFrame, weight: float) -> DataFrame:
        first = ranking.groupBy(query_col, id_col).agg(F.min("rank").alias("rank"))
        place = F.row_number().over(Window.partitionBy(query_col).orderBy("rank", id_col))
        return first.select(query_col, id_col, (F.lit(float(weight)) * (top_rank + 1) / (top_rank + place)).alias("part"))

    parts = reduce(DataFrame.unionByName, (one(*r).withColumn("list", F.lit(k)) for k, r in enumerate(rankings)))
    fused = parts.groupBy(query_col, id_col).agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("list")).alias("lists"))
    if reasons is None:
        return fused.drop("lists")
    named = F.array(*[F.lit(r) for r in reasons])
    return fused.select(query_col, id_col, "score", F.transform("lists", lambda i: F.get(named, i)).alias("reasons"))


def haystack(title: Column, citation: Column, text: Column, chars: int) -> Column:
    return F.lower(strip_accents(F.concat_ws(" ", title, citation, F.substring(text, 1, chars))))


def coverage(terms: Column, hay: Column) -> Column:
    """Share of the question's key terms that the chunk holds, of ten terms at most."""
    hits = F.size(F.filter(terms, lambda t: F.contains(hay, t)))
    return F.when(F.size(terms) > 0, hits / F.least(F.size(terms), F.lit(10))).otherwise(F.lit(0.0))


def wording(question: Column, hay: Column) -> Column:
    """Bonus and malus for negation and for the phrase."""
    negated = F.contains(question, F.lit("khong duoc"))
    said = F.contains(hay, F.lit("khong duoc"))
    out = F.when(F.contains(question, F.lit("duoc")) & ~negated & said, -0.35).otherwise(F.lit(0.0)) + F.when(negated & said, 0.5).otherwise(F.lit(0.0))
    asked = reduce(lambda a, b: a & b, (F.contains(question, F.lit(x)) for x in ASKED))
    return out + F.when(asked & F.contains(hay, F.lit(PHRASE)), 1.15).otherwise(F.lit(0.0))


def numbers(question: Column, word: str, number: str) -> Column:
    """Distinct numbers that follow ``word`` in a question, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(rf"(?iuU){word}\s+({number})"), F.lit(1)), F.lower))


def named(numbers_: Column, low: Column, word: str) -> Column:
    """How many of the numbers a lower-case text names after ``word``, as whole numbers."""
    return F.size(F.filter(numbers_, lambda n: F.regexp_like(low, F.concat(F.lit(rf"(?iuU){word}\s+"), n, F.lit(r"\b")))))


def in_domain(plain: Column, hay: Column) -> Column:
    either = lambda c, words: reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))
    return F.when(either(plain, DOMAIN) & either(hay, IN_DOMAIN), 0.18).otherwise(F.lit(0.0))


def asked(questions: DataFrame, text: str) -> DataFrame:
    """``questions`` with what reranking needs of each, made once a question: ``plain`` and key ``terms``."""
    return questions.select("*", F.lower(strip_accents(F.col(text))).alias("plain"), key_terms(F.col(text)).alias("terms"))


def seen(chunks: DataFrame, candidates: DataFrame, id_col: str, chars: int = 700) -> DataFrame:
    """Chunks that are a candidate of any question, each with its ``hay``, made once a chunk."""
    some = dealt(chunks.join(candidates.select(id_col).distinct(), id_col, "left_semi"), id_col)
    return some.withColumn("hay", haystack(F.col("title"), F.col("citation"), F.col("text"), chars)).drop("text")


def rerank(base: Column, rank: Column, plain: Column, terms: Column, hay: Column, chunk_type: Column) -> Column:
    """The base score, less by its rank, with what question and chunk have in common."""
    start = base / F.greatest(F.lit(1.0), F.pow(rank.cast("double"), F.lit(0.35)))
    return start + coverage(terms, hay) * 0.9 + wording(plain, hay) + F.when(chunk_type.isin(*TYPES), 0.08).otherwise(F.lit(0.0))
