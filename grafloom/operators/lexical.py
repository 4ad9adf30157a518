"""Postings, corpus statistics and BM25 for whole batches of questions.

Only postings of terms that some question has are counted, so the exchange of term frequencies carries matches alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafloom.functions.text import TOKEN, folded, token_count
from grafloom.sources.shared import kept, spread

K1, B = 1.5, 0.75
#: What a term weighs at least that more than half of all documents have, where nothing is added to the odds.
LEAST = 1e-6


@dataclass(frozen=True)
class Form:
    """A form of BM25: its constants; whether saturation is scaled to k1 + 1 (else to one); whether one is added to the
    odds, which keeps weights above zero (else they are ``LEAST`` at least); whether words differ by their accents."""

    k1: float = K1
    b: float = B
    scaled: bool = True
    added: bool = True
    accents: bool = True

    def weight(self, n: Column, df: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
        rare = idf(n, df) if self.added else F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST))
        return rare * saturation(tf, dl, avgdl, self.k1, self.b) / (1.0 if self.scaled else self.k1 + 1)

    def rarity(self, n: int, df):
        """The part of ``weight`` that a term has alone, for arrays."""
        import numpy as np

        held = np.clip(df, 0, n)
        with np.errstate(all="ignore"):
            return np.log1p((n - held + 0.5) / (held + 0.5)) if self.added else np.fmax(np.log((n - df + 0.5) / (df + 0.5)), LEAST)

    def saturated(self, tf, dl, avgdl: float):
        """The other part, for arrays."""
        import numpy as np

        whole = tf * (self.k1 + 1) / np.maximum(tf + self.k1 * (1 - self.b + self.b * dl / max(avgdl, 1.0)), 1e-9)
        return whole / (1.0 if self.scaled else self.k1 + 1)


PLAIN = Form()
#: The forms of the local pipeline's full-text lists and of the graph's.
FULLTEXT = Form(k1=1.2, added=False, accents=False)
GRAPH = Form(k1=1.2, scaled=False)


def asked(questions: DataFrame, query_col: str, terms: Column, form: Form = PLAIN) -> DataFrame:
    """(query, term, times): what questions ask for, and how often."""
    words = questions.select(query_col, F.explode(terms).alias("term"))
    words = words.withColumn("term", F.lower("term") if form.accents else folded(F.lower("term")))
    return words.groupBy(query_col, "term").agg(F.count(F.lit(1)).alias("times"))


def total(terms: DataFrame) -> Column:
    """The sum of weights ``w``, each as often as its term is asked."""
    return F.sum(F.col("w") * F.col("times") if "times" in terms.columns else "w")


def exploded(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term): every token."""
    return spread(docs.select(id_col, text.alias("text"))).select(id_col, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))).alias("term"))


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf)."""
    return exploded(docs, id_col, text).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lengths(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    return docs.select(id_col, F.greatest(token_count(text), F.lit(1)).alias("dl"))


def corpus_stats(lengths_: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length (1.0 if there are none)."""
    return lengths_.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    held = F.least(F.greatest(df, F.lit(0)), n)
    return F.log1p((n - held + 0.5) / (held + 0.5))


def saturation(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / F.greatest(tf + k1 * (1 - b + b * dl / F.greatest(avgdl, F.lit(1.0))), F.lit(1e-9))


def bm25(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text: Column | None = None, query_col: str = "item_id", form: Form = PLAIN) -> DataFrame:
    """(query, id, score) of all documents that hold a term of a question; ``terms`` is (query, term), distinct, with
    ``times`` if some count more than once, and a broadcast side where it is small.  Texts are cut into tokens once, for frequencies and lengths alike."""
    text = F.col("text") if text is None else text
    wanted = terms.select("term").distinct().withColumn("wanted", F.col("term"))
    every = spread(docs.select(id_col, text.alias("text"))).select(id_col, F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))).alias("term"))
    every = every if form.accents else every.withColumn("term", folded(F.col("term")))
    flagged = every.join(F.broadcast(wanted) if is_small(terms) else wanted, "term", "left")
    # Tokens that no question has are one row a document; a document without tokens has one too, with none.
    counted = kept(flagged.groupBy(id_col, "wanted").agg(F.count("term").alias("tf")))
    dl = counted.groupBy(id_col).agg(F.greatest(F.sum("tf"), F.lit(1)).alias("dl"))
    return bm25_of(counted.filter("wanted is not null").select(id_col, F.col("wanted").alias("term"), "tf"), dl, terms, id_col, query_col, form)


def bm25_of(posts: DataFrame, lengths_: DataFrame, terms: DataFrame, id_col: str, query_col: str, form: Form = PLAIN) -> DataFrame:
    """(query, id, score) from postings (id, term, tf) and lengths (id, dl).

    Postings are dealt by document once; weights and the sums of each question then need no further exchange.
    """
    few = is_small(terms)
    wanted = terms.select("term").distinct()
    tf = posts.join(F.broadcast(wanted) if few else wanted, "term", "left_semi").repartition(id_col)
    stats = F.broadcast(corpus_stats(lengths_))  # one row
    df = document_frequency(posts.join(F.broadcast(wanted) if few else wanted, "term", "left_semi"))  # as many rows at most as the questions have terms
    scored = tf.join(lengths_, id_col).join(F.broadcast(df) if few else df, "term").join(stats)
    weight = form.weight(*[F.col(c) for c in ("n", "df", "tf", "dl", "avgdl")])
    scored = scored.select(id_col, "term", weight.alias("w"))
    return scored.join(F.broadcast(terms) if few else terms, "term").groupBy(query_col, id_col).agg(total(terms).alias("score"))


def is_small(df: DataFrame, rows: int = 100_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def top(scores: DataFrame, k: int, query_col: str, id_col: str, score_col: str = "score", places: int = 9) -> DataFrame:
    """``scores`` with ``rank``, the best k of each question; equal scores (to ``places``) by id."""
    order = Window.partitionBy(query_col).orderBy(F.desc(F.round(score_col, places)), id_col)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
