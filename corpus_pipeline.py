"""Five stages that turn ``documents`` into encoded, clean training documents.

Language ID drops documents whose text speaks for no learned language; line dedup drops lines that many documents share;
the n-gram Jaccard join keeps one document of each group of near copies; benchmark decontamination drops documents that
hold a benchmark passage; byte-level BPE encodes what is left.  Every stage is written as Parquet and read by the next.

Cases, for all stages: null and empty texts go with the first stage; rows with a null id are kept until the end, but
neither lose lines nor count as copies; rows that share an id are decided each by its text, and of equal rows one stays;
other columns are passed on; an empty ``documents`` gives an empty product, and with an empty ``benchmark`` nothing is
contaminated.  Without any labelled row no language is learned, so nothing is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.llm import byte_bpe, decontaminate, jaccard, language, line_dedup
from grafloom.llm.queries import BYTE_BPE, table
from grafloom.llm.shared import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose bits speak for no codeword, and those without a letter or a text; the classifiers learn from the
    stage's own rows that are not held out."""
    model = language.fit(docs.filter(~language.is_held_out(F.col("doc_id"))))
    return language.known_language(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; all documents stay."""
    out = line_dedup.drop_lines(docs)
    changed = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the least id."""
    return jaccard.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, their number, and digests of the ids and of what they decode to."""
    return byte_bpe.round_trips(docs, BYTE_BPE, with_ids=True)


STAGES = [("language_id", language_id), ("line_dedup", drop_lines), ("jaccard_join", near_copies), ("decontamination", decontaminated), ("byte_bpe", encoded)]

#: SQL can state neither the classifiers nor the encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
