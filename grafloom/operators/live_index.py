"""An index that follows its documents: chunks, postings, document frequencies and mean length, kept up by each batch.

A batch has new versions of documents.  Of each document the version of the largest number holds, whatever the order in
which batches bring them, so any split of the versions into batches gives the same index.  A changed document adds the
postings of its new text with sign +1 and those of the text before with sign -1; what a term's, a document's and the
corpus's figures are is the sum of the signs.  A version's postings carry its number, so a pair cancels; chunks carry it
too and hold while their version does.

Batches only add: a batch looks up its own documents' versions, for which it reads the ids of the others in their buckets,
and writes its rows beside what is there, so what it shuffles and writes follows the batch, not the index.  ``compact``
puts the buckets that many batches have written to into one run each.

Cases: a null or empty text counts as a document of length 1 without postings; ``removed`` takes a document out, and a
version below its number does not bring it back; of several rows with one number the one not removed with the largest
checksum holds; a batch number that a stream has applied is not applied again; an empty batch changes nothing; a null id
is no document.
"""

from __future__ import annotations

from copy import copy

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.functions.text import token_count
from grafloom.operators.chunking import sliding
from grafloom.operators.lexical import PLAIN, Form, is_small
from grafloom.operators.term_index import TermIndex, placed
from grafloom.sources.shared import kept
from grafloom.sources.store import Store, Table, hashed

#: Buckets by document and by term.
PARTS = 64


def tables(parts: int) -> dict[str, Table]:
    by_doc, by_term = hashed("doc_id", parts), hashed("term", parts)
    return {
        "docs": Table("doc_id long, seq long, since long, removed boolean, checksum string, dl long, text string", by_doc),
        "chunks": Table("doc_id long, since long, checksum string, ordinal long, words array<string>", by_doc),
        "postings": Table("term string, i long, since long, sign int, tf int, dl int, gaps array<int>", by_term),
        "frequencies": Table("term string, df long", by_term),
        "corpus": Table("n long, length long", "0"),
    }


def signed(changed: DataFrame, text: str, since: str, sign: int) -> DataFrame:
    """Postings of the texts of a column, with the number of the version and the sign."""
    texts = changed.filter(F.col(text).isNotNull()).select(F.struct(F.col("doc_id"), F.col(since).alias("since")).alias("at"), F.col(text).alias("text"))
    rows = placed(texts, "at", F.col("text"))
    return rows.select("term", F.col("i.doc_id").alias("i"), F.col("i.since").alias("since"), F.lit(sign).alias("sign"), "tf", "dl", "gaps")


class LiveIndex:
    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS) -> None:
        """The index in ``path``, whose buckets are as many as it was begun with."""
        self.store = Store(spark, path, tables(parts))

    def apply(self, versions: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Takes in versions (doc_id, seq, text, removed); ``batch`` is the name of a stream and the batch's number."""
        store = self.store
        if store.done(batch):
            return
        checksum = F.coalesce(F.sha2("text", 256), F.lit(""))
        live = F.when(~F.col("removed"), F.col("text"))
        whole = versions.select("doc_id", "seq", F.coalesce("removed", F.lit(False)).alias("removed"), "text").filter("doc_id is not null")
        ids = whole.select("doc_id").distinct()
        held = store.read("docs", store.touched("docs", ids)).join(F.broadcast(ids) if is_small(ids) else ids, "doc_id", "left_semi")
        new = latest(whole.select("doc_id", "seq", "removed", checksum.alias("checksum"), live.alias("text")))
        before = latest(held).select("doc_id", *(F.col(c).alias(f"old_{c}") for c in ("seq", "since", "removed", "checksum", "dl", "text")))
        known = F.col("old_seq").isNotNull()
        same = F.coalesce(known & (F.col("removed") == F.col("old_removed")) & (F.col("checksum") == F.col("old_checksum")), F.lit(False))
        dl = F.greatest(F.coalesce(token_count(F.col("text")), F.lit(0)), F.lit(1)).cast("long")
        taken = new.join(before, "doc_id", "left").filter(~known | (place() > place("old_")))
        taken = taken.withColumns({"since": F.when(same, F.col("old_since")).otherwise(F.col("seq")), "dl": dl, "same": same})
        taken = kept(taken.withColumn("old_text", F.when(~F.col("same"), F.col("old_text"))))
        changed = taken.filter("not same")

        change = store.change()
        written = change.append("docs", taken.select("doc_id", "seq", "since", "removed", "checksum", "dl", "text"))
        # A text that stays keeps the number it came with; documents lie in the parts of their chunks.
        here = written.filter("since = seq AND text IS NOT NULL")
        cut = sliding(here.select(F.struct("doc_id", "since", "checksum").alias("doc_id"), "text"))
        change.append("chunks", cut.select("doc_id.*", "ordinal", "words"), deal=False)
        rows = change.append("postings", signed(changed, "text", "since", 1).unionByName(signed(changed, "old_text", "old_since", -1)))
        change.append("frequencies", rows.groupBy("term").agg(F.sum("sign").cast("long").alias("df")).filter("df <> 0"))
        plus = F.when(~F.col("removed"), F.lit(1)).otherwise(0)
        minus = F.when(known & ~F.col("old_removed"), F.lit(1)).otherwise(0)
        sums = changed.agg(F.sum(plus - minus).cast("long").alias("n"), F.sum(plus * F.col("dl") - minus * F.coalesce("old_dl", F.lit(0))).cast("long").alias("length"))
        change.append("corpus", sums.filter("n is not null"))
        change.commit(batch)

    def documents(self) -> DataFrame:
        """(doc_id, seq, since, checksum, dl) of the documents that are there."""
        rows = self.store.read("docs").select("doc_id", "seq", "since", "removed", "checksum", "dl")
        return latest(rows).filter(~F.col("removed")).drop("removed")

    def chunks(self) -> DataFrame:
        """(doc_id, ordinal, words) of the texts that hold."""
        held = self.store.read("chunks").join(self.documents(), ["doc_id", "since", "checksum"], "left_semi")
        return held.select("doc_id", "ordinal", "words")

    def frequencies(self) -> DataFrame:
        """(term, df) of all terms."""
        return netted_frequencies(self.store.read("frequencies"))

    def corpus(self) -> DataFrame:
        """One row (n, avgdl)."""
        sums = self.store.read("corpus").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("length").alias("length"))
        return sums.select("n", F.when(F.col("n") > 0, F.col("length") / F.col("n")).otherwise(1.0).alias("avgdl"))

    def terms(self) -> LiveTerms:
        """The rankings of a term index over the state that is open now."""
        return LiveTerms(copy(self.store), self.corpus())

    def compact(self, most: int = 16) -> dict[str, list[str]]:
        """Puts the buckets that lie in more than ``most`` runs into one, without what has gone; returns them by table."""
        store, change = self.store, self.store.change()
        live = self.documents()
        nets = {
            "docs": latest,
            "chunks": lambda rows: rows.join(live, ["doc_id", "since", "checksum"], "left_semi"),
            "postings": netted,
            "frequencies": netted_frequencies,
            "corpus": lambda rows: rows.agg(F.sum("n").alias("n"), F.sum("length").alias("length")),
        }
        full = {t: [p for p in store.parts(t) if len(store.runs(t, p)) > most] for t in nets}
        full = {t: parts for t, parts in full.items() if parts}
        for t, parts in full.items():
            change.replace(t, nets[t](store.read(t, parts)), parts)
        if full:
            change.commit()
        return full


def place(prefix: str = "") -> Column:
    """What versions of a document are ordered by."""
    seq, removed, checksum = (F.col(f"{prefix}{c}") for c in ("seq", "removed", "checksum"))
    return F.struct(seq.alias("a"), (~removed).alias("b"), checksum.alias("c"))


def latest(rows: DataFrame) -> DataFrame:
    """Of each document the version that holds."""
    rest = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.max_by(F.struct(*rest), place()).alias("x")).select("doc_id", "x.*")


def netted(rows: DataFrame) -> DataFrame:
    """Postings whose signs do not cancel."""
    sums = rows.groupBy("term", "i", "since", "dl", "gaps").agg(F.sum("sign").cast("int").alias("sign"), F.max("tf").alias("tf"))
    return sums.filter("sign > 0").select("term", "i", "since", "sign", "tf", "dl", "gaps")


def netted_frequencies(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")


class LiveTerms(TermIndex):
    """A term index whose postings are sums of signs; questions open their terms' buckets only."""

    def __init__(self, store: Store, corpus: DataFrame) -> None:
        super().__init__(store.read("postings", []), corpus, "doc_id")
        self.store = store

    def opened(self, terms: DataFrame, table: str = "postings") -> DataFrame:
        wanted = terms.select("term").distinct()
        rows = self.store.read(table, self.store.touched(table, wanted))
        return rows.join(F.broadcast(wanted) if is_small(wanted) else wanted, "term", "left_semi")

    def matches(self, terms: DataFrame, *more: str, form: Form = PLAIN) -> DataFrame:
        if not form.accents:
            raise ValueError("buckets of a live index keep spellings of a word apart")
        rows = netted(self.opened(terms))
        return rows.select("term", F.col("i").alias(self.id_col), "tf", "dl", *more)

    def frequencies(self, terms: DataFrame) -> DataFrame:
        return netted_frequencies(self.opened(terms, "frequencies"))
