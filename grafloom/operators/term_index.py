"""A positional index laid out by term, and what is ranked from it: BM25 and cover density.

Postings (document, frequency, length, positions as gaps) of one term stand in blocks of at most ``BLOCK`` of the documents
that were read together, each with its number, largest frequency and least length.  Blocks lie in folders by the term's bucket and sorted by term within,
so a batch of questions opens the folders of its terms only, and of these the row groups that may hold them.  A term that
very many documents have is dealt to several tasks, as blocks are dealt by bucket and document.

Texts are cut and their postings packed where documents are read, so the one exchange carries blocks.

Cases: documents with null texts have no postings, but count in the statistics; a null id is one id; terms that no
document has give no rows; an empty table gives an empty index, whose mean length is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.functions.text import TOKEN, folded
from grafloom.operators.lexical import PLAIN, Form, is_small, top, total
from grafloom.sources.shared import dealt, kept, shared_folder, spread

BUCKETS = 64
BLOCK = 128
#: Parts of a bucket that are written by tasks of their own.
DEALS = 4
#: Bytes of text whose postings are packed together: some twenty times as many are held in memory.
TEXT = 12_000_000
#: Rows that Python hands over at once.
ROWS = 20_000
#: Pairs of a question's term and a document that are scored at once.
PAIRS = 2_000_000
#: What a cover counts that holds nothing but its terms.
COVER = 0.1


def bucket(term: Column) -> Column:
    """The bucket of a term, which is that of its accented and plain spellings alike."""
    return F.pmod(F.xxhash64(folded(term)), F.lit(BUCKETS)).cast("int")


def placed(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(term, i, tf, dl, gaps) of every term of every document."""
    cut = spread(docs.select(F.col(id_col).alias("i"), F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)).alias("w"))).filter("w is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            words = batch.column("w")
            ends = np.diff(words.offsets.to_numpy())
            terms = words.flatten().dictionary_encode()
            doc = np.repeat(np.arange(batch.num_rows), ends)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(ends) - ends, ends) + 1
            code = terms.indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((place, code, doc))
            doc, place, code = doc[order], place[order], code[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
            start = np.flatnonzero(new)
            gaps = np.diff(place, prepend=0)
            gaps[start] = place[start]
            bounds = np.append(start, len(doc)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(gaps.astype(np.int32)))
            at = pa.array(doc[start])
            yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(code[start])), batch.column("i").take(at), pa.array(np.diff(bounds)), pa.array(ends[doc[start]].astype(np.int32)), lists], names=["term", "i", "tf", "dl", "gaps"])

    return cut.mapInArrow(run, f"term string, i {docs.schema[id_col].dataType.simpleString()}, tf int, dl int, gaps array<int>")


def tokens_of(text: pa.StringArray):
    """All that ``TOKEN`` finds in texts without nulls, and how many each text has, by classes of UTF-8 bytes."""
    import numpy as np

    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    raw = text.buffers()[2] if len(text) and ends[-1] > ends[0] else b""
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if len(raw) else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    known = np.zeros(256, bool)
    for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xE1)):
        known[a : b + 1] = True
    data = np.append(data, np.zeros(2, np.uint8))
    ok = known[data]
    # Of longer characters the other bytes follow the first; the last ones with 0xE1 are beyond U+1EF9.
    lead = np.flatnonzero(ok & (data >= 0xC3))
    three = lead[data[lead] >= 0xE0]
    far = three[(data[three] == 0xE1) & ((data[three + 1] > 0xBB) | (data[three + 1] == 0xBB) & (data[three + 2] > 0xB9))]
    ok[lead + 1] = True
    ok[three + 2] = True
    for k in range(3):
        ok[far + k] = False
    data, ok = data[:-2], ok[:-2]
    begin = ok.copy()
    begin[1:] &= ~ok[:-1]
    at = ends[:-1][ends[:-1] < len(ok)]
    begin[at] = ok[at]  # a text's first token does not go on from the text before
    begin = np.flatnonzero(begin)
    inside = np.cumsum(ok, dtype=np.int32)
    offsets = np.append(inside[begin] - 1, inside[-1] if len(ok) else 0).astype(np.int32)
    found = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[ok].tobytes()))
    return found, np.diff(np.searchsorted(begin, ends))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, cut where the texts (column w) pass ``TEXT`` bytes; a longer text is one piece."""
    import pyarrow.compute as pc

    for batch in batches:
        size = pc.cumulative_sum(pc.cast(pc.binary_length(batch.column("w")), pa.int64())).to_numpy()
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(size.searchsorted((size[begin - 1] if begin else 0) + TEXT, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def blocks(docs: DataFrame, id_col: str, text: Column, positions: bool = True) -> DataFrame:
    """(term, n, most_tf, least_dl, docs, tfs, dls, gaps, bucket): the postings of each term in the documents of one batch,
    dealt by bucket and ``DEALS`` parts of its documents and sorted by term.  Without positions there are no gaps.

    They are packed where the documents are read, so the exchange carries a row for a term and batch, not for a posting.
    """
    cut = spread(docs.select(F.col(id_col).alias("i"), text.alias("w"))).select("i", F.lower("w").alias("w")).filter("w is not null")
    names = ["term", "n", "most_tf", "least_dl", "docs", "tfs", "dls", *(["gaps"] if positions else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        for batch in pieces(batches):
            batch = batch.take(pc.array_sort_indices(batch.column("i"), null_placement="at_start"))
            words, ends = tokens_of(batch.column("w"))
            if not len(words):
                continue
            terms = words.dictionary_encode()
            doc = np.repeat(np.arange(batch.num_rows, dtype=np.int32), ends)
            code = terms.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")  # documents and places stay in order
            doc, code = doc[order], code[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
            start = np.flatnonzero(new)
            tf, at, code = np.diff(np.append(start, len(doc))).astype(np.int32), doc[start], code[start]
            runs = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            within = np.arange(len(code)) - np.repeat(runs, np.diff(np.append(runs, len(code))))
            head = np.flatnonzero(within % BLOCK == 0)
            bounds = pa.array(np.append(head, len(code)).astype(np.int32))
            dl = ends[at].astype(np.int32)
            listed = lambda c: pa.ListArray.from_arrays(bounds, c)
            columns = [terms.dictionary.take(pa.array(code[head])), pa.array(np.diff(np.append(head, len(code))).astype(np.int32)), pa.array(np.maximum.reduceat(tf, head)), pa.array(np.minimum.reduceat(dl, head)), listed(batch.column("i").take(pa.array(at))), listed(pa.array(tf)), listed(pa.array(dl))]
            if positions:
                place = (np.arange(len(order)) - np.repeat(np.cumsum(ends) - ends, ends) + 1)[order]
                gaps = np.diff(place, prepend=0)
                gaps[start] = place[start]
                columns.append(listed(pa.ListArray.from_arrays(pa.array(np.append(start, len(doc)).astype(np.int32)), pa.array(gaps.astype(np.int32)))))
            whole = pa.RecordBatch.from_arrays(columns, names=names)
            yield from (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS))

    kind = docs.schema[id_col].dataType.simpleString()
    rows = cut.mapInArrow(run, f"term string, n int, most_tf int, least_dl int, docs array<{kind}>, tfs array<int>, dls array<int>" + (", gaps array<array<int>>" if positions else ""))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("bucket", bucket(F.col("term"))).repartition(tasks, "bucket", F.pmod(F.xxhash64(F.col("docs")[0]), F.lit(DEALS)))
    return rows.sortWithinPartitions("bucket", "term")


@dataclass
class TermIndex:
    """Blocks as ``blocks`` gives them, and one row (n, avgdl) of the corpus."""

    blocks: DataFrame
    corpus: DataFrame
    id_col: str

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text: Column, positions: bool = True) -> TermIndex:
        """The index of ``docs``, written to the shared folder; without positions it ranks all but ``every_cover``."""
        path = shared_folder(docs.sparkSession, "terms")
        blocks(docs, id_col, text, positions).write.partitionBy("bucket").parquet(f"{path}/blocks")
        held = cls.opened_blocks(docs.sparkSession, path)
        # A document without a token counts as one long.
        tokens = held.agg(F.coalesce(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("tokens"))
        numbers = docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.lower(text).rlike(TOKEN), F.lit(False))).alias("bare"))
        corpus = numbers.crossJoin(F.broadcast(tokens)).select("n", F.when(F.col("n") > 0, (F.col("tokens") + F.col("bare")) / F.col("n")).otherwise(1.0).alias("avgdl"))
        corpus.write.parquet(f"{path}/corpus")
        return cls(held, docs.sparkSession.read.parquet(f"{path}/corpus"), id_col)

    @classmethod
    def open(cls, spark: SparkSession, path: str, id_col: str) -> TermIndex:
        return cls(cls.opened_blocks(spark, path), spark.read.parquet(f"{path}/corpus"), id_col)

    @staticmethod
    def opened_blocks(spark: SparkSession, path: str) -> DataFrame:
        try:
            found = spark.read.parquet(f"{path}/blocks")
        except Exception as e:
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            # nothing was indexed
            found = spark.createDataFrame([], "term string, n int, most_tf int, least_dl int, docs array<bigint>, tfs array<int>, dls array<int>, gaps array<array<int>>, bucket int")
        return found

    def opened(self, terms: DataFrame, form: Form = PLAIN) -> DataFrame:
        """The blocks of the terms (column term), from the folders of these alone; where accents do not count, of all their
        spellings, as ``term`` without them."""
        folders = sorted(r.b for r in terms.select(bucket(F.col("term")).alias("b")).distinct().collect() if r.b is not None)  # BUCKETS at most
        wanted = terms.select("term").distinct()
        held = self.blocks.filter(F.col("bucket").isin(folders))
        held = held if form.accents else held.withColumn("term", folded(F.col("term")))
        return held.join(F.broadcast(wanted) if is_small(wanted) else wanted, "term", "left_semi")

    def matches(self, terms: DataFrame, *more: str, form: Form = PLAIN) -> DataFrame:
        """(term, id, tf, dl, and ``more``: gaps) of the terms' postings."""
        rows = self.opened(terms, form).select("term", F.explode(F.arrays_zip("docs", "tfs", "dls", *more)).alias("x"))
        return rows.select("term", F.col("x.docs").alias(self.id_col), F.col("x.tfs").alias("tf"), F.col("x.dls").alias("dl"), *(F.col(f"x.{c}") for c in more))

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """(term, df) from the heads of the blocks."""
        return self.opened(terms).groupBy("term").agg(F.sum("n").alias("df"))

    def bm25(self, terms: DataFrame, query_col: str, form: Form = PLAIN) -> DataFrame:
        """(query, id, score) of all documents that hold a term of a question; ``terms`` is (query, term), distinct, with
        ``times`` if some count more than once.  Spellings that one form takes as one term are added up a document."""
        few = is_small(terms)
        send = F.broadcast if few else lambda x: x
        n, avgdl = self.corpus.first()
        held = self.matches(terms, form=form)
        if form.accents:
            frequencies = self.frequencies(terms)
        else:
            held = kept(held.groupBy("term", self.id_col).agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl")))
            frequencies = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weight = form.weight(F.lit(n), F.col("df"), F.col("tf"), F.col("dl"), F.lit(avgdl))
        scored = held.join(send(frequencies), "term").select(self.id_col, "term", weight.alias("w"))
        return scored.join(send(terms), "term").groupBy(query_col, self.id_col).agg(total(terms).alias("score"))

    def any_cover(self, terms: DataFrame, query_col: str) -> DataFrame:
        """(query, id, rank_cd): cover density of questions that any of their terms meets.  A cover is then a single
        place, so only frequencies are read."""
        few = is_small(terms)
        held = self.matches(terms).join(F.broadcast(terms) if few else terms, "term")
        return held.groupBy(query_col, self.id_col).agg(F.sum("tf").alias("places")).select(query_col, self.id_col, (F.col("places") * COVER / (F.col("places") * COVER + 1)).alias("rank_cd"))

    def every_cover(self, terms: DataFrame, query_col: str) -> DataFrame:
        """(query, id, covers, rank_cd): cover density of documents that hold all terms of a question.

        A cover is a stretch of text that holds all terms and no shorter one that does; it counts ``COVER`` over one
        plus the places in it that hold none.  The sum w is given as w / (w + 1).
        """
        few = is_small(terms)
        send = F.broadcast if few else lambda x: x
        sizes = terms.groupBy(query_col).agg(F.count(F.lit(1)).alias("asked"))
        held = self.matches(terms, "gaps").join(send(terms), "term").select(query_col, self.id_col, "gaps")
        grouped = held.groupBy(query_col, self.id_col).agg(F.collect_list("gaps").alias("lists")).join(send(sizes), query_col).filter(F.size("lists") == F.col("asked"))
        schema = f"{query_col} {terms.schema[query_col].dataType.simpleString()}, {self.id_col} {grouped.schema[self.id_col].dataType.simpleString()}, covers long, w double"
        names = (query_col, self.id_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [covers(row) for row in batch.column("lists").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([len(x) for x in found], pa.int64()), pa.array([sum(COVER / (1 + (e - b) - (m - 1)) for b, e, m in x) for x in found], pa.float64())], names=[*names, "covers", "w"])

        out = grouped.select(*names, "lists").mapInArrow(run, schema)
        return out.select(*names, "covers", (F.col("w") / (F.col("w") + 1)).alias("rank_cd"))

    def best(self, terms: DataFrame, query_col: str, k: int, form: Form = PLAIN) -> DataFrame:
        """(query, id, score, rank): the k best documents of each question by BM25."""
        if not is_small(terms):
            return top(self.bm25(terms, query_col, form), k, query_col, self.id_col)
        return top(self.ranked(terms, query_col, k, "score", form).drop("rank_cd"), k, query_col, self.id_col)

    def preselected(self, terms: DataFrame, query_col: str, limit: int) -> DataFrame:
        """(query, id, rank_cd, score, rank): the ``limit`` documents of each question of greatest cover density, in the
        order of BM25."""
        if is_small(terms):
            chosen = top(self.ranked(terms, query_col, limit, "rank_cd"), limit, query_col, self.id_col, "rank_cd").drop("rank")
            return top(chosen, limit, query_col, self.id_col)
        chosen = top(self.any_cover(terms, query_col), limit, query_col, self.id_col, "rank_cd").drop("rank")
        return top(chosen.join(self.bm25(terms, query_col), [query_col, self.id_col]), limit, query_col, self.id_col)

    def ranked(self, terms: DataFrame, query_col: str, k: int, by: str, form: Form = PLAIN) -> DataFrame:
        """(query, id, rank_cd, score): of each task's documents those that can be among the k first by ``by``, all that tie
        in doubt included.

        The questions' postings meet once, a row a document; a task then adds up all questions' scores of its documents,
        so pairs of question and document are never exchanged.  Questions' terms are as many as can be sent.
        """
        import numpy as np

        spark = terms.sparkSession
        rows = terms.collect()
        asked, words = list(dict.fromkeys(r[query_col] for r in rows)), list(dict.fromkeys(r.term for r in rows))
        number, code = {q: j for j, q in enumerate(asked)}, {w: j for j, w in enumerate(words)}
        codes = spark.createDataFrame([(w, j) for w, j in code.items() if w is not None], "term string, t int")
        held = self.matches(terms, form=form).join(F.broadcast(codes), "term").select(self.id_col, "t", "tf", "dl")
        docs = kept(dealt(held, self.id_col).groupBy(self.id_col).agg(F.sort_array(F.collect_list(F.struct("t", "tf", "dl"))).alias("held")))
        if form.accents:
            found = {code[r.term]: r.df for r in self.frequencies(terms).collect()}
        else:
            found = {r.t: r.df for r in docs.select(F.explode(F.array_distinct("held.t")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}
        n, avgdl = self.corpus.first()
        df = np.array([found.get(j, 0) for j in range(len(words))], float)
        rare = form.rarity(n, df)
        # Questions by term: those of term t are from first[t] on.
        pairs = sorted((code[r.term], number[r[query_col]], r.times if "times" in terms.columns else 1) for r in rows)
        first = np.searchsorted([t for t, _, _ in pairs], np.arange(len(words) + 1))
        who, times = np.array([q for _, q, _ in pairs], np.int64), np.array([x for _, _, x in pairs], float)
        asked = pa.array(asked)
        merged, id_col = not form.accents, self.id_col

        def scores(t, tf, dl, row, m):
            """(row, question, places, score) of the rows' pairs, by postings in the order of rows."""
            if merged:
                start = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (t[1:] != t[:-1])))
                t, row, tf, dl = t[start], row[start], np.add.reduceat(tf, start), np.maximum.reduceat(dl, start)
            w = rare[t] * form.saturated(tf, dl, avgdl)
            many = first[t + 1] - first[t]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first[t], many)
            keys = np.repeat(row, many) * len(asked) + who[at]
            spots, sums = None, [np.repeat(tf, many).astype(float), np.repeat(w, many) * times[at]]
            if m * len(asked) > 4 * len(keys):
                spots, keys = np.unique(keys, return_inverse=True)
            places, score = (np.bincount(keys, x) for x in sums)
            there = np.flatnonzero(places) if spots is None else slice(None)
            spots = there if spots is None else spots
            return spots // len(asked), spots % len(asked), places[there], score[there]

        def first_k(q, value, place):
            """Which of the rows can be among the k first, and of each question from what value on."""
            order = np.lexsort((place, -value, q))
            q, value = q[order], value[order]
            start = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            size = np.diff(np.append(start, len(q)))
            least = np.full(len(asked), -np.inf)
            least[q[start[size >= k]]] = value[start[size >= k] + k - 1] - 2e-9
            tie = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (value[1:] != value[:-1])))
            within = np.arange(len(q)) - np.repeat(tie, np.diff(np.append(tie, len(q))))
            return order[(value >= least[q]) & (within < k)], least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.compute as pc

            least, kept_ids, kept_rows = np.full(len(asked), -np.inf), None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, lists = batch.column(id_col), batch.column("held")
                ends = lists.offsets.to_numpy()
                flat = lists.values
                t, tf, dl = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                pairs_to = np.append(0, np.cumsum(first[t + 1] - first[t]))[ends]
                begin = 0
                while begin < batch.num_rows:
                    end = max(begin + 1, int(np.searchsorted(pairs_to, pairs_to[begin] + PAIRS, "right")) - 1)
                    part = slice(ends[begin], ends[end])
                    row, q, places, score = scores(t[part].astype(np.int64), tf[part].astype(np.int64), dl[part], np.repeat(np.arange(end - begin), np.diff(ends[begin : end + 1])), end - begin)
                    cd = places * COVER / (places * COVER + 1)
                    can = (score if by == "score" else cd) >= least[q]
                    found = np.stack([q[can], cd[can], score[can]])
                    near = ids.take(pa.array(row[can] + begin))
                    begin = end
                    if kept_ids is not None:
                        near, found = pa.concat_arrays([kept_ids, near]), np.concatenate([kept_rows, found], axis=1)
                    if not len(near):
                        continue
                    place = pc.rank(near, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
                    chosen, least = first_k(found[0].astype(np.int64), found[2 if by == "score" else 1], place)
                    kept_ids, kept_rows = near.take(pa.array(chosen)), found[:, chosen]
            if kept_ids is not None:
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(kept_rows[0].astype(np.int64))), kept_ids, pa.array(kept_rows[1]), pa.array(kept_rows[2])], names=[query_col, id_col, "rank_cd", "score"])

        schema = f"{query_col} {terms.schema[query_col].dataType.simpleString()}, {id_col} {docs.schema[id_col].dataType.simpleString()}, rank_cd double, score double"
        return docs.mapInArrow(run, schema)


def covers(gaps: list[list[int]]) -> list[tuple[int, int, int]]:
    """(first place, last place, places of terms within) of the shortest stretches that hold a place of every list."""
    import numpy as np

    place = np.concatenate([np.cumsum(g) for g in gaps])
    owner = np.repeat(np.arange(len(gaps)), [len(g) for g in gaps])
    order = np.argsort(place, kind="stable")
    place, owner = place[order].tolist(), owner[order].tolist()
    last, begin, out = [-1] * len(gaps), -1, []
    for k, who in enumerate(owner):
        last[who] = k
        first = min(last)
        if first > begin:
            begin = first
            out.append((place[first], place[k], k - first + 1))
    return out
