"""The queries of this subpackage: each operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.llm import byte_bpe, decontaminate, fill_in_middle, jaccard, language, lexical_search, line_dedup, main_text, packing, repeats, sharding, token_counts, topk

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), WORD_BPE)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.drop_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(~language.is_held_out(F.col("doc_id"))))
    out = language.languages(docs, model)
    return out.select("doc_id", F.coalesce(language.is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trips(table(spark, sf_dir, "documents"), BYTE_BPE)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_products(vectors, vectors["vec_id"] % 50 == 0)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(table(spark, sf_dir, "pages"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")).drop("output")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_counts, op2_line_dedup, op3_jaccard_join, op4_language, op5_repeats, op6_packing, op7_sharding, op8_byte_bpe, op9_topk, op10_decontaminate, op11_lexical_search, op12_main_text, op13_fill_in_middle)
    return {f.__name__: f for f in own}


SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES_SQL = f"""
WITH l AS (
  SELECT d.rn, d.doc_id, u.k, u.line, {LOWER.format(f"trim(u.line, {SPACE})")} AS key
  FROM (SELECT row_number() OVER () AS rn, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) d,
       LATERAL (SELECT unnest(d.lines) AS line, generate_subscripts(d.lines, 1) AS k) u
), hot AS (
  SELECT key, max(doc_id) AS owner FROM l WHERE length(key) >= 20 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT rn) >= 3
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot.owner <> l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE hot.owner IS NULL OR l.doc_id IS NULL OR hot.owner = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN hot ON l.key = hot.key GROUP BY l.rn, l.doc_id
"""

WORDS = "list_filter(regexp_split_to_array({}, {}), lambda w: w <> '')"

REPEATS_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM d WHERE len(w) >= 50
), h AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM win
), s AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS least FROM h) WHERE least < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM s
), word AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT word.doc_id, count(*) AS n_words, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL) AS t
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


ITEM_WORDS = "regexp_extract_all(" + LOWER.format("coalesce({}, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

LEAKS_SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS id, {ITEM_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rn, doc_id, {ITEM_WORDS.format('text')} AS w FROM documents),
dw AS (SELECT rn, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) z WHERE len(w) >= n)),
hit AS (SELECT DISTINCT rn, k, dw.n, id FROM dw JOIN win ON win.n = dw.n AND win.s = dw.s),
place AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(k, k + n)) AS p FROM hit) GROUP BY rn),
item AS (SELECT rn, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS items FROM hit GROUP BY rn)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN place ON place.rn = d.rn LEFT JOIN item ON item.rn = d.rn
"""

JACCARD_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {ITEM_WORDS.format('text')} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM d WHERE len(w) > 0),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM inter WHERE i >= 0.8::DOUBLE * (na + nb - i) - 1e-9),
reach(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id),
class AS (SELECT id, min(root) AS class_id FROM reach GROUP BY id),
rep AS (SELECT array_to_string(w, ' ') AS t, min(doc_id) AS rep_id FROM d WHERE len(w) > 0 GROUP BY ALL),
many AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT d.doc_id, class_id, coalesce(rep_id, d.doc_id) AS rep_id, coalesce(many.n, 0) AS n_links
FROM d JOIN class ON class.id = d.doc_id LEFT JOIN rep ON rep.t = array_to_string(d.w, ' ') AND len(d.w) > 0 LEFT JOIN many ON many.a = d.doc_id
"""


RANKED_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {ITEM_WORDS.format('text')} AS w FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT rn, doc_id, n, t, count(*) AS tf FROM (SELECT rn, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
c AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
f AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
i AS (SELECT q, item_id, unnest(list_distinct(w)) AS t FROM (SELECT row_number() OVER () AS q, item_id, {ITEM_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL)),
s AS (SELECT q, item_id, rn, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score FROM i JOIN f USING (t) JOIN p USING (t), c GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

MARKED = "(t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100)"

MIDDLE_SQL = f"""
WITH x AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM x),
k AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN {MARKED} THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINES_SQL, "op3_jaccard_join": JACCARD_SQL, "op5_repeats": REPEATS_SQL, "op9_topk": TOPK_SQL, "op10_decontaminate": LEAKS_SQL, "op11_lexical_search": RANKED_SQL, "op13_fill_in_middle": MIDDLE_SQL}
