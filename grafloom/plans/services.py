"""Queries of answer resolution, versioned indexing, projections and checks of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.functions.words import OFFICIAL
from grafloom.operators import answers, indexing, merge, records
from grafloom.plans.book import Book, table
from grafloom.plans.operations import NOW, now

BOOK = Book()
CODE_SQL = "regexp_extract(upper({0}), '\\b\\d{{1,4}}/\\d{{4}}/[A-ZĐ][A-ZĐ0-9-]{{1,30}}\\b')"
#: Sources of questions: each turn of a conversation names a law by its number, a document, or nothing.
NAMED = "CASE turn % 4 WHEN 0 THEN 'Luật ' || (conv_id % 90 + 1) || '/2019/qh14' WHEN 1 THEN 'Nghị định ' || (turn + conv_id % 7 + 1) || '/2020/NĐ-CP của CP' ELSE '' END"
SOURCES = f"src AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rank, {NAMED} AS citation, CASE WHEN turn % 4 = 3 THEN '' ELSE role END AS title, 'd' || conv_id % 40 AS doc_id, text FROM conversations)"
LAWS = f"law AS (SELECT *, coalesce(nullif({CODE_SQL.format(chr(39) + chr(39) + ' || citation || ' + chr(39) + ' ' + chr(39) + ' || title')}, ''), substring(coalesce(nullif(doc_id, ''), nullif(title, ''), 'Không rõ'), 1, 120)) AS code FROM src)"
STATE = "(['IN_FORCE','AMENDED','IN_FORCE','REPLACED','PARTIALLY_IN_FORCE','IN_FORCE','UNKNOWN'])[{0} % 7 + 1]"
#: The registry: laws by number, some documents, verified at the events of a user.
REGISTRY = f"reg AS (SELECT code, {STATE.format('k')} AS status, TIMESTAMP '2024-01-14 00:00:00' + to_hours(CAST(k % 30 AS BIGINT)) AS verified_at FROM (SELECT (k + 1) || '/2019/QH14' AS code, k FROM (SELECT unnest(range(90)) AS k) UNION ALL SELECT k || '/2020/NĐ-CP', k + 3 FROM (SELECT unnest(range(1, 20)) AS k) UNION ALL SELECT 'd' || k, k * 3 FROM (SELECT unnest(range(0, 40, 2)) AS k)))"
ITEMS = f"{SOURCES}, {LAWS}, {REGISTRY}, fst AS (SELECT conv_id, code, min(rank) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY min(rank), code) AS place FROM law GROUP BY conv_id, code), it AS (SELECT fst.conv_id, fst.code, coalesce(status, 'UNKNOWN') AS status, coalesce(verified_at >= {NOW} - INTERVAL 24 HOUR, false) AS fresh FROM fst LEFT JOIN reg USING (code) WHERE place <= 16)"


def sources(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    turn, conv = F.col("turn"), F.col("conv_id")
    law = F.concat(F.lit("Luật "), conv % 90 + 1, F.lit("/2019/qh14"))
    decree = F.concat(F.lit("Nghị định "), turn + conv % 7 + 1, F.lit("/2020/NĐ-CP của CP"))
    named = F.when(turn % 4 == 0, law).when(turn % 4 == 1, decree).otherwise("")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return table(spark, d, "conversations").select("conv_id", rank.alias("rank"), named.alias("citation"), F.when(turn % 4 == 3, "").otherwise(F.col("role")).alias("title"), F.concat(F.lit("d"), conv % 40).alias("doc_id"), "text")


def registry(spark: SparkSession) -> DataFrame:
    k = F.col("k")
    states = F.array(*[F.lit(s) for s in ("IN_FORCE", "AMENDED", "IN_FORCE", "REPLACED", "PARTIALLY_IN_FORCE", "IN_FORCE", "UNKNOWN")])
    laws = spark.range(90).select(F.concat((F.col("id") + 1).cast("string"), F.lit("/2019/QH14")).alias("code"), F.col("id").alias("k"))
    decrees = spark.range(1, 20).select(F.concat(F.col("id").cast("string"), F.lit("/2020/NĐ-CP")).alias("code"), (F.col("id") + 3).alias("k"))
    docs = spark.range(0, 40, 2).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("code"), (F.col("id") * 3).alias("k"))
    verified = F.lit("2024-01-14 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(k % 30).cast("int"))
    return laws.unionByName(decrees).unionByName(docs).select("code", F.element_at(states, (k % 7 + 1).cast("int")).alias("status"), verified.alias("verified_at"))


@BOOK.add(f"WITH {SOURCES}, {LAWS} SELECT conv_id, rank, code, substring(coalesce(nullif(title, ''), nullif(citation, ''), code), 1, 500) AS title FROM law")
def law_identity(spark: SparkSession, d: str) -> DataFrame:
    law = records.law_identity(F.col("citation"), F.col("title"), F.col("doc_id"))
    return sources(spark, d).select("conv_id", "rank", law.alias("law")).select("conv_id", "rank", "law.code", "law.title")


@BOOK.add(f"WITH {ITEMS} SELECT conv_id, count(*) AS n_laws, bool_and(fresh) AS checked, bool_and(fresh) AND bool_and(status IN ('IN_FORCE', 'PARTIALLY_IN_FORCE', 'AMENDED')) AS all_current FROM it GROUP BY conv_id")
def verification_report(spark: SparkSession, d: str) -> DataFrame:
    return answers.verified(answers.laws_of(sources(spark, d), "conv_id"), registry(spark), "conv_id", now())[1]


USABLE = f"{ITEMS}, bl AS (SELECT conv_id, upper(code) AS code FROM it WHERE status IN ('EXPIRED', 'REPLACED', 'UNKNOWN')), us AS (SELECT s.conv_id, row_number() OVER (PARTITION BY s.conv_id ORDER BY s.rank) AS rank, s.citation, s.title FROM src s WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.conv_id = s.conv_id AND contains(upper(s.citation || ' ' || s.title), bl.code)))"


@BOOK.add(f"WITH {USABLE} SELECT conv_id, rank, 'S' || rank AS source_id, citation, title FROM us")
def resolve_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources that are checked, less those of laws out of force, numbered anew."""
    kept, _ = answers.resolved(sources(spark, d), registry(spark), "conv_id", now())
    return kept.select("conv_id", "rank", "source_id", "citation", "title")


@BOOK.add(f"WITH {USABLE} SELECT i.conv_id, bool_or(u.conv_id IS NOT NULL) AS answerable FROM (SELECT DISTINCT conv_id FROM it) i LEFT JOIN us u USING (conv_id) GROUP BY i.conv_id")
def answerable(spark: SparkSession, d: str) -> DataFrame:
    return answers.resolved(sources(spark, d), registry(spark), "conv_id", now())[1].select("conv_id", "answerable")


@BOOK.add(
    "SELECT item_id AS query_id, CASE WHEN item_id % 3 = 2 OR item_id % 5 = 1 OR item_id % 4 = 0 OR item_id % 7 = 3 THEN 'miss' WHEN item_id % 2 = 0 THEN 'exact' ELSE 'semantic_draft' END AS mode, CASE WHEN item_id % 3 <> 2 THEN item_id + 1000 END AS cache_id, item_id % 3 <> 2 AND (item_id % 5 = 1 OR item_id % 4 = 0 OR item_id % 7 = 3) AS invalidate FROM benchmark"
)
def cache_decision(spark: SparkSession, d: str) -> DataFrame:
    """Cached answers whose laws are no longer in force, were not checked, or rest on something else, do not answer."""
    i = F.col("item_id")
    items = table(spark, d, "benchmark").select("item_id")
    hits = items.select(i.alias("query_id"), F.when(i % 3 != 2, i + 1000).alias("cache_id"), F.when(i % 3 == 2, "miss").when(i % 2 == 0, "exact").otherwise("semantic").alias("kind"))
    cache = items.select((i + 1000).alias("id"), F.md5(i.cast("string")).alias("law_fingerprint"))
    prints = items.select((i + 1000).alias("cache_id"), F.md5(F.when(i % 5 == 1, F.lit("other")).otherwise(i.cast("string"))).alias("fingerprint"))
    reports = items.select((i + 1000).alias("cache_id"), (i % 7 != 3).alias("checked"), (i % 4 != 0).alias("all_current"))
    return answers.decided(hits, cache, reports, prints, "query_id")


OLD = "o AS (SELECT doc_id AS code, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE md5(text) END AS checksum, 1 + doc_id % 3 AS version FROM documents WHERE doc_id % 3 <> 0), nw AS (SELECT doc_id AS code, CASE WHEN doc_id % 4 = 0 THEN md5(lang || text) ELSE md5(text) END AS checksum FROM documents WHERE doc_id % 3 <> 1)"


@BOOK.add(
    f"""WITH {OLD}, v AS (SELECT nw.code, CASE WHEN o.checksum IS NOT NULL THEN o.version + 1 ELSE coalesce(o.version, 1) END AS version FROM nw LEFT JOIN o USING (code) WHERE o.checksum IS DISTINCT FROM nw.checksum),
    oc AS (SELECT o.code, v.v AS version, 'c' || o.code || ':' || v.v || ':' || k AS chunk_id FROM o, (SELECT unnest([1, 2, 3]) AS v) v, (SELECT unnest([0, 1]) AS k) k WHERE v.v <= o.version)
    SELECT code, version, chunk_id FROM oc WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.code = oc.code AND v.version = oc.version) UNION ALL SELECT code, version, 'n' || code FROM v"""
)
def version_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of new versions replace what was there of the same version; older versions stay."""
    docs = table(spark, d, "documents")
    i = F.col("doc_id")
    old = docs.filter(i % 3 != 0).select(i.alias("code"), F.when(i % 5 != 0, F.md5("text")).alias("checksum"), (i % 3 + 1).alias("version"), F.lit("IN_FORCE").alias("status"))
    new = docs.filter(i % 3 != 1).select(i.alias("code"), F.when(i % 4 == 0, F.md5(F.concat("lang", "text"))).otherwise(F.md5("text")).alias("checksum"), F.lit("AMENDED").alias("status"))
    held = old.select("code", F.explode(F.sequence(F.lit(1), F.col("version"))).alias("version"), F.array(F.lit(0), F.lit(1)).alias("k")).select("code", "version", F.explode("k").alias("k"))
    held = held.select("code", "version", F.concat(F.lit("c"), "code", F.lit(":"), "version", F.lit(":"), "k").alias("chunk_id"))
    fresh = new.select("code", F.lit(None).cast("long").alias("version"), F.concat(F.lit("n"), "code").alias("chunk_id"))
    return indexing.index_candidates(old, held, new, fresh)[1]


LAW_ROWS = "lw AS (SELECT doc_id AS code, 1 + doc_id % 2 AS version, CASE WHEN doc_id % 4 = 0 THEN doc_id + 1 END AS rep FROM documents), ch AS (SELECT 'c' || code || ':' || k AS chunk_id, 'law:' || code || ':v' || version || ':section:' || k // 2 AS node_id, 'law:' || code || ':v' || version AS law FROM lw, (SELECT unnest([0, 1, 2]) AS k) k)"


def laws(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    i = F.col("doc_id")
    text = lambda c: c.cast("string")
    own = docs.select(text(i).alias("code"), (i % 2 + 1).alias("version"), text(i).alias("doc_id"), F.col("source").alias("title"), F.lit("IN_FORCE").alias("status"), F.when(i % 4 == 0, text(i + 1)).alias("replaces"), "text")
    parts = own.select("code", "version", "text", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    parts = parts.select(F.concat(F.lit("c"), "code", F.lit(":"), "k").alias("chunk_id"), "code", "version", F.concat(F.lit("law:"), "code", F.lit(":v"), "version", F.lit(":section:"), F.floor(F.col("k") / 2)).alias("node_id"), F.lit("section").alias("chunk_type"), F.concat(F.lit("§"), F.floor(F.col("k") / 2)).alias("citation"), "text", F.col("k").alias("ordinal"))
    old = docs.select(F.concat(F.lit("law:"), i, F.lit(":v0")).alias("node_id"), text(i).alias("code"))
    return own.drop("text"), parts, old


@BOOK.add(f"WITH {LAW_ROWS} SELECT chunk_id AS source_id, 'CHUNK_OF' AS relation, node_id AS target_id FROM ch UNION SELECT node_id, 'BELONGS_TO', law FROM ch UNION SELECT 'law:' || lw.code || ':v' || lw.version, 'REPLACES', 'law:' || d.doc_id || ':v' || v FROM lw JOIN (SELECT doc_id, 0 AS v FROM documents UNION ALL SELECT doc_id, 1 + doc_id % 2 FROM documents) d ON d.doc_id = lw.rep")
def law_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    own, parts, old = laws(spark, d)
    return indexing.graph_of(own, parts, old)[1]


@BOOK.add(f"WITH {LAW_ROWS} SELECT 'law:' || code || ':v' || version AS node_id, 'document' AS node_type, CAST(code AS VARCHAR) AS code FROM lw UNION SELECT node_id, 'section', NULL FROM ch")
def law_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    own, parts, old = laws(spark, d)
    return indexing.graph_of(own, parts, old)[0].select("node_id", "node_type", "code")


@BOOK.add("SELECT source AS chunk_id, min(doc_id) AS ordinal, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def chunk_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("chunk_id"), F.col("doc_id").alias("ordinal"), "lang")
    return indexing.first_chunks(rows)


@BOOK.add("SELECT event_type AS rel_type, count(*) AS n, min(user_id) AS first_source FROM events GROUP BY event_type")
def edges_by_type(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("rel_type"), F.col("user_id").alias("source_id"), F.col("event_id").alias("target_id"))
    blocks = indexing.of_type(e)
    return blocks.groupBy("rel_type").agg(F.sum("n").alias("n"), F.min(F.col("edges")[0]["source_id"]).alias("first_source"))


@BOOK.add("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS n FROM documents) WHERE n <= 5")
def chunks_of_node(spark: SparkSession, d: str) -> DataFrame:
    return records.of_each(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", ["n_chars", "doc_id"]).drop("n_chars")


@BOOK.add("SELECT conv_id, doc_id, conv_id % 40 = doc_id AS found FROM (SELECT DISTINCT conv_id FROM conversations) c, (SELECT unnest(range(40)) AS doc_id) d WHERE (conv_id + doc_id) % 2 = 0")
def owned_rows(spark: SparkSession, d: str) -> DataFrame:
    """Who asks for a conversation gets it only if it is theirs."""
    convs = table(spark, d, "conversations").select("conv_id").distinct()
    mine = convs.select("conv_id", (F.col("conv_id") % 40).alias("doc_id"))
    asked = convs.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("doc_id")).filter((F.col("conv_id") + F.col("doc_id")) % 2 == 0)
    return records.owned(mine, asked, "conv_id", "doc_id")


SHOWN = "CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN '' END"


@BOOK.add(f"SELECT doc_id, 'S' || doc_id % 9 AS source_id, round(doc_id / 7.0::DOUBLE, 4) AS score, substring(coalesce(nullif({SHOWN}, ''), nullif(CASE WHEN doc_id % 6 <> 1 THEN repeat(source, 200) END, ''), 'Nguồn pháp lý'), 1, 500) AS citation, md5(substring(coalesce(text, ''), 1, 5000)) AS text_md5, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END AS shown_doc FROM documents")
def source_projection(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    citation = F.when(i % 3 == 0, F.col("lang")).when(i % 3 == 1, "")
    shown = records.shown(i % 9, i / 7.0, citation, F.when(i % 6 != 1, F.repeat("source", F.lit(200))), F.col("text"), F.lit(None).cast("array<string>"), F.when(i % 2 == 0, i.cast("string")).otherwise(""), F.lit(None).cast("string"))
    return table(spark, d, "documents").select("doc_id", shown.alias("s")).select("doc_id", "s.source_id", "s.score", "s.citation", F.md5("s.text").alias("text_md5"), F.col("s.doc_id").alias("shown_doc"))


TIDY = "trim(regexp_replace(regexp_replace(replace(replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))"


@BOOK.add(f"SELECT doc_id, md5(CASE WHEN c <> '' AND t <> '' THEN c || chr(10) || t WHEN t <> '' THEN t ELSE c END) AS context_md5 FROM (SELECT doc_id, {TIDY.format('coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN source END, ' + chr(39) + chr(39) + '), lang, ' + chr(39) + chr(39) + ')')} AS c, {TIDY.format('CASE WHEN doc_id % 5 = 0 THEN ' + chr(39) + ' ' + chr(39) + ' ELSE coalesce(text, ' + chr(39) + chr(39) + ') END')} AS t FROM documents)")
def context_projection(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    context = records.context_text(F.when(i % 2 == 0, F.col("source")), F.col("lang"), F.when(i % 5 == 0, " ").otherwise(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.md5(context).alias("context_md5"))


@BOOK.add("SELECT conv_id, turn, md5('{\"conversation_id\":' || conv_id || ',\"role\":\"' || lower(role) || '\",\"content\":\"' || length(text) || '\",\"created_at\":\"' || strftime(TIMESTAMP '2024-01-15 00:00:00' + to_minutes(CAST(turn AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || '\"}') AS json_md5 FROM conversations")
def message_projection(spark: SparkSession, d: str) -> DataFrame:
    created = now() + F.make_dt_interval(mins=F.col("turn").cast("int"))
    shown = records.message_json(F.col("conv_id"), F.upper("role"), F.length("text").cast("string"), created)
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(shown).alias("json_md5"))


@BOOK.add("SELECT page_id, 'W' || row_number() OVER (PARTITION BY page_id % 50 ORDER BY page_id) AS id, md5(substring(CASE WHEN page_id % 3 = 0 THEN url ELSE html END, 1, 7000)) AS evidence_md5 FROM pages")
def evidence_projection(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").withColumn("batch", F.col("page_id") % 50)
    raw = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("html"))
    return records.numbered(pages, [F.col("page_id")], "W", "batch").select("page_id", "id", F.md5(records.evidence(raw, F.col("url"))).alias("evidence_md5"))


@BOOK.add("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y%m%d-%H%M%S') AS stamp, round(epoch_us(ts + to_milliseconds(CAST(event_id % 1000 AS BIGINT))) / 1e6 - epoch_us(ts) / 1e6, 4) AS elapsed FROM events")
def timestamps(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    later = ts + F.make_dt_interval(secs=(F.col("event_id") % 1000 / 1000).cast("decimal(18,6)"))
    return table(spark, d, "events").select("event_id", records.iso(ts).alias("iso"), records.stamp(ts).alias("stamp"), records.elapsed(ts, later).alias("elapsed"))


@BOOK.add("SELECT doc_id, coalesce(nullif(substring(trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-'), 1, 180), ''), 'bai-viet') || '-' || substring(sha256(CAST(doc_id AS VARCHAR)), 1, 6) AS slug FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '?!' ELSE substring(text, 1, 220) END AS t FROM documents)")
def post_slugs(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 10 == 0, "?!").otherwise(F.substring("text", 1, 220))
    return table(spark, d, "documents").select("doc_id", records.post_slug(title, F.col("doc_id")).alias("slug"))


@BOOK.add("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(source || ' , ,' || lang || ',' || doc_id, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM documents")
def csv_settings(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("source", F.lit(" , ,"), "lang", F.lit(","), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", F.array_join(records.split_csv(text), "|").alias("parts"))


@BOOK.add("SELECT conv_id, count(*) FILTER (WHERE turn % 3 <> 1) AS n_expected, string_agg(CASE WHEN turn % 3 <> 1 THEN 'c' || turn END, ',' ORDER BY turn, role, text) AS expected FROM conversations GROUP BY conv_id")
def expected_contexts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", F.struct("turn", "role", "text", F.when(F.col("turn") % 3 == 1, "").otherwise(F.concat(F.lit("c"), "turn")).alias("chunk_id")).alias("x"))
    ids = records.expected_ids(F.array_sort("c"))
    found = rows.groupBy("conv_id").agg(F.collect_list("x").alias("c")).select("conv_id", ids.alias("ids"))
    return found.select("conv_id", F.size("ids").cast("long").alias("n_expected"), F.nullif(F.array_join("ids", ","), F.lit("")).alias("expected"))


VERDICTS = "CASE doc_id % 6 WHEN 0 THEN '{\"code\":\"c\",\"title\":\"t\",\"status\":\"EXPIRED\",\"source_url\":null,\"replacement_code\":\"' || doc_id || '\",\"replacement_title\":null,\"replacement_url\":null,\"reason\":\"r\",\"confidence\":0.5}' WHEN 1 THEN '{\"code\":\"c\",\"title\":\"t\",\"status\":\"GONE\",\"source_url\":null,\"replacement_code\":null,\"replacement_title\":null,\"replacement_url\":null,\"reason\":\"r\",\"confidence\":0.5}' WHEN 2 THEN '{\"code\":\"c\"}' WHEN 3 THEN 'no json' WHEN 4 THEN '{\"code\":\"c\",\"title\":\"t\",\"status\":\"AMENDED\",\"source_url\":\"u\",\"replacement_code\":null,\"replacement_title\":null,\"replacement_url\":null,\"reason\":\"r\",\"confidence\":1}' ELSE '{\"code\":\"c\",\"title\":\"t\",\"status\":\"AMENDED\",\"source_url\":null,\"replacement_code\":null,\"replacement_title\":null,\"replacement_url\":null,\"reason\":\"r\",\"confidence\":1.5,\"more\":1}' END"


@BOOK.add("SELECT doc_id, doc_id % 6 IN (0, 4) AS valid, CASE doc_id % 6 WHEN 0 THEN 'EXPIRED' WHEN 4 THEN 'AMENDED' END AS status, CASE doc_id % 6 WHEN 0 THEN CAST(doc_id AS VARCHAR) END AS replacement_code FROM documents")
def verdict_objects(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of a model, of which only those that fit the schema count."""
    payload = F.expr(VERDICTS.replace("doc_id || ", "cast(doc_id as string) || "))
    value = records.checked(payload, records.VERDICT)
    return table(spark, d, "documents").select("doc_id", value.alias("v")).select("doc_id", F.col("v").isNotNull().alias("valid"), "v.status", "v.replacement_code")


@BOOK.add("SELECT doc_id, md5('{\"verdict\":\"' || lang || '\",\"evidence\":[' || doc_id || ',' || n_chars || ']}') AS payload_md5 FROM documents")
def verdict_payloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(records.verdict_payload(F.col("lang"), F.array("doc_id", "n_chars"))).alias("payload_md5"))


HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"


@BOOK.add(f"SELECT count(*) AS checked, count(*) FILTER (WHERE r.status = 'REPLACED') AS updated, count(*) FILTER (WHERE r.code IS NULL) AS failed FROM (SELECT DISTINCT code FROM ({{}})) c LEFT JOIN ({{}}) r USING (code)".format(f"WITH {SOURCES}, {LAWS} SELECT code FROM law", f"WITH {REGISTRY} SELECT * FROM reg"))
def recheck_report(spark: SparkSession, d: str) -> DataFrame:
    """The nightly check: every law that a source names, looked up anew."""
    named = sources(spark, d).select(records.law_identity(F.col("citation"), F.col("title"), F.col("doc_id")).getField("code").alias("code")).distinct()
    joined = named.join(registry(spark).select("code", "status"), "code", "left")
    return joined.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("status") == "REPLACED").alias("updated"), F.count_if(F.col("status").isNull()).alias("failed"))


@BOOK.add("SELECT vec_id, ROUND(list_sum(list_transform(list_zip(a, b), lambda p: CAST(p[1] * 0.75 + p[2] * 0.25 AS DOUBLE))), 6) AS mixed FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS b FROM embeddings)")
def weighted_mix(spark: SparkSession, d: str) -> DataFrame:
    """Two scores by normalised weights (3 and 1)."""
    a, b = records.weights(3.0, 1.0)
    mixed = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * a + x.cast("double") * x.cast("double") * b)
    return table(spark, d, "embeddings").select("vec_id", F.round(mixed, 6).alias("mixed"))
