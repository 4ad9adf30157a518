"""Projections and checks of single records: identities, sources as shown, JSON in and out, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafloom.functions.text import clean_text

#: The form of a law's number, what stands for a missing name, and cuts in characters.
LAW_CODE = r"(?iu)\b\d{1,4}/\d{4}/[A-ZĐ][A-ZĐ0-9-]{1,30}\b"
UNKNOWN, SOURCE, POST = "Không rõ", "Nguồn pháp lý", "bai-viet"
CITATION, TEXT, IDENTITY, EVIDENCE, SLUG = 500, 5000, 120, 7000, 180

#: Fields of the objects that a model returns, ``?`` where null is allowed, and the values of closed fields.
RISK = "struct<level:string,title:string,detail:string,recommendation:string,citations:array<string>>"
REVIEW = f"struct<summary:string,risks:array<{RISK}>,recommendations:array<string>>"
COMPARE = f"struct<summary:string,differences:array<struct<type:string,before:string,after:string,legal_impact:string>>,risks:array<{RISK}>,recommendation:string>"
VERDICT = "struct<code:string,title:string,status:string,source_url:string,replacement_code:string,replacement_title:string,replacement_url:string,reason:string,confidence:double>"
NULLABLE = ("source_url", "replacement_code", "replacement_title", "replacement_url")
LEVELS = ("low", "medium", "high")
STATES = ("IN_FORCE", "PARTIALLY_IN_FORCE", "AMENDED", "EXPIRED", "REPLACED", "UNKNOWN")


def given(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def law_identity(citation: Column, title: Column, doc_id: Column) -> Column:
    """(code, title) that a source is checked by: the first law number in its label, else its document, else its title."""
    label = F.upper(F.concat(F.coalesce(citation, F.lit("")), F.lit(" "), F.coalesce(title, F.lit(""))))
    code = F.coalesce(given(F.regexp_extract(label, LAW_CODE, 0)), F.substring(F.coalesce(given(doc_id), given(title), F.lit(UNKNOWN)), 1, IDENTITY))
    return F.struct(code.alias("code"), F.substring(F.coalesce(given(title), given(citation), code), 1, CITATION).alias("title"))


def shown(place: Column, score: Column, citation: Column, title: Column, text: Column, reasons: Column, doc_id: Column, node_id: Column) -> Column:
    """A source as answers show it."""
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    return F.struct(
        F.concat(F.lit("S"), place.cast("string")).alias("source_id"),
        F.round(F.coalesce(score, F.lit(0.0)), 4).alias("score"),
        cut(F.coalesce(given(citation), given(title), F.lit(SOURCE)), CITATION).alias("citation"),
        cut(title, CITATION).alias("title"),
        cut(text, TEXT).alias("text"),
        F.coalesce(reasons, F.array().cast("array<string>")).alias("reasons"),
        given(doc_id.cast("string")).alias("doc_id"),
        given(node_id.cast("string")).alias("node_id"),
    )


def context_text(citation: Column, title: Column, text: Column) -> Column:
    """A source for a judge of answers: citation and text, or the one that is there."""
    head, body = clean_text(F.coalesce(given(citation), title, F.lit(""))), clean_text(F.coalesce(text, F.lit("")))
    return F.when((head != "") & (body != ""), F.concat(head, F.lit("\n"), body)).when(body != "", body).otherwise(head)


def compact(chunk_id: Column, citation: Column, title: Column, score: Column, reasons: Column) -> Column:
    return F.struct(chunk_id.alias("chunk_id"), clean_text(F.coalesce(given(citation), title, F.lit(""))).alias("citation"), score.alias("score"), F.coalesce(reasons, F.array().cast("array<string>")).alias("reasons"))


def message_json(conv_id: Column, role: Column, content: Column, created: Column) -> Column:
    """A message as JSON: its role in lower case, its time in ISO form."""
    return F.to_json(F.struct(conv_id.alias("conversation_id"), F.lower(role).alias("role"), content.alias("content"), iso(created).alias("created_at")))


def evidence(raw: Column, content: Column, limit: int = EVIDENCE) -> Column:
    """What a page says: its raw text if there is one, else its excerpt, cut."""
    return F.substring(F.coalesce(given(raw), given(content), F.lit("")), 1, limit)


def numbered(rows: DataFrame, order: list[Column], prefix: str = "W", *keys: str) -> DataFrame:
    """``rows`` with ``id``: the prefix and their place by ``order`` (within ``keys``, which bound what one task sorts)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("id", F.concat(F.lit(prefix), place.cast("string")))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def stamp(ts: Column) -> Column:
    """A time as part of a file name."""
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def elapsed(start: Column, end: Column) -> Column:
    """Seconds between two times, to four places."""
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6, 4)


def post_slug(title: Column, id_: Column) -> Column:
    """A post's address: ASCII letters and digits of its title and six hexadecimal digits of its id's digest."""
    slug = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(F.coalesce(given(F.substring(slug, 1, SLUG)), F.lit(POST)), F.lit("-"), F.substring(F.sha2(id_.cast("string"), 256), 1, 6))


def split_csv(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def expected_ids(contexts: Column) -> Column:
    """Ids of the contexts (array of struct with chunk_id) that a question needs."""
    return F.transform(F.filter(contexts, lambda x: F.coalesce(x["chunk_id"].cast("string"), F.lit("")) != ""), lambda x: clean_text(x["chunk_id"].cast("string")))


def weights(vector: float, lexical: float) -> tuple[float, float]:
    """Weights of the two lists, not below 0 and 1 together; halves if both are 0."""
    vector, lexical = max(vector, 0.0), max(lexical, 0.0)
    whole = vector + lexical
    return (vector / whole, lexical / whole) if whole > 0 else (0.5, 0.5)


def fields(schema: str) -> list[str]:
    """Names of a struct's fields."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    return kind.fieldNames()


def checked(payload: Column, schema: str) -> Column:
    """The object of a JSON payload, or null: it must have all fields of the schema and no others, values where null is
    not allowed, and closed fields within their values."""
    names = fields(schema)
    value = F.from_json(payload, schema, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(payload)
    ok = value.isNotNull() & (F.array_sort(keys) == F.array(*[F.lit(n) for n in sorted(names)]))
    for n in names:
        if n not in NULLABLE:
            ok = ok & value[n].isNotNull()
    if "status" in names:
        ok = ok & value["status"].isin(*STATES) & value["confidence"].between(0, 1)
    if "risks" in names:
        held = F.array(*[F.lit(x) for x in LEVELS])
        ok = ok & F.forall(value["risks"], lambda r: r.isNotNull() & F.array_contains(held, F.coalesce(r["level"], F.lit(""))) & r["title"].isNotNull() & r["detail"].isNotNull() & r["recommendation"].isNotNull() & r["citations"].isNotNull())
    return F.when(F.coalesce(ok, F.lit(False)), value)


def verdict_payload(verdict: Column, evidence_: Column) -> Column:
    return F.to_json(F.struct(verdict.alias("verdict"), evidence_.alias("evidence")))


def owned(rows: DataFrame, asked: DataFrame, key: str, owner: str) -> DataFrame:
    """(key, owner, found) for each request (key, owner): whether the row is there and belongs to who asks."""
    mine = rows.select(key, owner).distinct().withColumn("found", F.lit(True))
    return asked.select(key, owner).join(mine, [key, owner], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def of_each(rows: DataFrame, key: str, order: list, limit: int = 5) -> DataFrame:
    """The first ``limit`` rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= limit).drop("_n")


def hit_counts(entries: DataFrame, hits: DataFrame, key: str, count: str, last: str, ts: str) -> DataFrame:
    """``entries`` with their counters and last times after a log of hits (key, ts)."""
    added = hits.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(ts).alias("_t"))
    joined = entries.join(added, key, "left").withColumns({count: F.coalesce(F.col(count), F.lit(0)) + F.coalesce("_n", F.lit(0)), last: F.greatest(last, "_t")})
    return joined.drop("_n", "_t")


def invalidated(entries: DataFrame, bad: DataFrame, key: str, ends: str, as_of: Column) -> DataFrame:
    """``entries`` of which those in ``bad`` end now."""
    marked = entries.join(bad.select(key).distinct().withColumn("_bad", F.lit(True)), key, "left")
    return marked.withColumn(ends, F.when(F.col("_bad"), as_of).otherwise(F.col(ends))).drop("_bad")


def retained(entries: DataFrame, ends: str, as_of: Column, days: int = 7) -> DataFrame:
    """``entries`` that did not end more than ``days`` ago."""
    return entries.filter(F.col(ends) >= as_of - F.make_dt_interval(F.lit(days)))


def either_key(asked: DataFrame, registry: DataFrame, query: str, by: list[tuple[str, str]], take: str) -> DataFrame:
    """(query, take) of the registry row that an asked row finds by the first pair of columns (asked, registry) that
    fits: one equi-join for each pair instead of a disjunction."""
    found = None
    for p, (mine, theirs) in enumerate(by):
        one = asked.join(registry.select(F.col(theirs).alias("_k"), take), F.col(mine) == F.col("_k")).select(query, take, F.lit(p).alias("_p"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy(query).agg(F.min_by(take, "_p").alias(take))


def official(host: Column, domains) -> Column:
    """Whether a host is one of the domains or below one."""
    return F.exists(F.array(*[F.lit(x) for x in domains]), lambda x: (host == x) | F.endswith(host, F.concat(F.lit("."), x)))


def found_in(columns: list[str], needle: str) -> Column:
    """Whether any of the columns holds a text, in any case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle.lower()))
    return out


def visible(published: Column, reviewer: Column) -> Column:
    return F.coalesce(published, F.lit(False)) | F.coalesce(reviewer, F.lit(False))


