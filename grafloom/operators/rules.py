"""Semantic layers of the graph by keyword tables: one generic match, and per layer what it emits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.functions import rules as R
from grafloom.functions.text import slugify
from grafloom.operators.structure import dedup_edges, first_writer
from grafloom.sources.shared import kept


def holds(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def hits(low: Column, entries) -> Column:
    """The (kw, name) entries whose keyword is in a text."""
    table = F.array(*[F.struct(F.lit(k).alias("kw"), F.lit(v).alias("name")) for k, v in entries])
    return F.filter(table, lambda e: F.contains(low, e["kw"]))


def matches(nodes: DataFrame, entries, name: str = "kw", value: str = "name") -> DataFrame:
    """``nodes`` once for each (keyword, value) whose keyword is in ``low``."""
    return nodes.withColumn("hit", F.explode(hits(F.col("low"), entries))).select("*", F.col("hit.kw").alias(name), F.col("hit.name").alias(value)).drop("hit")


def edge(source: Column, target: Column, relation: str, evidence: Column, layer: int) -> Column:
    return F.struct(source.alias("source_id"), target.alias("target_id"), F.lit(relation).alias("relation"), evidence.alias("evidence"), F.lit(layer).alias("layer"))


def node(kind: str, node_id: Column, owner: Column, name: Column, parent: Column | None, label: Column | None = None, text: Column | None = None, title: Column | None = None) -> Column:
    """What a rule adds to the nodes; ``name`` is part of the text, and the label if there is no other."""
    node_type, said = R.KINDS[kind]
    label = name if label is None else label
    parent = F.lit(None).cast("string") if parent is None else parent
    text = F.concat(F.lit(said), name) if text is None else text
    return F.struct(node_id.alias("node_id"), owner.alias("doc_id"), F.lit(node_type).alias("node_type"), label.alias("label"), (label if title is None else title).alias("title"), parent.alias("parent_id"), text.alias("text"))


def same(words) -> list[tuple[str, str]]:
    return [(w, w) for w in words]


def titled(words) -> list[tuple[str, str]]:
    """Keywords with their names in title case."""
    return [(w, w.title()) for w in words]


def pairs(a: Column, b: Column, make) -> Column:
    """``make(x, y)`` for every x of one array and y of another."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: make(x, y))))


NODE = "array<struct<node_id:string,doc_id:string,node_type:string,label:string,title:string,parent_id:string,text:string>>"


def layers(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, doc_id, node_type, label, number, title, parent_id, ordinal, text) and edges (edge_id, source_id,
    target_id, relation, evidence) of all layers from articles, clauses and points (node_id, doc_id, node_type, label,
    ordinal, text).  With those of ``stages``, every end of every edge has a node.

    Every rule gives arrays of nodes and edges per node, which are written once; so texts are read and matched once.  A
    node that several texts name keeps what the first says (by document, ordinal and id), and the text that the last
    gives it.
    """
    none = F.array().cast("array<struct<source_id:string,target_id:string,relation:string,evidence:string,layer:int>>")
    found = lambda pattern, c: F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    base = nodes.filter(F.col("node_type").isin("Điều", "Khoản", "Điểm")).select("node_id", "doc_id", "label", "ordinal", "text", F.lower("text").alias("low"))
    low = F.col("low")
    # Matches are columns of their own, so that rules which share a table match it once.
    base = base.withColumns(
        {
            "terms": hits(low, same(k for k, _ in R.TERMS)),
            "formulas": F.when(holds(low, R.CALCULATED), hits(low, R.FORMULAS)),
            "shares": found(r"(?U)\b\d+%\b", F.col("text")),
            "spans": found(r"(?U)\b\d+\s*(?:ngày|tháng|năm|giờ)\b", low),
            "subjects": hits(low, R.SUBJECTS),
            "contracts": hits(low, R.CONTRACTS),
            "actions": hits(low, titled(R.ACTIONS)),
            "benefits": hits(low, titled(R.BENEFITS)),
            "events": F.when(holds(low, R.TIMED), hits(low, R.EVENTS)),
            "days": found(r"(?U)\b\d+\s*(?:ngày|tháng|năm)\b", low),
            "procedures": F.when(holds(low, R.PROCESS), hits(low, R.PROCEDURES)),
            "violations": F.when(holds(low, R.PUNISHED), hits(low, R.VIOLATIONS)),
            "precedents": found(R.PRECEDENT, F.col("text")),
        }
    )
    col, own = F.col, F.col("node_id")
    slug = lambda prefix, c: F.concat(F.lit(prefix), slugify(c))
    at = lambda text: F.concat(F.lit(text), F.col("label"))
    only = lambda condition, array: F.when(condition, array)
    formula = lambda f: F.concat_ws(":", F.lit("cachtinh"), col("doc_id"), slugify(f["kw"]))
    forbidden = "BỊ_NẰM_TRONG_DANH_MỤC_CẤM"
    defined = lambda t: F.contains(low, F.concat(t["kw"], F.lit(" là"))) | F.contains(low, F.concat(t["kw"], F.lit(" được hiểu là"))) | F.contains(low, F.concat(F.lit("định nghĩa "), t["kw"]))
    severe, fined = holds(low, R.SEVERE), F.contains(low, F.lit("phạt tiền"))
    risk = F.when(severe, R.RISKS[2][0]).when(fined, R.RISKS[1][0]).otherwise(R.RISKS[0][0])
    said = F.when(severe, "Vi phạm đặc biệt nghiêm trọng").when(fined, "Vi phạm hành chính chịu phạt tiền").otherwise("Vi phạm nhẹ bị nhắc nhở")
    end = F.lit("trangthai:het-thoi-hieu-khoi-kien")
    rules: list[Column] = [
        F.transform("terms", lambda t: edge(slug("thuatngu:", t["kw"]), own, "ĐƯỢC_ĐỊNH_NGHĨA_LÀ", F.when(defined(t), at("Định nghĩa tại ")).otherwise(at("Sử dụng thuật ngữ tại ")), 2)),
        F.transform("formulas", lambda f: edge(formula(f), own, "ÁP_DỤNG_CHO", at("Quy định tại "), 2)),
        pairs(col("formulas"), col("shares"), lambda f, p: edge(formula(f), slug("thamso:", p), "CÓ_THAM_SỐ", F.concat(F.lit("Mức tỷ lệ "), p), 2)),
        pairs(col("formulas"), col("spans"), lambda f, p: edge(formula(f), slug("thamso:", p), "CÓ_THAM_SỐ", F.concat(F.lit("Mốc thời hạn "), p), 2)),
        F.transform("contracts", lambda c: edge(c["name"], own, forbidden, at("Quy định tại "), 3)),
        pairs(col("subjects"), col("contracts"), lambda s, c: edge(s["name"], c["name"], "KÝ_KẾT", at("Ký kết hợp đồng quy định tại "), 3)),
        F.transform("actions", lambda a: edge(slug("hanhvi:", a["kw"]), own, forbidden, at("Quy chiếu đến "), 3)),
        only(holds(low, R.FORBIDDEN), F.transform("actions", lambda a: edge(slug("hanhvi:", a["kw"]), own, forbidden, at("Bị nghiêm cấm tại "), 3))),
        pairs(col("subjects"), col("actions"), lambda s, a: edge(s["name"], slug("hanhvi:", a["kw"]), "THỰC_HIỆN", F.concat(F.lit("Chủ thể thực hiện "), a["kw"]), 3)),
        F.transform("benefits", lambda b: edge(slug("chedo:", b["kw"]), own, forbidden, at("Quy định tại "), 3)),
        only(F.contains(low, F.lit(R.SUBJECTS[0][0])), F.transform("benefits", lambda b: edge(F.lit(R.SUBJECTS[0][1]), slug("chedo:", b["kw"]), "CÓ_QUYỀN_HƯỞNG", F.lit("Quyền lợi người lao động"), 3))),
        pairs(col("events"), col("days"), lambda e, p: edge(slug("sukien_kichhoat:", e["kw"]), slug("mocthoigian:", p), "BẮT_ĐẦU_TÍNH_THỜI_HIỆU", F.concat(F.lit("Bắt đầu tính "), p, F.lit(" kể từ khi "), e["kw"]), 4)),
        only((F.size("events") > 0) & F.contains(low, F.lit("thời hiệu khởi kiện")), F.transform("days", lambda p: edge(slug("mocthoigian:", p), end, "CHUYỂN_TRẠNG_THÁI", F.lit("Hết thời hiệu sau mốc thời gian"), 4))),
        only(F.contains(low, F.lit("thử việc")), F.array(edge(F.lit("lifecycle_dn:tuyen-dung-ld"), F.lit("lifecycle_nld:thu-viec"), "GIAI_DOẠN_TIẾP_THEO", F.lit("Tuyển dụng sang thử việc"), 6))),
        F.transform("violations", lambda v: edge(slug("vipham:", v["kw"]), risk, "GÂY_RA_RỦI_RO", said, 7)),
        pairs(col("violations"), hits(low, R.FIXES), lambda v, f: edge(slug("vipham:", v["kw"]), slug("khacphuc:", f["kw"]), "KHẮC_PHỤC_BẰNG", F.concat(F.lit("Biện pháp sửa sai: "), f["name"]), 7)),
        F.transform("precedents", lambda p: edge(slug("anle:", p), own, "ÁP_DỤNG_ĐIỀU_LUẬT", at("Áp dụng quy định tại "), 8)),
        only(F.size("precedents") > 0, F.transform(hits(low, R.FACTS), lambda f: edge(slug("tinh-tiet:", f["kw"]), slug("phanquyet:", f["kw"]), "DẪN_ĐẾN_PHÁN_QUYẾT", F.lit("Phán quyết dựa trên tình tiết cốt lõi"), 8))),
        pairs(col("precedents"), hits(low, R.FACTS), lambda p, f: edge(slug("anle:", p), slug("tinh-tiet:", f["kw"]), "CÓ_TÌNH_TIẾT_TƯƠNG_TỰ", F.lit("Tình tiết cấu thành án lệ"), 8)),
    ]
    for table, prefix, relation, words in ((R.DOSSIERS, "hoso:", "BAO_GỒM_HỒ_SƠ", "Hồ sơ bao gồm "), (R.CONDITIONS, "dieukien:", "YÊU_CẦU_ĐIỀU_KIỆN", "Yêu cầu điều kiện "), (R.AGENCIES, "coquan:", "NỘP_TẠI", "Nộp hồ sơ tại ")):
        rules.append(pairs(col("procedures"), hits(low, table), lambda p, x, prefix=prefix, relation=relation, words=words: edge(slug("thutuc:", p["kw"]), slug(prefix, x["kw"]), relation, F.concat(F.lit(words), x["name"]), 5)))
    for words, stage, text in R.LIFECYCLE:
        rules.append(only(holds(low, words), F.array(edge(F.lit(stage), own, "KÍCH_HOẠT_NGHĨA_VỤ", at(text) if text.endswith("tại ") else F.lit(text), 6))))
    # Names in title case, as keywords are set for nodes.
    shown = lambda entries: {k: k.title() for k, _ in entries}
    cased = lambda entries, x: F.element_at(F.create_map(*[F.lit(w) for kv in shown(entries).items() for w in kv]), x["kw"])
    doc, system = col("doc_id"), F.lit(R.SYSTEM[0])
    timed = (F.size("events") > 0) & (F.size("days") > 0)
    made: list[Column] = [
        F.transform("formulas", lambda f: node("formula", formula(f), doc, f["name"], own, text=F.concat(F.lit(R.KINDS["formula"][1]), f["name"], F.lit(" được quy định tại "), col("label"), F.lit(".")))),
        pairs(col("formulas"), col("shares"), lambda f, p: node("share", slug("thamso:", p), doc, p, formula(f))),
        pairs(col("formulas"), col("spans"), lambda f, p: node("span", slug("thamso:", p), doc, p, formula(f))),
        F.transform("subjects", lambda x: node("subject", x["name"], system, cased(R.SUBJECTS, x), None)),
        F.transform("contracts", lambda x: node("contract", x["name"], doc, cased(R.CONTRACTS, x), None, label=F.concat(F.lit("HĐ "), cased(R.CONTRACTS, x)), title=F.concat(F.lit("Hợp đồng "), x["kw"]))),
        F.transform("actions", lambda x: node("action", slug("hanhvi:", x["kw"]), doc, x["name"], own)),
        F.transform("benefits", lambda x: node("benefit", slug("chedo:", x["kw"]), doc, x["name"], own)),
        F.transform("events", lambda x: node("event", slug("sukien_kichhoat:", x["kw"]), doc, x["name"], own)),
        only(timed, F.transform("days", lambda p: node("date", slug("mocthoigian:", p), doc, p, own))),
        only(timed & F.contains(low, F.lit("thời hiệu khởi kiện")), F.array(node("state", F.lit(R.LAPSED[0]), doc, F.lit(R.LAPSED[1]), None, text=F.lit(R.LAPSED[2])))),
        F.transform("procedures", lambda x: node("procedure", slug("thutuc:", x["kw"]), doc, x["name"], own)),
        F.transform("violations", lambda x: node("violation", slug("vipham:", x["kw"]), doc, x["name"], own)),
        only(F.size("violations") > 0, F.transform(hits(low, R.FIXES), lambda x: node("fix", slug("khacphuc:", x["kw"]), doc, x["name"], own))),
        F.transform("precedents", lambda p: node("precedent", slug("anle:", p), doc, p, own)),
        pairs(col("precedents"), hits(low, R.FACTS), lambda p, x: node("fact", slug("tinh-tiet:", x["kw"]), doc, x["name"], slug("anle:", p))),
        pairs(col("precedents"), hits(low, R.FACTS), lambda p, x: node("ruling", slug("phanquyet:", x["kw"]), doc, F.concat(x["kw"], F.lit(".")), slug("anle:", p), label=F.concat(F.lit("Phán quyết về "), x["kw"]))),
    ]
    plain = lambda kind, prefix: lambda x: node(kind, slug(prefix, x["kw"]), doc, x["name"], own)
    for kind, table, prefix in (("dossier", R.DOSSIERS, "hoso:"), ("condition", R.CONDITIONS, "dieukien:"), ("agency", R.AGENCIES, "coquan:")):
        made.append(only(F.size("procedures") > 0, F.transform(hits(low, table), plain(kind, prefix))))
    both = kept(base.select("doc_id", "ordinal", "node_id", F.flatten(F.array(*[F.coalesce(r, none) for r in rules])).alias("edges"), F.flatten(F.array(*[F.coalesce(m, F.array().cast(NODE)) for m in made])).alias("nodes")))
    edges = dedup_edges(both.select(F.explode("edges").alias("e")).select("e.*"), "layer")
    rows = both.select(F.struct(F.col("doc_id").alias("d"), "ordinal", F.col("node_id").alias("at")).alias("o"), F.posexplode("nodes").alias("k", "x")).select(F.struct("o", "k").alias("o"), "x.*")
    named = first_writer(rows, "node_id", "o", ["doc_id", "node_type", "label", "title", "parent_id"], "text")
    return named.select("node_id", "doc_id", "node_type", "label", F.lit("").alias("number"), "title", "parent_id", F.lit(0).cast("long").alias("ordinal"), "text"), edges


def stages(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Nodes that do not depend on any text, and next-stage edges: both life cycles, the risk levels, the terms."""
    rows = [(f"lifecycle_nld:{k}", "GiaiĐoạn_NLĐ", v, t, i) for i, (k, v, t) in enumerate(R.EMPLOYEE_STAGES)]
    rows += [(f"lifecycle_dn:{k}", "GiaiĐoạn_DoanhNghiệp", v, t, i) for i, (k, v, t) in enumerate(R.COMPANY_STAGES)]
    rows += [(k, "MứcĐộRủiRo", v, t, i) for i, (k, v, t) in enumerate(R.RISKS)]
    nodes = spark.createDataFrame(rows, "node_id string, node_type string, label string, text string, n int")
    following = nodes.select("node_type", (F.col("n") - 1).alias("n"), F.col("node_id").alias("target_id"), F.col("label").alias("to"))
    edges = nodes.filter("node_type <> 'MứcĐộRủiRo'").join(following, ["node_type", "n"])
    edges = dedup_edges(edges.select(F.col("node_id").alias("source_id"), "target_id", F.lit("GIAI_DOẠN_TIẾP_THEO").alias("relation"), F.concat("label", F.lit(" sang "), "to").alias("evidence")))
    # Spellings of one term have one id; the first is its name.
    terms = spark.createDataFrame([(i, k, k.title(), t) for i, (k, t) in enumerate(R.TERMS)], "n int, kw string, label string, text string")
    terms = first_writer(terms.withColumn("node_id", F.concat(F.lit("thuatngu:"), slugify(F.col("kw")))), "node_id", "n", ["label"], "text")
    every = nodes.select("node_id", "node_type", "label", "text").unionByName(terms.select("node_id", F.lit(R.KINDS["term"][0]).alias("node_type"), "label", "text"))
    whole = every.select("node_id", F.lit(R.SYSTEM[0]).alias("doc_id"), "node_type", "label", F.lit("").alias("number"), F.col("label").alias("title"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("ordinal"), "text")
    return whole, edges
