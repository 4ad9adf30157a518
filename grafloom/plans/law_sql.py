"""SQL that says what the structure parser, the citations and the rule layers do, built from the same fixed tables."""

from __future__ import annotations

from grafloom.functions import rules as R
from grafloom.plans.texts import NORM, STRIP

SLUG = "coalesce(nullif(trim(regexp_replace(lower(" + STRIP.format("replace(replace({0}, 'Đ', 'DD'), 'đ', 'dd')") + "), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item')"
#: The patterns of lines, as this dialect writes them.
CHAPTER, SECTION = ("(?i)^" + w + "\\s+([IVXLCDM]+|\\d+)(?:[\\.\\s:-]+(.+))?$" for w in ("Chương", "Mục"))
ARTICLE = "(?i)^Điều\\s+(\\d+[a-zA-Z]?)\\s*[\\.:]\\s*(.+)$"
CLAUSE = "^(\\d{1,3})\\.\\s+(.+)$"
POINT = "(?i)^([a-zđ](?:\\d+)?)\\)\\s+(.+)$"


def kind(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN {k}" for k, p in enumerate((CHAPTER, SECTION, ARTICLE, CLAUSE, POINT), 1)) + " ELSE 0 END"


def heading(c: str) -> str:
    return f"length({c}) BETWEEN 1 AND 220 AND ({kind(c)}) = 0 AND (len(regexp_extract_all({c}, '\\p{{Lu}}')) >= 0.55 * greatest(len(regexp_extract_all({c}, '\\p{{L}}')), 1) OR regexp_matches({c}[1:1], '^\\p{{Lu}}'))"


EDGE = "'edge:' || substring(sha1(source_id || '|' || relation || '|' || target_id || '|' || substring(evidence, 1, 80)), 1, 20)"

LINES = f"""raw AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
plain AS (SELECT doc_id, n, {NORM.format('line')} AS line FROM raw),
law AS (SELECT doc_id, n, CASE WHEN n % 12 = 1 THEN 'Chương ' || (n // 12 + 1) || '. ' || line WHEN n % 12 = 3 THEN 'Mục 1. ' || line WHEN n % 3 = 2 THEN 'Điều ' || n || '. ' || line WHEN n % 4 = 0 THEN (n % 9 + 1) || '. ' || line WHEN n % 7 = 0 THEN 'a) ' || line ELSE line END AS line FROM plain WHERE line <> '')"""


def held(name: str, level: int, what: str) -> str:
    return f"last_value(CASE WHEN kind = {level} THEN {what} END IGNORE NULLS) OVER w AS {name}"


PARSE = f"""{LINES},
p1 AS (SELECT *, {kind('line')} AS kind, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS next FROM law),
p2 AS (SELECT *, CASE kind WHEN 1 THEN regexp_extract(line, '{CHAPTER}', 2) WHEN 2 THEN regexp_extract(line, '{SECTION}', 2) WHEN 3 THEN regexp_extract(line, '{ARTICLE}', 2) ELSE '' END AS inl FROM p1),
p3 AS (SELECT *, kind IN (1, 2) AND inl = '' AND coalesce({heading('next')}, false) AS takes FROM p2),
p4 AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY doc_id ORDER BY n), false) AS taken FROM p3),
p5 AS (SELECT *, CASE WHEN takes THEN next ELSE {NORM.format('inl')} END AS title, CASE kind WHEN 1 THEN upper(regexp_extract(line, '{CHAPTER}', 1)) WHEN 2 THEN upper(regexp_extract(line, '{SECTION}', 1)) WHEN 3 THEN regexp_extract(line, '{ARTICLE}', 1) WHEN 4 THEN regexp_extract(line, '{CLAUSE}', 1) WHEN 5 THEN lower(regexp_extract(line, '{POINT}', 1)) END AS number FROM p4 WHERE NOT taken),
p6 AS (SELECT *, {', '.join(held(f'{c}_n', k, 'n') + ', ' + held(f'{c}_no', k, 'number') for k, c in enumerate(('ch', 'se', 'ar'), 1))} FROM p5 WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
p7 AS (SELECT *, ch_n IS NOT NULL AS has_ch, se_n > coalesce(ch_n, -1) AS has_se, ar_n > greatest(coalesce(ch_n, -1), coalesce(se_n, -1)) AS has_ar FROM p6),
p8 AS (SELECT * REPLACE (CASE WHEN kind IN (4, 5) AND NOT coalesce(has_ar, false) THEN 0 ELSE kind END AS kind) FROM p7),
p9 AS (SELECT *, {', '.join(held(f'{c}_n', k, 'n') + ', ' + held(f'{c}_no', k, 'number') for k, c in ((4, 'cl'), (5, 'po')))} FROM p8 WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
p10 AS (SELECT *, has_ar AND cl_n > ar_n AS has_cl FROM p9),
p11 AS (SELECT *, has_ar AND po_n > ar_n AND (NOT coalesce(has_cl, false) OR po_n > cl_n) AS has_po, 'doc:' || doc_id AS doc_node, CASE WHEN has_ch THEN 'chuong:' || doc_id || ':' || {SLUG.format('ch_no')} END AS ch FROM p10),
p12 AS (SELECT *, CASE WHEN has_se THEN 'muc:' || doc_id || ':' || {SLUG.format('coalesce(ch, doc_node)')} || ':' || {SLUG.format('se_no')} END AS se, CASE WHEN has_ar THEN 'dieu:' || doc_id || ':' || {SLUG.format('ar_no')} END AS ar,
  CASE WHEN has_cl THEN 'khoan:' || doc_id || ':' || {SLUG.format('ar_no')} || ':' || cl_no END AS cl, CASE WHEN has_po THEN 'diem:' || doc_id || ':' || {SLUG.format('ar_no')} || ':' || {SLUG.format("CASE WHEN has_cl THEN cl_no ELSE '0' END")} || ':' || {SLUG.format('po_no')} END AS po FROM p11),
p13 AS (SELECT *, CASE kind WHEN 1 THEN 'Chương ' || number || CASE WHEN title <> '' THEN '. ' || title ELSE '' END WHEN 2 THEN 'Mục ' || number || CASE WHEN title <> '' THEN '. ' || title ELSE '' END WHEN 3 THEN 'Điều ' || number || '. ' || title WHEN 4 THEN 'Khoản ' || number WHEN 5 THEN 'Điểm ' || number END AS label,
  CASE kind WHEN 1 THEN ch WHEN 2 THEN se WHEN 3 THEN ar WHEN 4 THEN cl WHEN 5 THEN po END AS own, CASE kind WHEN 1 THEN doc_node WHEN 2 THEN coalesce(ch, doc_node) WHEN 3 THEN coalesce(se, ch, doc_node) WHEN 4 THEN ar WHEN 5 THEN coalesce(cl, ar) END AS parent,
  kind = 0 AND ar IS NULL AS intro, count(*) FILTER (WHERE kind > 0) OVER w AS ordinal, count(*) FILTER (WHERE kind = 0 AND ar IS NULL) OVER w AS intro_no FROM p12 WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
rows AS (SELECT *, CASE WHEN kind = 4 THEN number || '. ' || {NORM.format(f"regexp_extract(line, '{CLAUSE}', 2)")} WHEN kind = 5 THEN number || ') ' || {NORM.format(f"regexp_extract(line, '{POINT}', 2)")} WHEN kind > 0 THEN label ELSE line END AS body,
  CASE WHEN kind IN (1, 2, 3) THEN [own] WHEN intro THEN [doc_node] ELSE list_filter([ar, cl, po], lambda x: x IS NOT NULL) END AS ends FROM p13),
heads AS (SELECT own AS node_id, doc_id, arg_min(kind, n) AS kind, arg_min(label, n) AS label, arg_min(number, n) AS number, arg_min(CASE WHEN kind < 4 THEN title ELSE '' END, n) AS title, arg_min(parent, n) AS parent_id, arg_min(ordinal, n) AS ordinal FROM rows WHERE kind > 0 GROUP BY ALL),
parts AS (SELECT unnest(ends) AS node_id, n, body, intro FROM rows WHERE NOT intro OR intro_no <= 50),
texts AS (SELECT node_id, CASE WHEN bool_or(intro) THEN string_agg(body, chr(10) ORDER BY n, body) ELSE string_agg(body, ' ' ORDER BY n, body) END AS text FROM parts GROUP BY node_id),
nodes AS (SELECT h.node_id, doc_id, ['Chương', 'Mục', 'Điều', 'Khoản', 'Điểm'][kind] AS node_type, label, number, title, parent_id, ordinal, text FROM heads h LEFT JOIN texts USING (node_id)
  UNION ALL SELECT d.node_id, doc_id, 'VănBản', doc_id, '', '', NULL, 0, text FROM (SELECT DISTINCT 'doc:' || doc_id AS node_id, doc_id FROM law) d LEFT JOIN texts USING (node_id))"""

NODES_SQL = f"WITH {PARSE} SELECT node_id, doc_id, node_type, label, number, title, parent_id, ordinal, md5(text) AS text_md5 FROM nodes"
EDGES_SQL = f"WITH {PARSE}, e AS (SELECT own AS source_id, parent AS target_id, 'THUỘC_VỀ' AS relation, CASE WHEN kind < 4 THEN label ELSE label || ' Điều ' || ar_no END AS evidence, n, doc_id FROM rows WHERE kind > 0 AND own <> parent) SELECT {EDGE} AS edge_id, source_id, target_id, relation, substring(arg_min(evidence, n), 1, 500) AS evidence FROM e GROUP BY ALL"
EDGES_SQL = f"WITH {PARSE}, e AS (SELECT own AS source_id, parent AS target_id, 'THUỘC_VỀ' AS relation, CASE WHEN kind < 4 THEN label ELSE label || ' Điều ' || ar_no END AS evidence, n FROM rows WHERE kind > 0 AND own <> parent), k AS (SELECT {EDGE} AS edge_id, * FROM e) SELECT edge_id, source_id, target_id, relation, substring(arg_min(evidence, n), 1, 500) AS evidence FROM k GROUP BY edge_id, source_id, target_id, relation"


def values(entries) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in entries) + ")"


def any_of(words, c: str = "low") -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def matched(name: str, entries, condition: str = "true") -> str:
    """A step with the nodes once for each (kw, name) they hold."""
    rows = [(k, x, i) for i, (k, x) in enumerate(entries)]
    return f"{name} AS (SELECT n.*, v.kw, v.name, v.i FROM n JOIN {values(rows)} v(kw, name, i) ON contains(n.low, v.kw) WHERE {condition})"


def of_pattern(name: str, pattern: str, c: str, condition: str = "true") -> str:
    """A step with the nodes once for each distinct match of a pattern, in the order of first places."""
    return f"{name} AS (SELECT n.*, x.kw, x.i FROM n, LATERAL (SELECT kw, min(i) AS i FROM (SELECT unnest(regexp_extract_all(n.{c}, '{pattern}')) AS kw, unnest(range(len(regexp_extract_all(n.{c}, '{pattern}')))) AS i) GROUP BY kw) x WHERE {condition})"


def cased(entries):
    return [(k, k.title()) for k in entries]


def layer_steps() -> str:
    """From ``n`` (node_id, doc_id, label, ordinal, text, low): what each rule matches."""
    steps = [
        matched("terms", [(k, k) for k, _ in R.TERMS]),
        matched("formulas", R.FORMULAS, any_of(R.CALCULATED)),
        of_pattern("shares", "\\b\\d+%\\b", "text"),
        of_pattern("spans", "\\b\\d+\\s*(?:ngày|tháng|năm|giờ)\\b", "low"),
        of_pattern("days", "\\b\\d+\\s*(?:ngày|tháng|năm)\\b", "low"),
        matched("subjects", R.SUBJECTS),
        matched("contracts", R.CONTRACTS),
        matched("actions", cased(R.ACTIONS)),
        matched("benefits", cased(R.BENEFITS)),
        matched("events", R.EVENTS, any_of(R.TIMED)),
        matched("procedures", R.PROCEDURES, any_of(R.PROCESS)),
        matched("dossiers", R.DOSSIERS),
        matched("conditions", R.CONDITIONS),
        matched("agencies", R.AGENCIES),
        matched("violations", R.VIOLATIONS, any_of(R.PUNISHED)),
        matched("fixes", R.FIXES),
        of_pattern("precedents", R.PRECEDENT.replace("(?iuU)", "(?i)"), "text"),
        matched("facts", R.FACTS),
    ]
    return ",\n".join(steps)


def slug(prefix: str, c: str) -> str:
    return f"'{prefix}' || {SLUG.format(c)}"


def edge(source: str, target: str, relation: str, evidence: str, tables: str, condition: str = "true") -> str:
    return f"SELECT {source} AS source_id, {target} AS target_id, '{relation}' AS relation, {evidence} AS evidence FROM {tables} WHERE {condition}"


FORMULA = "'cachtinh:' || {0}.doc_id || ':' || " + SLUG.format("{0}.kw")
BANNED = "BỊ_NẰM_TRONG_DANH_MỤC_CẤM"
BOTH = "{0} a JOIN {1} b USING (node_id)"
RISK = f"CASE WHEN {any_of(R.SEVERE)} THEN {{2}} WHEN contains(low, 'phạt tiền') THEN {{1}} ELSE {{0}} END"
END = R.LAPSED[0]


def layer_edges() -> str:
    rules = [
        edge(slug("thuatngu:", "kw"), "node_id", "ĐƯỢC_ĐỊNH_NGHĨA_LÀ", "CASE WHEN contains(low, kw || ' là') OR contains(low, kw || ' được hiểu là') OR contains(low, 'định nghĩa ' || kw) THEN 'Định nghĩa tại ' ELSE 'Sử dụng thuật ngữ tại ' END || label", "terms"),
        edge(FORMULA.format("formulas"), "node_id", "ÁP_DỤNG_CHO", "'Quy định tại ' || label", "formulas"),
        edge(FORMULA.format("a"), slug("thamso:", "b.kw"), "CÓ_THAM_SỐ", "'Mức tỷ lệ ' || b.kw", BOTH.format("formulas", "shares")),
        edge(FORMULA.format("a"), slug("thamso:", "b.kw"), "CÓ_THAM_SỐ", "'Mốc thời hạn ' || b.kw", BOTH.format("formulas", "spans")),
        edge("name", "node_id", BANNED, "'Quy định tại ' || label", "contracts"),
        edge("a.name", "b.name", "KÝ_KẾT", "'Ký kết hợp đồng quy định tại ' || a.label", BOTH.format("subjects", "contracts")),
        edge(slug("hanhvi:", "kw"), "node_id", BANNED, "'Quy chiếu đến ' || label", "actions"),
        edge(slug("hanhvi:", "kw"), "node_id", BANNED, "'Bị nghiêm cấm tại ' || label", "actions", any_of(R.FORBIDDEN)),
        edge("a.name", slug("hanhvi:", "b.kw"), "THỰC_HIỆN", "'Chủ thể thực hiện ' || b.kw", BOTH.format("subjects", "actions")),
        edge(slug("chedo:", "kw"), "node_id", BANNED, "'Quy định tại ' || label", "benefits"),
        edge(f"'{R.SUBJECTS[0][1]}'", slug("chedo:", "kw"), "CÓ_QUYỀN_HƯỞNG", "'Quyền lợi người lao động'", "benefits", f"contains(low, '{R.SUBJECTS[0][0]}')"),
        edge(slug("sukien_kichhoat:", "a.kw"), slug("mocthoigian:", "b.kw"), "BẮT_ĐẦU_TÍNH_THỜI_HIỆU", "'Bắt đầu tính ' || b.kw || ' kể từ khi ' || a.kw", BOTH.format("events", "days")),
        edge(slug("mocthoigian:", "b.kw"), f"'{END}'", "CHUYỂN_TRẠNG_THÁI", "'Hết thời hiệu sau mốc thời gian'", BOTH.format("events", "days"), "contains(a.low, 'thời hiệu khởi kiện')"),
        edge("'lifecycle_dn:tuyen-dung-ld'", "'lifecycle_nld:thu-viec'", "GIAI_DOẠN_TIẾP_THEO", "'Tuyển dụng sang thử việc'", "n", "contains(low, 'thử việc')"),
        edge(slug("vipham:", "kw"), RISK.format(*[f"'{r[0]}'" for r in R.RISKS]), "GÂY_RA_RỦI_RO", RISK.format("'Vi phạm nhẹ bị nhắc nhở'", "'Vi phạm hành chính chịu phạt tiền'", "'Vi phạm đặc biệt nghiêm trọng'"), "violations"),
        edge(slug("vipham:", "a.kw"), slug("khacphuc:", "b.kw"), "KHẮC_PHỤC_BẰNG", "'Biện pháp sửa sai: ' || b.name", BOTH.format("violations", "fixes")),
        edge(slug("anle:", "kw"), "node_id", "ÁP_DỤNG_ĐIỀU_LUẬT", "'Áp dụng quy định tại ' || label", "precedents"),
        edge(slug("tinh-tiet:", "b.kw"), slug("phanquyet:", "b.kw"), "DẪN_ĐẾN_PHÁN_QUYẾT", "'Phán quyết dựa trên tình tiết cốt lõi'", BOTH.format("precedents", "facts")),
        edge(slug("anle:", "a.kw"), slug("tinh-tiet:", "b.kw"), "CÓ_TÌNH_TIẾT_TƯƠNG_TỰ", "'Tình tiết cấu thành án lệ'", BOTH.format("precedents", "facts")),
    ]
    for table, prefix, relation, words in (("dossiers", "hoso:", "BAO_GỒM_HỒ_SƠ", "Hồ sơ bao gồm "), ("conditions", "dieukien:", "YÊU_CẦU_ĐIỀU_KIỆN", "Yêu cầu điều kiện "), ("agencies", "coquan:", "NỘP_TẠI", "Nộp hồ sơ tại ")):
        rules.append(edge(slug("thutuc:", "a.kw"), slug(prefix, "b.kw"), relation, f"'{words}' || b.name", BOTH.format("procedures", table)))
    for words, stage, text in R.LIFECYCLE:
        rules.append(edge(f"'{stage}'", "node_id", "KÍCH_HOẠT_NGHĨA_VỤ", f"'{text}'" + (" || label" if text.endswith("tại ") else ""), "n", any_of(words)))
    every = "\nUNION ALL ".join(rules)
    return f"ed AS ({every}), ek AS (SELECT {EDGE} AS edge_id, * FROM ed WHERE source_id <> target_id) SELECT edge_id, source_id, target_id, relation, substring(min(evidence), 1, 500) AS evidence FROM ek GROUP BY edge_id, source_id, target_id, relation"


def node(kind: str, rule: int, node_id: str, name: str, parent: str, tables: str, place: str, condition: str = "true", label: str | None = None, title: str | None = None, text: str | None = None, doc: str = "doc_id", at: str = "") -> str:
    node_type, said = R.KINDS[kind]
    label = label or name
    order = f"[{at}ordinal, 0, 0]"
    return f"SELECT {node_id} AS node_id, {doc} AS doc_id, '{node_type}' AS node_type, {label} AS label, {title or label} AS title, CAST({parent} AS VARCHAR) AS parent_id, {text or f'''{chr(39)}{said}{chr(39)} || {name}'''} AS text, {at}doc_id AS o_doc, {at}ordinal AS o_ord, {at}node_id AS o_node, {rule} AS o_rule, {place} AS o_place FROM {tables} WHERE {condition}"


def layer_nodes() -> str:
    ab = "a.i * 1000 + b.i"
    rules = [
        node("formula", 1, FORMULA.format("formulas"), "name", "node_id", "formulas", "i", text="'Phương pháp/cách tính ' || name || ' được quy định tại ' || label || '.'"),
        node("share", 2, slug("thamso:", "b.kw"), "b.kw", FORMULA.format("a"), BOTH.format("formulas", "shares"), ab, doc="a.doc_id", at="a."),
        node("span", 3, slug("thamso:", "b.kw"), "b.kw", FORMULA.format("a"), BOTH.format("formulas", "spans"), ab, doc="a.doc_id", at="a."),
        node("subject", 4, "name", "t.t", "NULL", f"subjects JOIN {values([(k, k.title()) for k, _ in R.SUBJECTS])} t(kw, t) USING (kw)", "i", doc=f"'{R.SYSTEM[0]}'"),
        node("contract", 5, "name", "t.t", "NULL", f"contracts JOIN {values([(k, k.title()) for k, _ in R.CONTRACTS])} t(kw, t) USING (kw)", "i", label="'HĐ ' || t.t", title="'Hợp đồng ' || kw"),
        node("action", 6, slug("hanhvi:", "kw"), "name", "node_id", "actions", "i"),
        node("benefit", 7, slug("chedo:", "kw"), "name", "node_id", "benefits", "i"),
        node("event", 8, slug("sukien_kichhoat:", "kw"), "name", "node_id", "events", "i"),
        node("date", 9, slug("mocthoigian:", "b.kw"), "b.kw", "a.node_id", BOTH.format("events", "days"), "b.i", doc="a.doc_id", at="a."),
        node("state", 10, f"'{END}'", "NULL", "NULL", BOTH.format("events", "days"), "0", "contains(a.low, 'thời hiệu khởi kiện')", label=f"'{R.LAPSED[1]}'", text=f"'{R.LAPSED[2]}'", doc="a.doc_id", at="a."),
        node("procedure", 11, slug("thutuc:", "kw"), "name", "node_id", "procedures", "i"),
        node("violation", 12, slug("vipham:", "kw"), "name", "node_id", "violations", "i"),
        node("fix", 13, slug("khacphuc:", "b.kw"), "b.name", "a.node_id", BOTH.format("violations", "fixes"), "b.i", doc="a.doc_id", at="a."),
        node("precedent", 14, slug("anle:", "kw"), "kw", "node_id", "precedents", "i"),
        node("fact", 15, slug("tinh-tiet:", "b.kw"), "b.name", slug("anle:", "a.kw"), BOTH.format("precedents", "facts"), ab, doc="a.doc_id", at="a."),
        node("ruling", 16, slug("phanquyet:", "b.kw"), "b.kw", slug("anle:", "a.kw"), BOTH.format("precedents", "facts"), ab, label="'Phán quyết về ' || b.kw", text="'Phán quyết của Tòa án đối với hành vi ' || b.kw || '.'", doc="a.doc_id", at="a."),
    ]
    for k, (kind, table, prefix) in enumerate((("dossier", "dossiers", "hoso:"), ("condition", "conditions", "dieukien:"), ("agency", "agencies", "coquan:")), 17):
        rules.append(node(kind, k, slug(prefix, "b.kw"), "b.name", "a.node_id", BOTH.format("procedures", table), "b.i", doc="a.doc_id", at="a."))
    every = "\nUNION ALL ".join(rules)
    first = "[o_doc, lpad(CAST(o_ord AS VARCHAR), 9, '0'), o_node, lpad(CAST(o_rule AS VARCHAR), 2, '0'), lpad(CAST(o_place AS VARCHAR), 9, '0')]"
    return f"nd AS ({every}), nk AS (SELECT *, {first} AS o FROM nd), nf AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY o) AS r, last_value(text) OVER (PARTITION BY node_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_text FROM nk) SELECT node_id, doc_id, node_type, label, title, parent_id, last_text AS text FROM nf WHERE r = 1"


#: Keyword passages that the queries add to texts, so that every rule has something to find.
POOL = [*(k for k, _ in R.TERMS), *(k for k, _ in R.FORMULAS), *(k for k, _ in R.SUBJECTS), *(k for k, _ in R.CONTRACTS), *R.ACTIONS, *R.BENEFITS, *(k for k, _ in R.EVENTS), *(k for k, _ in R.PROCEDURES), *(k for k, _ in R.DOSSIERS), *(k for k, _ in R.CONDITIONS), *(k for k, _ in R.AGENCIES), *(k for k, _ in R.VIOLATIONS), *(k for k, _ in R.FIXES), *(k for k, _ in R.FACTS), "kể từ", "thời hiệu khởi kiện", "thủ tục", "phạt tiền", "truy cứu", "bình quân", "nghiêm cấm", "12 tháng ", "30 ngày ", "15%x", "Án lệ số 7/2021/AL", "Bản án số 12/2020/LĐ-ST", "được hiểu là", "đóng bảo hiểm", "ký hợp đồng"]
PICKS = 9
N = "n AS (SELECT 'dieu:' || doc_id || ':1' AS node_id, CAST(doc_id AS VARCHAR) AS doc_id, 'Điều ' || doc_id % 60 AS label, doc_id % 3 AS ordinal, t AS text, lower(t) AS low FROM (SELECT doc_id, coalesce(text, '') || ' ' || array_to_string(list_transform(range({picks}), lambda k: ({pool})[(doc_id * 7 + k * k * 5 + k) % {n} + 1]), ' ') AS t FROM documents))".format(picks=PICKS, n=len(POOL), pool="[" + ", ".join(f"'{w}'" for w in POOL) + "]")
LAYER_EDGES_SQL = f"WITH {N}, {layer_steps()}, {layer_edges()}"
LAYER_NODES_SQL = f"WITH {N}, {layer_steps()}, {layer_nodes()}"

#: References in the texts of articles, clauses and points: a match's place is the length of all gaps and matches before it.
REFERENCE = "(?i)(?:(?:điểm)\\s+([a-zđ](?:\\d+)?)\\s+)?(?:(?:khoản)\\s+(\\d{1,3})\\s+)?Điều\\s+(\\d+[a-zA-Z]?)"
HASH = "CAST('0x' || substring(md5(node_id), {0}, 4) AS INTEGER)"
CITATIONS_SQL = f"""WITH {PARSE},
cn AS (SELECT node_id, doc_id, concat_ws(' ', text, 'theo khoản ' || ({HASH.format(1)} % 9 + 1) || ' Điều ' || ({HASH.format(5)} % 5 * 3 + 2)) AS text FROM nodes WHERE node_type IN ('Điều', 'Khoản', 'Điểm')),
cm AS (SELECT *, regexp_extract_all(text, '{REFERENCE}') AS m, regexp_extract_all(text, '{REFERENCE}', 1) AS g1, regexp_extract_all(text, '{REFERENCE}', 2) AS g2, regexp_extract_all(text, '{REFERENCE}', 3) AS g3, string_split_regex(text, '{REFERENCE}') AS gaps FROM cn),
ck AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM cm),
cp AS (SELECT node_id, doc_id, text, k, nullif(lower(g1[k]), '') AS point, nullif(g2[k], '') AS clause, lower(g3[k]) AS article, length(m[k]) AS size, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS pos FROM ck),
cw AS (SELECT *, substring(text, CAST(greatest(pos - 90, 0) + 1 AS BIGINT), CAST(least(pos, 90) + size + 120 AS BIGINT)) AS win FROM cp),
tg AS (SELECT DISTINCT doc_id, doc_id AS target FROM nodes UNION SELECT DISTINCT doc_id, CAST(CAST(doc_id AS BIGINT) // 2 AS VARCHAR) FROM nodes),
cx AS (SELECT cw.node_id, k, {NORM.format('win')} AS evidence, CASE WHEN point IS NOT NULL AND clause IS NOT NULL THEN 'diem:' || target || ':' || {SLUG.format('article')} || ':' || clause || ':' || {SLUG.format('point')} WHEN clause IS NOT NULL THEN 'khoan:' || target || ':' || {SLUG.format('article')} || ':' || clause END AS one, 'dieu:' || target || ':' || {SLUG.format('article')} AS two FROM cw JOIN tg USING (doc_id) WHERE NOT contains(win, 'Điều này')),
ce AS (SELECT cx.node_id AS source_id, coalesce(a.node_id, b.node_id) AS target_id, 'DẪN_CHIẾU_ĐẾN' AS relation, evidence, k FROM cx LEFT JOIN nodes a ON a.node_id = cx.one LEFT JOIN nodes b ON b.node_id = cx.two),
cf AS (SELECT {EDGE} AS edge_id, * FROM ce WHERE target_id IS NOT NULL AND source_id <> target_id)
SELECT edge_id, source_id, target_id, relation, substring(arg_min(evidence, (k, evidence)), 1, 500) AS evidence FROM cf GROUP BY edge_id, source_id, target_id, relation"""


def following() -> str:
    steps = [(f"{p}:{a[0]}", f"{p}:{b[0]}", f"{a[1]} sang {b[1]}") for p, rows in (("lifecycle_nld", R.EMPLOYEE_STAGES), ("lifecycle_dn", R.COMPANY_STAGES)) for a, b in zip(rows, rows[1:])]
    return f"SELECT {EDGE} AS edge_id, source_id, target_id, relation, evidence FROM (SELECT source_id, target_id, 'GIAI_DOẠN_TIẾP_THEO' AS relation, evidence FROM {values(steps)} v(source_id, target_id, evidence))"


def fixed_nodes() -> str:
    rows = [(f"lifecycle_nld:{k}", "GiaiĐoạn_NLĐ", v, t) for k, v, t in R.EMPLOYEE_STAGES] + [(f"lifecycle_dn:{k}", "GiaiĐoạn_DoanhNghiệp", v, t) for k, v, t in R.COMPANY_STAGES] + [(k, "MứcĐộRủiRo", v, t) for k, v, t in R.RISKS]
    terms = [(k, k.title(), t) for k, t in R.TERMS if k != "sa thải"]
    return f"SELECT * FROM {values(rows)} v(node_id, node_type, label, text) UNION ALL SELECT {slug('thuatngu:', 'kw')}, 'ThuậtNgữ', label, text FROM {values(terms)} t(kw, label, text)"


#: Descriptions of the law-like documents, of which the id decides what the file is called.
FILE = "CASE CAST(doc_id AS BIGINT) % 6 WHEN 0 THEN '45-2019-QH14_' || doc_id || '.docx' WHEN 1 THEN 'nghị-định-145-2020-NĐ-CP.docx' WHEN 2 THEN '12_VBHN-VPQH.docx' WHEN 3 THEN 'thông tư btc ' || doc_id || '.docx' ELSE 'doc-' || doc_id || '.docx' END"
