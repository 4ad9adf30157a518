"""Word lists, keyword rules and relation weights that results depend on."""

from __future__ import annotations

KEY_STOP = ("theo", "quy", "dinh", "cho", "toi", "hoi", "nhu", "nao", "ve", "va", "la", "cua", "duoc", "khong", "trong", "nhung", "gi", "cac", "mot", "so")
GRAPH_STOP = KEY_STOP
#: Stop words of the notebook's full-text questions.
NOTEBOOK_STOP = ("theo", "quy", "dinh", "cho", "toi", "hoi", "nhu", "nao", "ve", "va", "la", "cua", "duoc", "khong", "trong", "cac")
FULLTEXT_STOP = ("theo", "quy", "dinh", "cho", "toi", "hoi", "nhu", "nao", "ve")
LEXICAL_STOP = (
    "theo", "quy", "định", "dinh", "cho", "tôi", "toi", "hỏi", "hoi", "như", "nhu", "nào", "nao", "về", "ve", "và", "va", "là", "la",
    "của", "cua", "được", "duoc", "không", "khong", "trong", "những", "nhung", "gì", "gi", "các", "cac", "một", "mot", "số", "so",
)

#: Kinds of law by keyword in lower-cased file name and title, the first that fits.
DOC_TYPES = (
    (("bộ-luật", "bộ luật"), "Bộ luật"),
    (("nghị-định", "nghị định"), "Nghị định"),
    (("thông-tư", "thông tư"), "Thông tư"),
    (("nghị-quyết", "nghị quyết"), "Nghị quyết"),
    (("vbhn",), "Văn bản hợp nhất"),
    (("luật",), "Luật"),
)
DOC_TYPE = "Văn bản"
#: Issuers by keyword in upper-cased, accent-free code and file name, the first that fits.
ISSUERS = (
    (("TT-BLDTBXH",), "Bộ Lao động - Thương binh và Xã hội"),
    (("TT-BNV",), "Bộ Nội vụ"),
    (("ND-CP",), "Chính phủ"),
    (("UBTVQH",), "Ủy ban Thường vụ Quốc hội"),
    (("QH",), "Quốc hội"),
    (("BTC",), "Bộ Tài chính"),
)
ISSUER = "Cơ quan nhà nước"

#: Native relation without accents, its type, its weight in expansion, followed outwards, followed backwards.
RELATIONS = (
    ("THUOC_VE", "BELONGS_TO", 0.45, True, False),
    ("HUONG_DAN", "GUIDES", 0.62, True, True),
    ("DAN_CHIEU_DEN", "CITES", 0.72, True, False),
    ("SUA_DOI", "AMENDS", 0.58, True, True),
    ("THAY_THE", "REPLACES", 0.58, True, True),
    ("BAN_HANH", "ISSUED_BY", 0.4, False, False),
    ("DUOC_DINH_NGHIA_LA", "DEFINED_AS", 0.85, True, False),
    ("AP_DUNG_CHO", "APPLIES_TO", 0.75, True, False),
    ("CO_THAM_SO", "HAS_PARAMETER", 0.70, True, False),
    ("KY_KET", "SIGNS", 0.65, True, False),
    ("THUC_HIEN", "PERFORMS", 0.72, True, False),
    ("CO_QUYEN_HUONG", "ENTITLED_TO", 0.80, True, False),
    ("BI_NAM_TRONG_DANH_MUC_CAM", "PROHIBITED_BY", 0.85, True, False),
    ("BAT_DAU_TINH_THOI_HIEU", "STARTS_LIMITATION", 0.78, True, False),
    ("CHUYEN_TRANG_THAI", "TRANSITIONS_STATE", 0.75, True, False),
    ("YEU_CAU_DIEU_KIEN", "REQUIRES_CONDITION", 0.82, True, False),
    ("BAO_GOM_HO_SO", "INCLUDES_DOSSIER", 0.80, True, False),
    ("NOP_TAI", "SUBMITTED_AT", 0.70, True, False),
    ("CO_THOI_HAN_LA", "HAS_DURATION", 0.75, True, False),
    ("GIAI_DOAN_TIEP_THEO", "NEXT_STAGE", 0.68, True, False),
    ("KICH_HOAT_NGHIA_VU", "TRIGGERS_OBLIGATION", 0.80, True, False),
    ("GAY_RA_RUI_RO", "CAUSES_RISK", 0.85, True, False),
    ("KHAC_PHUC_BANG", "MITIGATED_BY", 0.82, True, False),
    ("AP_DUNG_DIEU_LUAT", "APPLIES_ARTICLE", 0.85, True, False),
    ("CO_TINH_TIET_TUONG_TU", "SIMILAR_FACTS", 0.88, True, False),
    ("DAN_DEN_PHAN_QUYET", "LEADS_TO_RULING", 0.85, True, False),
)
OTHER_RELATION, OTHER_WEIGHT = "RELATED_TO", 0.4

#: Questions that may be cached for all, and what makes them private.
PUBLIC = r"(?iuU)\b(pháp luật|quy định|bộ luật|luật|nghị định|thông tư|điều kiện|thủ tục|hồ sơ|thời hạn|mức phạt|xử phạt|cơ quan|nghĩa vụ|quyền|được phép|hiệu lực)\b"
PRIVATE = r"(?iuU)\b(tôi|mình|chúng tôi|của tôi|của mình|công ty tôi|gia đình tôi|vợ tôi|chồng tôi|con tôi|nhà tôi|hợp đồng của|vụ việc của|địa chỉ|cccd|cmnd|căn cước|số điện thoại|email của|mã số thuế của)\b"
IDENTIFIER = r"(?iuU)(?:https?://|www\.|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|\b\d{6,}\b)"

#: Hosts whose pages count as official.
OFFICIAL = ("vanban.chinhphu.vn", "vbpl.vn", "quochoi.vn", "congbao.chinhphu.vn", "moj.gov.vn")
