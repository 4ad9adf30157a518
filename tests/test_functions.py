import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grafloom.functions import text as X
from grafloom.functions import vectors as V
from grafloom.functions.words import DOC_TYPE, DOC_TYPES, IDENTIFIER, ISSUER, ISSUERS, PRIVATE, PUBLIC
from grafloom.sources import files

TEXTS = ["  Điều 36.\t Người  sử dụng lao động ", "ĐẠI HỌC", "", "a b", "Đường số 5 – 12%", "___===...", "éàü ß Ñandú", "x", "tiếng Việt có dấu: thuế, phạt, được", None]


def values(spark, column, texts=TEXTS):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.v for r in rows.select("k", column.alias("v")).orderBy("k").collect()]


def plain(s):
    return "".join(c for c in unicodedata.normalize("NFD", s.replace("Đ", "D").replace("đ", "d")) if unicodedata.category(c) != "Mn")


def test_text_functions(spark):
    some = [t for t in TEXTS if t is not None]
    assert values(spark, X.strip_accents(F.col("t"))) == [None if t is None else plain(t) for t in TEXTS]
    assert values(spark, X.normalize_space(F.col("t")), some) == [re.sub(r"\s+", " ", t).strip() for t in some]
    assert values(spark, X.token_count(F.col("t")), some) == [len(re.findall(X.TOKEN, t)) for t in some]
    assert values(spark, X.is_separator(F.col("t")), some) == [bool(re.fullmatch(r"[_=\-\s.]{3,}", t)) for t in some]
    letters = [[c for c in t if c.isalpha()] for t in some]
    assert values(spark, X.uppercase_ratio(F.col("t")), some) == pytest.approx([sum(c.isupper() for c in x) / len(x) if x else 0.0 for x in letters])
    assert values(spark, X.slugify(F.col("t")), ["Đơn vị số 1!", "---", "A  b"]) == ["ddon-vi-so-1", "item", "a-b"]


def test_terms(spark):
    asked = "Theo Điều 36, người sử dụng lao động được chấm dứt hợp đồng"
    terms = values(spark, X.lexical_terms(F.col("t")), [asked])[0]
    assert "theo" not in terms and "được" not in terms and {"điều", "36", "người"} <= set(terms)
    assert values(spark, X.key_terms(F.col("t")), ["Quy định về thuế và thuế phạt a"]) == [["thue", "phat"]]
    assert values(spark, X.fulltext_terms(F.col("t")), ["theo quy cho"]) == [["theo", "quy", "cho"]]
    assert values(spark, X.graph_terms(F.col("t")), ["thuế la x", "của"]) == [["thuế", "thue"], ["của"]]


def test_lines(spark):
    lines = ["Chương I. Chung", "chương ii", "Mục 2: X", "ĐIỀU 5. Nghỉ", "Điều 5 nghỉ", "1. một", "a) điểm", "đ1) điểm", "QUY ĐỊNH CHUNG", "Tên gọi", "chữ thường"]
    assert values(spark, X.is_structural(F.col("t")), lines) == [True, True, True, True, False, True, True, True, False, False, False]
    assert values(spark, X.is_heading_title(F.col("t")), lines) == [False, False, False, False, True, False, False, False, True, True, False]


def test_names_of_laws(spark):
    stems = ["45-2019-QH14", "12_VBHN-VPQH", "plain"]
    heads = ["", "", "Số: 145 / 2020 / NĐ-CP"]
    df = spark.createDataFrame(list(zip(stems, heads)), "s string, h string")
    assert [r[0] for r in df.select(X.detect_code(F.col("s"), F.col("h"))).collect()] == ["45/2019/QH14", "12/VBHN-VPQH", "145/2020/NĐ-CP"]
    assert values(spark, X.cascade(F.col("t"), DOC_TYPES, DOC_TYPE), ["bộ luật lao động", "nghị định", "luật", "khác"]) == ["Bộ luật", "Nghị định", "Luật", "Văn bản"]
    assert values(spark, X.cascade(F.upper(X.strip_accents(F.col("t"))), ISSUERS, ISSUER), ["145/2020/NĐ-CP", "x/qh14", "?"]) == ["Chính phủ", "Quốc hội", "Cơ quan nhà nước"]


def test_privacy_gate(spark):
    ok = F.length("t").between(20, 1500) & F.col("t").rlike(PUBLIC) & ~F.col("t").rlike(PRIVATE) & ~F.col("t").rlike(IDENTIFIER)
    asked = ["Pháp luật quy định thời hạn khởi kiện tranh chấp lao động là bao lâu?", "Tôi bị công ty sa thải, quyền của tôi là gì?", "Quy định áp dụng cho email an@example.com là gì?", "luật"]
    assert values(spark, ok, asked) == [True, False, False, False]
    same = values(spark, X.public_query(F.col("t")), ["Luật  LAO động?", "luật lao động", "ﬁne  Straße !?"])
    assert same == ["luật lao động", "luật lao động", "fine strasse"]


def test_repair_and_fences(spark):
    broken = ["été", "日本".encode().decode("latin-1"), "été".encode().decode("latin-1"), "plain", "ÿ"]
    assert values(spark, X.repair(F.col("t")), broken) == ["été", "日本", "été", "plain", "ÿ"]
    assert values(spark, X.strip_fence(F.col("t")), ['```json\n{"a": 1}\n```', '{"a": 1}', '```\n{}\n```']) == ['{"a": 1}', '{"a": 1}', "{}"]
    words = " ".join(map(str, range(400)))
    cut = values(spark, X.head_and_tail(F.split("t", " "), 256), [words])[0]
    assert cut == [*map(str, range(64)), *map(str, range(400 - 192, 400))]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-2, 2, width=32), min_size=1, max_size=8))
def test_vectors(spark, v):
    df = spark.createDataFrame([(v, v[::-1])], "a array<float>, b array<float>")
    dot, cos = df.select(V.dot(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("a"))).first()
    assert dot == pytest.approx(sum(x * y for x, y in zip(v, v[::-1])), abs=1e-5)
    assert cos is None if sum(x * x for x in v) == 0 else cos == pytest.approx(1, abs=1e-9)


def test_hash_embedding(spark):
    a, b, none = values(spark, V.hash_embedding(F.col("t"), 32), ["thuế thu nhập", "thuế thu nhập", ""])
    assert a == b and sum(x * x for x in a) == pytest.approx(1) and none == [0.0] * 32


def test_html():
    page = "<html><head><title>t</title><script>var x</script></head><body><nav>menu</nav><main>m<article><p>one<b>two</b></p><br>three<footer>no</footer></article>after</main></body></html>"
    assert files.html_to_text(page) == "one\ntwo\nthree"
    assert files.html_to_text("<body><p>a</p><form>f</form></body>") == "a" and files.html_to_text("<p>x") == "x"
    assert files.html_to_text(None) is None and files.html_to_text("") == ""


def test_docx(spark, tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda *t: "<w:tc>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in t) + "</w:tc>"
    body = "<w:p><w:r><w:t>Điều  1.</w:t><w:br/><w:t>Hai</w:t></w:r></w:p><w:p><w:r><w:t>____</w:t></w:r></w:p><w:tbl><w:tr>" + cell("a") + cell("b", "c") + "</w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    found = files.docx_folder(spark, str(tmp_path)).select(files.docx_lines(F.col("content")).alias("l"), files.docx_lines(F.col("content"), tables=False).alias("p")).first()
    assert found.l == ["Điều 1.", "Hai", "a | b c"] and found.p == ["Điều 1.", "Hai"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.docx_folder(spark, str(tmp_path / "empty"))


def test_other_sources(spark, tmp_path):
    import json
    import struct

    samples = [{"id": str(k), "question": "q", "relevant_contexts": [{"chunk_id": "c"}]} for k in range(5)]
    (tmp_path / "s.json").write_text(json.dumps(samples))
    assert [r.id for r in files.eval_samples(spark, str(tmp_path / "s.json"), 1, 2).collect()] == ["1", "2"]
    blob = spark.createDataFrame([(bytearray(struct.pack("<2f", 0.5, -1)),)], "b binary")
    assert blob.select(files.blob_vector(F.col("b"))).first()[0] == [0.5, -1.0]
    assert values(spark, files.extractor(F.lit(""), F.col("t")), ["a.pdf", "a.docx", "a"]) == ["pdf", "docx", "html"]
    assert values(spark, files.text_lines(F.col("t")), [" a  b \n---\n\nc"]) == [["a b", "c"]]


def test_smart_titles(spark):
    lines = ["BỘ LUẬT\n-----\nLAO ĐỘNG\nCăn cứ Hiến pháp\nx", "Điều 1. A", "một\nhai\nba\nbốn"]
    assert values(spark, X.smart_title(F.split("t", "\n"), F.lit("ten-tep")), lines) == ["Bộ Luật Lao Động", "ten tep", "một hai ba"]
