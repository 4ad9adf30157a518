import json

import pytest

from grafloom.engine import Engine
from grafloom.sources import sinks

LAW = ["BỘ LUẬT LAO ĐỘNG", "Chương I. Quy định chung", "Điều 1. Phạm vi điều chỉnh của bộ luật này", "1. Tiêu chuẩn lao động, quyền và nghĩa vụ", "Điều 2. Thử việc và hợp đồng thử việc", "1. Thời gian thử việc không quá 60 ngày kể từ ngày ký", "2. Trường hợp khác theo khoản 1 Điều 1 của luật"]


@pytest.fixture(scope="module")
def index(spark):
    lines = spark.createDataFrame([("law", k, t) for k, t in enumerate(LAW)] + [("long", 0, "Điều 9. " + " ".join(f"từ{k}" for k in range(700)))], "doc_id string, n int, line string")
    return Engine(spark, dim=64).build(lines)


def test_build(index):
    kinds = {}
    for c in index.chunks.collect():
        kinds.setdefault(c.chunk_type, []).append(c)
    semantic = kinds.pop("semantic")
    assert {k: len(v) for k, v in kinds.items()} == {"structure": 1, "document_intro": 1, "article": 3, "clause": 3, "sliding": 3} and all(c.token_count >= 4 for v in kinds.values() for c in v)
    assert kinds["clause"][0].citation.startswith("Bộ Luật Lao Động (law) > Chương I. Quy định chung > Điều ")
    assert {"hopdong:thu-viec", "thuatngu:thu-viec", "lifecycle_nld:thu-viec"} <= {c.node_id for c in semantic}
    ids = {n.node_id for n in index.nodes.collect()}
    assert len(ids) == index.nodes.count() and all({e.source_id, e.target_id} <= ids for e in index.edges.collect())
    assert {d.doc_id for d in index.docs.collect()} == {"law", "long", "he-thong"}
    relations = {e.relation for e in index.edges.collect()}
    assert {"THUỘC_VỀ", "DẪN_CHIẾU_ĐẾN", "ĐƯỢC_ĐỊNH_NGHĨA_LÀ", "KÍCH_HOẠT_NGHĨA_VỤ", "BAN_HÀNH"} <= relations
    assert index.stats().first().chunks == 11 + len(semantic)


@pytest.mark.parametrize("mode", ["lexical", "dense", "rag", "graph", "Hybrid-RAG", "sqlite", "notebook"])
def test_retrieve(spark, index, mode):
    asked = spark.createDataFrame([(1, "Thời gian thử việc là bao nhiêu ngày?"), (2, "zzz")], "query_id long, text string")
    got = index.retrieve(asked, mode, 3).collect()
    first = [r.chunk_id for r in got if r.query_id == 1 and r.rank == 1]
    assert first and ("-law-2" in first[0] or "thu-viec" in first[0] or mode == "dense")
    assert max(r.rank for r in got) <= 3 and all(r.reasons for r in got)
    with pytest.raises(ValueError):
        index.retrieve(asked, "no such")


def test_write_and_open(spark, index, tmp_path):
    index.write(str(tmp_path / "i"))
    again = Engine(spark, dim=64).open(str(tmp_path / "i"))
    assert again.chunks.count() == index.chunks.count()
    with pytest.raises(ValueError):
        Engine(spark, dim=32).open(str(tmp_path / "i"))
    sinks.write_jsonl(index.chunks, str(tmp_path / "j"))
    row = json.loads(next(p for p in (tmp_path / "j").glob("*.json") if p.stat().st_size).read_text().splitlines()[0])
    assert "vector" not in row and row["chunk_id"]
    sinks.write_csv([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")], str(tmp_path / "c"))
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).select("a", "b").collect() if r.a) == [("1", None)]
    sinks.write_csv([spark.createDataFrame([(1, 2)], "a int, x int")], str(tmp_path / "d"), columns=["a", "z"])
    texts = [p.read_text(encoding="utf-8") for p in (tmp_path / "d").glob("*.csv")]
    assert "\ufeffa,z\n1,\n" in texts and all(t.startswith("\ufeffa,z\n") for t in texts if t)


def test_sync(spark, index):
    old = {"nodes": index.nodes.limit(0), "edges": index.edges.limit(0), "chunks": index.chunks.limit(0)}
    merged = sinks.sync_graph(index.nodes, index.edges, index.chunks, old)
    ids = {n.node_id for n in merged["nodes"].collect()}
    assert all({e.source_id, e.target_id} <= ids for e in merged["edges"].collect()) and merged["edges"].count() > 0
    report = sinks.sync_all(spark, {"good": lambda: None, "bad": lambda: 1 / 0}).collect()
    assert [(r.sink, r.status) for r in report] == [("good", "ok"), ("bad", "error")]
