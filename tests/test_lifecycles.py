"""The jobs that users start, on small tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from statuta import lifecycles
from statuta.operators import cells, index
from statuta.sources.upserts import Table

CHUNKS = "key long, doc string, status string, content string, v array<double>, eff_state string, is_closure_node boolean, is_vbqppl boolean, hierarchy_level int, field_name string, issue_date date, uses int"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    import datetime

    d = datetime.date
    rows = [
        (1, "A", "Còn hiệu lực", "thuế thu nhập doanh nghiệp", [1.0, 0.0], None, False, True, 2, "x", d(2024, 1, 1), 4), (2, "B", "Còn hiệu lực", "thuế giá trị", [0.9, 0.1], "con_hieu_luc", None, None, 5, "x", None, 0),
        (3, "C", "Hết hiệu lực", "thuế cũ", [0.8, 0.1], "het_toan_bo", False, True, 5, "x", d(2000, 1, 1), 0), (4, "D", "Còn hiệu lực", "lao động", [0.0, 1.0], None, False, True, 5, "y", d(2023, 12, 1), 8),
        (5, "E", "Còn hiệu lực", "thuế lao động", [0.5, 0.5], None, True, True, 5, "y", d(2024, 1, 1), 0), (6, "F", "Còn hiệu lực", "thuế đất", [0.7, 0.3], None, False, True, 5, "y", d(2024, 1, 1), None),
    ]
    df = spark.createDataFrame(rows, CHUNKS)
    root = tmp_path_factory.mktemp("search")
    return df, index.build(df, "key", F.col("content"), str(root / "i")), cells.build(df, "key", "v", str(root / "c"))


def embed(asked):
    return asked.select("query", F.array(F.lit(1.0), F.lit(0.0)).alias("v"))


def test_search_filters_fuses_and_scores(spark, made):
    chunks, texts, vectors = made
    queries = spark.createDataFrame([(1, "thuế"), (2, "thuế thu nhập"), (3, " "), (4, "zzz")], "query int, text string")
    got = lifecycles.hybrid_search(spark, texts, chunks.drop("v"), queries, vectors, embed, as_of=F.lit("2024-01-31").cast("date"), digits=6).collect()
    one = [r for r in got if r["query"] == 1]
    assert {r["key"] for r in one} == {1, 2, 6} and all(r["rank_b"] is None for r in one)  # a single word asks for no vectors; C and E are hidden
    two = {r["key"]: r for r in got if r["query"] == 2}
    assert set(two) == {1, 2, 4, 6} and two[1]["rank_a"] == two[1]["rank_b"] == 1 and two[4]["rank_a"] is None
    best = two[1]
    assert math.isclose(best["final"], 0.5 * min(1, 2 / 61 / 0.033) + 0.3 * math.exp(-0.023 * 30) + 0.2 * 4 / 8, abs_tol=2e-6) and best["pos"] == 1
    assert {r["query"] for r in got} == {1, 2}
    # The caller may ask for all states; documents that are out of force go when relations are known.
    every = lifecycles.hybrid_search(spark, texts, chunks.drop("v"), queries, filters={"exclude_states": []}, digits=6)
    assert {r["key"] for r in every.where("query = 1").collect()} == {1, 2, 3, 6}
    edges = spark.createDataFrame([("X", "F", "Thay thế"), ("Y", "A", "Sửa đổi, bổ sung")], "src string, dst string, relation string")
    valid = lifecycles.hybrid_search(spark, texts, chunks.drop("v"), queries, filters={"exclude_states": []}, digits=6, edges=edges).where("query = 1").collect()
    assert {r["key"]: r["warnings"] for r in valid} == {1: "amended by: Y", 2: ""}


def test_impact_batch_replaces_its_version(spark, tmp_path):
    docs = spark.createDataFrame([("a", "Thuế", "tài chính", 2, True), ("b", "Lao động", None, 5, False), ("c", "khác", "khác", None, True)], "doc string, title string, field string, level int, is_business boolean")
    chunks = spark.createDataFrame([("a", 0, "phải nộp thuế"), ("a", 1, "nghiêm cấm trốn thuế"), ("b", 0, "người lao động phải"), ("c", 0, "không có gì")], "doc string, chunk int, content string")
    vectors = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.9, 0.2]), ("b", 0, [0.1, 1.0])], "doc string, chunk int, v array<double>")
    samples = spark.createDataFrame([("T", [1.0, 0.0]), ("L", [0.0, 1.0])], "code string, v array<double>")
    lexicon = spark.createDataFrame([("T", "thuế"), ("L", "lao động")], "code string, term string")
    known = lifecycles.profiles(vectors, samples)
    path = str(tmp_path / "impact")
    for version in ("v1", "v2", "v1"):
        out = lifecycles.impact_batch(docs, chunks, vectors, known, lexicon, version, path)
    rows = {(r["doc"], r["code"]): r for r in out.collect()}
    assert rows["a", "T"]["restrictions"] == 4.0 and rows["a", "T"]["rel_lexicon"] == 1.0 and rows["a", "T"]["impact_raw"] > rows["a", "L"]["impact_raw"]
    assert math.isclose(rows["a", "T"]["impact_pct_doc"] + rows["a", "L"]["impact_pct_doc"], 100.0) and rows["a", "T"]["pct_industry"] == 100.0
    assert {d for d, _ in rows} == {"a", "b"}  # neither layer knows c
    back = spark.read.parquet(path).groupBy("scorer_version").count().collect()
    assert {r["scorer_version"]: r["count"] for r in back} == {"v1": len(rows), "v2": len(rows)}


def land(folder, pages):
    for p, items in enumerate(pages, 1):
        at = folder / f"page={p}"
        at.mkdir(parents=True, exist_ok=True)
        (at / "part.txt").write_text(json.dumps({"data": {"items": items}}) if items is not None else "{", encoding="utf-8")


def item(n, day, status="Còn hiệu lực", title="t"):
    return {"id": str(n), "docNum": f"{n}/2024/NĐ-CP", "title": title, "issueDate": day, "effStatus": {"name": status}}


def test_daily_ingest_twice(spark, tmp_path):
    table = Table(str(tmp_path / "t"), ["doc_num", "agency_name"], "merge", refresh=("title", "eff_status", "html", "digest"), buckets=4)
    history = Table(str(tmp_path / "h"), ["doc_num", "agency_name", "batch"], buckets=2)
    texts = str(tmp_path / "i")
    land(tmp_path / "p1", [[item(3, "2024-03-03"), item(2, "2024-03-02")], [item(2, "2024-03-02"), item(1, "2024-01-01")], [item(0, "2023-01-01")]])
    run = lambda pages, batch: lifecycles.daily_ingest(spark, str(tmp_path / pages), table, history, texts, "2024-01-01", batch)
    first = run("p1", 1)
    assert (first["read"], first["new"], first["changed"], first["cutoff"], first["applied"]) == (3, 3, 0, "2024-01-01", True)
    land(tmp_path / "p2", [[item(4, "2024-03-04", title="mới"), item(3, "2024-03-03")], None, [item(2, "2024-03-02", "Hết hiệu lực toàn bộ"), item(1, "2024-01-01", "đổi")]])
    second = run("p2", 2)
    assert (second["read"], second["new"], second["changed"], second["status_changes"], second["bad_pages"], second["cutoff"]) == (3, 1, 1, 1, 1, "2024-01-18")
    again = run("p2", 2)
    assert (again["new"], again["changed"], again["applied"]) == (0, 0, False)
    rows = {r["doc_num"]: r["eff_status"] for r in table.read(spark).collect()}
    assert rows == {"4/2024/NĐ-CP": "Còn hiệu lực", "3/2024/NĐ-CP": "Còn hiệu lực", "2/2024/NĐ-CP": "Hết hiệu lực toàn bộ", "1/2024/NĐ-CP": "Còn hiệu lực"}
    assert [tuple(r) for r in history.read(spark).select("doc_num", "old_status", "new_status").collect()] == [("2/2024/NĐ-CP", "Còn hiệu lực", "Hết hiệu lực toàn bộ")]
    hits = index.search(spark, texts, spark.createDataFrame([(1, ["moi"])], "query int, terms array<string>"), 5).collect()
    assert len(hits) == 1 and hits[0]["key"].startswith("4/2024")
