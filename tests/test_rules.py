"""Rule tables, quirks and structure of texts."""

import datetime

import pytest
from pyspark.sql import functions as F

from statuta.functions import facts, phrases, text, values
from statuta.operators import chunking, graph, impact, jobs, keys, markup, retrieval


def column(spark, value, kind, make):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("number, level, kind", [
    ("135/2025/QH15", 2, "luat"), ("32-LCT/HĐNN8", 3, "phap_lenh"), ("292/2026/NĐ-CP", 5, "nghi_dinh"), ("15/2026/QĐ-TTg", 6, "quyet_dinh_ttg"),
    ("44/2022/TT-BTC", 7, "thong_tu"), ("12/2026/NQ-HĐND", 8, "nghi_quyet_hdnd"), ("40/2026/QĐ-UBND", 9, "quyet_dinh_ubnd"), ("1968/QĐ-BTC", 99, "quyet_dinh_ca_biet"),
    ("16-NQ/TW", 99, "van_ban_dang"), ("5/TTr-CP", 99, "khong_xac_dinh"), ("Dự thảo Luật", 99, "du_thao"),
])
def test_hierarchy(spark, number, level, kind):
    h = column(spark, number, "string", lambda x: facts.hierarchy(x))
    assert (h["level"], h["kind"]) == (level, kind)


def test_constitution_by_type_and_local_agency(spark):
    row = spark.createDataFrame([("Không số", "Hiến pháp", "Quốc hội"), ("Không số", "x", "UBND tỉnh A")], "n string, t string, a string")
    got = [r["h"] for r in row.select(facts.hierarchy(F.col("n"), F.col("t"), F.col("a")).alias("h")).collect()]
    assert (got[0]["level"], got[1]["scope"]) == (1, "tinh")


@pytest.mark.parametrize("term, sentence, n", [("phải", "bên phải", 0), ("phải", "xe đi bên phải và phải bật đèn", 1), ("cấm", "nghiêm cấm", 1), ("điện", "ếđiện điện", 1)])
def test_term_count_needs_borders_and_skips_traps(spark, term, sentence, n):
    assert column(spark, sentence, "string", lambda x: text.term_count(x, term)) == n


def test_longer_terms_hold_shorter_ones(spark):
    assert column(spark, "Nghiêm cấm", "string", phrases.weighted_total) == 3.0
    assert column(spark, "không được phép", "string", phrases.weighted_total) == 2.0
    assert column(spark, "buộc phải", "string", phrases.weighted_total) == 3.0  # the short one counts, too


def test_number_keys(spark):
    assert column(spark, "89-2025-QĐ", "string", text.citation_key) == "89/2025/qd"
    assert column(spark, " 12/2026 / NĐ - CP", "string", text.normal_number) == "12/2026/NĐ-CP"
    assert column(spark, "292/2026/NĐ-CP", "string", text.slug) == "292-2026-ndd-cp"
    assert column(spark, "Theo 112/2025/QH15, số 01/HĐ-BHXH-2025 và 12/11, 112/2025/QH15.", "string", text.citations) == ["112/2025/QH15"]
    assert column(spark, "Nghị định 292/2026/NĐ-CP sửa 1/2020/NĐ-CP", "string", text.title_number) == "292/2026/NĐ-CP"
    assert column(spark, "Nghị định 8999998/2026/NĐ-CP sửa 1/2020/NĐ-CP", "string", text.title_number) == "8999998/2026/NĐ-CP"
    assert column(spark, "Chỉ thị 1234567-TB/VPTW", "string", text.title_number) == "1234567-TB/VPTW"


def test_public_slug_marks_doubtful_numbers(spark):
    df = spark.createDataFrame([("292/2026/NĐ-CP", "k"), ("64/2026/QĐ-UBND", "k"), (None, "k")], "n string, k string")
    got = [r["s"] for r in df.select(text.public_slug("n", "k").alias("s")).collect()]
    assert got[0] == "292-2026-ndd-cp" and got[1].startswith("64-2026-qdd-ubnd--") and got[2].startswith("khong-so--")


def test_effectivity_never_defaults_to_in_force(spark):
    d = datetime.date
    df = spark.createDataFrame([("Còn hiệu lực", None, d(2020, 1, 1)), (None, d(2010, 1, 1), None), (None, d(2030, 1, 1), None), ("Hết hiệu lực", None, None)], "s string, a date, b date")
    got = [r["e"]["state"] for r in df.select(facts.effectivity(F.col("s"), F.col("a"), F.col("b"), F.lit("2026-08-18").cast("date")).alias("e")).collect()]
    assert got == ["het_toan_bo", "khong_ro", "chua_hieu_luc", "het_toan_bo"]


def test_provinces(spark):
    df = spark.createDataFrame([("UBND Thành phố Đồng Nai",), ("HĐND tỉnh Hải Dương",), ("Bộ Tài chính",)], "agency string")
    got = {r["agency"]: (r["province_raw"], r["province_now"]) for r in facts.provinces(df, "agency").collect()}
    assert got["UBND Thành phố Đồng Nai"] == ("dong-nai", "dong-nai") and got["HĐND tỉnh Hải Dương"] == ("hai-duong", "hai-phong") and got["Bộ Tài chính"] == (None, None)


def test_percentile_and_layers(spark):
    rows = spark.createDataFrame([("K", float(x), x <= 4) for x in (1, 2, 3, 4, 9)] + [("A", 1.0, False)], "g string, v double, ref boolean")
    got = {(r["g"], r["v"]): r["p"] for r in impact.percentile_vs_reference(rows, "g", "v", F.col("ref"), "p").collect()}
    assert got["K", 2.0] == 50.0 and got["K", 9.0] == 100.0 and got["A", 1.0] == 0.0
    lex = spark.createDataFrame([("d1", "K", 0.6), ("d2", "K", 1.0)], "doc string, code string, rel double")
    emb = spark.createDataFrame([("d1", "K", 0.0), ("d1", "A", 1.0), ("d3", "K", 0.7)], "doc string, code string, rel double")
    f = {(r["doc"], r["code"]): round(r["relevance"], 4) for r in impact.fused(lex, emb, "doc", "code").collect()}
    assert f == {("d1", "K"): 0.27, ("d1", "A"): 0.55, ("d2", "K"): 1.0, ("d3", "K"): 0.7}


def test_chunks_by_articles_with_limits():
    body = "Lời nói đầu của văn bản này dài hơn năm mươi ký tự để thành phần mở đầu.\n\nĐiều 1. Phạm vi\n" + "a " * 80 + "\nĐiều 2. Ngắn\nx\nĐiều 3. Dài\n" + ("b" * 900 + "\n\n") * 3 + "c" * 4500
    got = chunking.chunk(body)
    assert [k for _, _, k in got][:2] == ["preamble", "dieu"] and "Điều 2" in got[1][1]  # the short one joined the one before
    assert all(len(c) <= 2000 for _, c, _ in got) and got[-1][0] == "Điều 3. Dài"
    assert chunking.chunk("ngắn") == [("Toàn văn", "ngắn", "full")]


def slow_chunk(text, most, least):
    """Chunks by joining paragraph after paragraph."""
    out = []
    for head, body, kind in next((x for x in (chunking.by_heads(text, v) for v in chunking.LEVELS) if len(x) > 1), [("Toàn văn", text, "full")]) if len(text) >= least else [("Toàn văn", text, "full")]:
        if len(body) > most and len(text) >= least:
            held = None
            for p in [*body.split("\n\n"), None]:
                if p is not None and len(p) <= most and (held is None or len(held) + 2 + len(p) <= most):
                    held = p if held is None else f"{held}\n\n{p}"
                    continue
                if held is not None and held.strip():
                    out.append((head, held.strip(), kind))
                held = p if p is not None and len(p) <= most else None
                if p is not None and len(p) > most:
                    out += [(head, p[i : i + most].strip(), kind) for i in range(0, len(p), most) if p[i : i + most].strip()]
        elif len(body) < least and out:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n\n{body}", out[-1][2])
        else:
            out.append((head, body, kind))
    return out


def test_chunks_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for _ in range(150):
        parts = ["x" * rng.randint(1, 90) + " y" * rng.randint(0, 40) for _ in range(rng.randint(1, 12))]
        heads = [f"{rng.choice(['Điều', 'Chương'])} {i + 1}. t{i}" for i in range(rng.randint(0, 6))]
        both = parts + heads
        rng.shuffle(both)
        texts.append(rng.choice(["\n\n", "\n"]).join(both))
    for most, least in ((120, 30), (2000, 100), (60, 1)):
        for t in texts:
            assert [tuple(c) for c in chunking.chunk(t, most, least)] == slow_chunk(t, most, least)


def test_html_cleaning(spark):
    html = "<head><title>t</title></head><style>p{}</style><p>A&nbsp;<b>đậm</b> &#272;&#9999999999;&#xD800;</p><!-- x --><table><tr><td>1</td><td>2</td></tr></table><script>bad"
    df = spark.createDataFrame([(html,), (None,), ("<p><b>open<br>x <i>y</i></p>a\r\nb  c <unknown z> &lt;p&gt; &amp;lt; <!-- open",), ("<STRONG>a <em>b</strong> c",)], "html string")
    got = [r["x"] for r in df.select(markup.clean_text(F.col("html")).alias("x")).collect()]
    assert got == ["A **đậm** Đ\n\n| 1 | 2", "", "open\nx *y*\n\na\nb c <p> &lt;", "**a b** c"]


def test_markdown_of_pages():
    page = "<h2>T</h2><ul><li>a</li><li><a class=x href='/u?a=1'>b <b>c</b></a></li></ul><a>no</a><hr/><th>k</th>"
    assert markup.readable(page, markdown=True) == "## T\n\n- a\n\n- [b **c**](/u?a=1)\n\nno\n---\n| **k**"


def test_safe_html(spark):
    md = "# A <b>\n\n- x\n- *y*\n\n a & **b**\nc \n\n\n\n####### no"
    assert column(spark, md, "string", markup.safe_html) == "<h1>A &lt;b&gt;</h1><ul><li>x</li><li><em>y</em></li></ul><p>a &amp; <strong>b</strong><br>c</p><p>####### no</p>"
    assert column(spark, None, "string", markup.safe_html) == ""


def test_grid_spans():
    g = markup.grids('<table><tr><td rowspan="2">a</td><td colspan="2">b</td></tr><tr><td>c</td><td>d</td></tr></table>')
    assert g == [[["a", "b", ""], ["", "c", "d"]]]


def test_live_rows_are_not_crowded_out(spark):
    rows = [(i, "het_toan_bo", False) for i in range(50)] + [(100, "con_hieu_luc", False), (101, None, None), (102, "con_hieu_luc", True)]
    df = spark.createDataFrame(rows, "id int, eff_state string, is_closure_node boolean")
    df = df.withColumns({"is_vbqppl": F.lit(None).cast("boolean"), "hierarchy_level": F.lit(None).cast("int"), "issue_date": F.lit(None).cast("date"), "field_name": F.lit(None).cast("string")})
    kept = df.where(retrieval.chunk_filter(exclude_states=["het_toan_bo"])).orderBy("id").limit(10)
    assert [r["id"] for r in kept.collect()] == [100, 101]
    assert df.where(retrieval.chunk_filter(exclude_states=[])).count() == 52


def test_cycles_end(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {r["node"]: r["depth"] for r in graph.hops(e, spark.createDataFrame([("a",)], "node string"), directed=True).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_frontier_null_source_meets_empty_and_full_hub_set(spark):
    refs = spark.createDataFrame([(1, "t1", "n1", "r"), (2, "t2", "n2", "r"), (1, "t3", "Không số", "r")], "source int, target string, number string, relation string")
    src = spark.createDataFrame([(1, None, None), (2, "s2", 1)], "source int, source_ext string, depth int")
    known = spark.createDataFrame([("x",)], "target string")
    none, hub = (spark.createDataFrame(r, "target string, state string") for r in ([("q", "PENDING")], [("h", "HUB_NOT_EXPANDED")]))
    assert {(r["target"], r["depth"]) for r in graph.frontier(refs, src, known, none).collect()} == {("t1", 1), ("t2", 2)}
    assert {r["target"] for r in graph.frontier(refs, src, known, hub).collect()} == {"t2"}


def test_daily_cap_moves_jobs_and_refuses_after_a_week(spark):
    d = datetime.date(2024, 1, 1)
    new = spark.createDataFrame([(d, i, str(i)) for i in range(20)], "day date, ord long, key string")
    old = spark.createDataFrame([(d, 1)], "day date, n long")
    got = {r["ord"]: r["scheduled_for"] for r in jobs.schedule(new, old, cap=2).collect()}
    assert got[0] == d and got[1] == d + datetime.timedelta(1) and got[14] == d + datetime.timedelta(7) and got[15] is None


def test_budget_packing_leaves_oversize_alone(spark):
    assert column(spark, [400, 700, 200, 1500, 100], "array<int>", lambda x: jobs.packed_by_budget(x, 1000)) == [0, 1, 1, 2, 3]


def test_worst_reference_wins(spark):
    r = spark.createDataFrame([("f", 1, "con_hieu_luc", ["a"]), ("f", 2, "co_ban_thay_the", ["b", "a"]), ("g", 1, "khong_ro", None)], "form string, ord int, s string, by array<string>")
    got = {x["form"]: (x["state"], x["replaced_by"]) for x in jobs.worst_wins(r, "form", "s", "ord", "by").collect()}
    assert got == {"f": ("co_ban_thay_the", ["a", "b"]), "g": ("khong_ro", [])}


def test_ambiguous_keys_have_no_answer(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "k string, v int")
    assert [(r["k"], r["v"]) for r in keys.unique_lookup(df, "k", "v").collect()] == [("a", 1)]


def test_final_score_takes_a_missing_date_as_fresh(spark):
    df = spark.createDataFrame([(0.033, None, 0, 0)], "r double, d int, u int, m int")
    assert df.select(retrieval.final_score(F.col("r"), F.col("d"), F.col("u"), F.col("m")).alias("s")).first()["s"] == pytest.approx(0.8)


def test_values(spark):
    assert column(spark, "31/12/2024", "string", values.any_date) == datetime.date(2024, 12, 31)
    assert column(spark, "nope", "string", values.any_date) is None
    assert column(spark, "[broken", "string", values.json_array) == []
    assert column(spark, 'x {"k": 1} y', "string", values.embedded_json) == '{"k": 1}'


def test_running_sums_of_a_hot_group(spark):
    from statuta.operators.running import running_sum

    rows = [("hot", i * 7919 % 1000, i) for i in range(1000)] + [("b", 1, 1), ("b", 1, 2), (None, 5, 1), (None, 6, 2)]
    df = spark.createDataFrame(rows, "g string, v int, ord int")
    got = running_sum(df, "g", ["v", "ord"], F.col("v"), "s").toPandas().sort_values(["g", "v", "ord"], na_position="first")
    assert len(got) == len(rows) and (got["s"] == got.groupby("g", dropna=False)["v"].cumsum()).all()


def test_many_queries_meet_vectors_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "id long, v array<double>")
    q = v.where("id % 3 = 0").select(F.col("id").alias("query"), "v")
    whole = {tuple(r) for r in retrieval.nearest(v, "id", "v", q).collect()}
    monkeypatch.setattr(retrieval, "FEW", 3)
    assert {tuple(r) for r in retrieval.nearest(v, "id", "v", q).collect()} == whole and len(whole) == 300


def test_feeds_and_published_indexes(spark, tmp_path):
    from statuta.sources import payloads

    (tmp_path / "a.xml").write_text("<rss><item><title>A</title><link>https://x/tin/Thue-moi-77.aspx</link><category>Thuế</category><pubDate>Mon, 5 Feb 2024 01:00:00</pubDate></item>"
                                    "<item><title>B</title><link>https://x/tin/khac.aspx</link><category>Thuế</category></item></rss>")  # fmt: skip
    (tmp_path / "i.json").write_text('{"documents": [{"slug": "a", "num": "1", "refs": []}, {"slug": "../b"}, {"num": "2"}]}')
    (tmp_path / "k9_chunks.json").write_text('[{"chunk_index": 0, "heading": "h", "content": "c", "char_count": 1, "chunk_type": "full"}]')
    assert [(r["tvpl_id"], str(r["pub_date"])) for r in payloads.feed(spark, str(tmp_path / "a.xml"), ["thuế"]).collect()] == [("77", "2024-02-05")]
    assert [r["slug"] for r in payloads.vault_index(spark, str(tmp_path / "i.json")).collect()] == ["a"]
    assert [(r["moj_id"], r["content"]) for r in payloads.chunk_files(spark, str(tmp_path / "k9_chunks.json")).collect()] == [("k9", "c")]


def test_mean_vectors_of_ragged_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [3.0, None]), (1, [5.0]), (None, [7.0, 8.0]), (2, None), (2, []), (3, [None])]
    got = {(r["g"], r["at"]): r["value"] for r in impact.centroids(spark.createDataFrame(rows, "g int, v array<double>").repartition(3), "g", "v").collect()}
    assert got == {(1, 0): 3.0, (1, 1): 2.0, (None, 0): 7.0, (None, 1): 8.0, (3, 0): None}


@pytest.mark.parametrize("n", [40, 20_000])
def test_batches_of_any_group_equal_the_fold(spark, n):
    """One group of many rows, some of size 0, null or over the budget, beside small groups and a null one."""
    import random

    rng = random.Random(n)
    rows = [(0, i, rng.choice([0, None, 3, 7, 20, 40, 99, 250])) for i in range(n)] + [(g, i, rng.randrange(90)) for g in (1, 2, None) for i in range(g or 5)]
    want, used, batch = {}, {}, {}
    for g, i, s in rows:
        s = s or 0
        if g not in used or used[g] + s > 100:
            used[g], batch[g] = 0, batch.get(g, -1) + 1
        used[g] += s
        want[g, i] = batch[g]
    df = spark.createDataFrame(rows, "g int, i int, size int").repartition(5)
    got = {(r["g"], r["i"]): r["batch"] for r in jobs.budget_batches(df, "g", ["i"], "size", 100).collect()}
    assert got == want
