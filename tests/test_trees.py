"""Trees of pages, listing and form pages, against a page generator that knows what it wrote."""

import datetime
import random
from html import escape

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statuta.operators import forms, records, trees
from statuta.session import spread


def nodes_of(page):
    t = trees.parsed(page)
    return t, {(n["tag"], n["attrs"][0][1] if n["attrs"] else ""): n for n in t["nodes"]}


def plain(t, n):
    return t["text"][n["text_from"] : n["text_to"]].replace(trees.STRING, "").replace(trees.BLOCK, "\n")


def test_elements_close_what_is_open_inside_them():
    t, n = nodes_of('<div id=a>one<p id=b>two<b id=c>three</div>four<p id=d>five</x></p><br/>six')
    assert plain(t, n["div", "a"]) == "onetwothree\n" and plain(t, n["p", "b"]) == "twothree" and plain(t, n["b", "c"]) == "three" and plain(t, n["p", "d"]) == "five"
    assert [x["parent"] for x in t["nodes"]] == [-1, 0, 1, -1, -1] and [x["last"] for x in t["nodes"]] == [2, 2, 2, 3, 4]
    assert trees.joined and t["text"].endswith("six" + trees.STRING) and t["error"] is None


def test_attributes_in_any_order_and_hidden_strings():
    t, n = nodes_of("<a title='x > y' HREF=/z class='b a'>Q&amp;A</a><script>if (a < b) '<p>'</script><style>p</style><!-- c --><template>no<i>no</i></template>")
    a = t["nodes"][0]
    assert dict(a["attrs"]) == {"title": "x > y", "href": "/z", "class": "b a"} and a["classes"] == ["b", "a"] and t["text"] == "Q&A" + trees.STRING


def test_markup_of_an_element_is_that_of_the_page():
    page = "<div>\n<p class=x>Đ<b>ộc</b>\n lập</p></div>"
    t, n = nodes_of(page)
    p = n["p", "x"]
    assert page[p["html_from"] : p["html_to"]] == "Đ<b>ộc</b>\n lập"


def test_pages_that_cannot_be_read_are_told(spark):
    df = spark.createDataFrame([(1, "<![oops[ x ]]><p>a</p>"), (2, None), (3, ""), (4, "<p>ok</p>")], "k int, html string")
    got = {r["k"]: r["t"] for r in df.select("k", trees.tree(F.col("html")).alias("t")).collect()}
    assert all(got[k]["nodes"] == [] and got[k]["error"] is None for k in (2, 3)) and len(got[4]["nodes"]) == 1
    assert got[1]["error"] is not None or len(got[1]["nodes"]) == 1
    rows = records.detail(df, "k", "html").select("k", "status").collect()
    assert {r["k"]: r["status"] for r in rows if r["k"] != 1} == {2: "EMPTY_BODY", 3: "EMPTY_BODY", 4: "EMPTY_BODY"}


# Pages made at random: the generator writes nested markup and keeps the answer.


def cut(rng, text):
    """The text with inline tags around parts of it: nothing may come between the parts."""
    at = rng.randrange(len(text) + 1)
    return f"<span>{escape(text[:at])}</span><span lang=vi>{escape(text[at:])}</span>"


def attributes(rng, **values):
    parts = [f"{k}{rng.choice(['', ' '])}={q}{v}{q}" for k, v in values.items() for q in [rng.choice("\"'")]] + rng.choice([[], ["hidden"], ["data-x='1>0'"]])
    rng.shuffle(parts)
    return " ".join(parts)


def listing_page(rng, key):
    want, html, seen = [], [f"<p>Tìm thấy {1000 + key:,} {rng.choice(['biểu mẫu', 'mẫu', 'BIỂU MẪU'])}</p>"], set()
    for i in range(rng.randrange(6)):
        source, number, title = rng.choice(["bieumau", "hopdong", "tin"]), rng.randrange(9), f"Mẫu  số {i} & <{key}>"
        day, words = rng.choice([None, datetime.date(2024, rng.randrange(1, 13), rng.randrange(1, 29))]), [f"từ {j}" for j in range(rng.randrange(3))]
        around = rng.choice(["div class='row content-0'", "div class='content-1'", "div class=content"])
        row = f"<{around}><div class=in><p {attributes(rng, **{'class': 'a nqTitle'})}>\n<a {attributes(rng, href=f'/{source}/{number}/s-{i}#x', title='t')}> {cut(rng, title)}\n</a></p><div>-</div></div>"
        held = around != "div class=content"
        row += "<p class='links-bot'>" + ",".join(f"<a href='/k'>{cut(rng, w)}</a>" for w in words) + "<a> </a></p>"
        row += f"<div><div class='right-col x'><i>Cập nhật:</i> {f'{day.day}/{day.month}/{day.year}' if day else '45/1/2024'}</div></div></div>"
        html.append(row)
        k = f"{source}-{number}"
        if source != "tin" and k not in seen:
            seen.add(k)
            # Without a striped row the nearest element around the link counts, which holds no words and no date.
            want.append((key, k, f"s-{i}", " ".join(title.split()), tuple(words) if held else (), day if held else None, 1000 + key, key % 2 == 0))
    html.append("<p class=nqTitle><b><a href='/bieumau/99/not-right-inside'>x</a></b></p>" + ("<a><b>TRANG</b> Sau</a>" if key % 2 == 0 else "<b>trang sau</b>"))
    return "".join(html), want


def test_listings_give_what_was_written(spark):
    rng = random.Random(1)
    made = [(k, *listing_page(rng, k)) for k in range(60)]
    got = records.listing(spark.createDataFrame([(k, h) for k, h, _ in made], "page int, html string").repartition(3), "page", "html", base="https://x")
    rows = [(r["page"], r["form_key"], r["slug"], r["title"], tuple(r["keywords"]), r["updated_on"], r["total"], r["has_next"]) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(str(w) for _, _, ws in made for w in ws)
    assert all(r["error"] is None and r["url"].startswith(f"https://x/{r['source']}/{r['external_id']}/") for r in got.collect())


def detail_page(rng, key):
    words = [f"từ{i}" for i in range(rng.randrange(5, 120))]
    lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
    numbers = [f"{rng.randrange(1, 9999)}/20{rng.randrange(10, 30)}/NĐ-CP" for _ in range(rng.randrange(12))]
    lines = [f"Căn cứ {n}," for n in numbers] + ["mã 0315/3930/3279 tk 1234/5678 x/2020/NĐ 12/1820/QĐ 5/2020/nđ"] + lines
    body = "".join(f"<div><table><tr><td>{cut(rng, line)}</td></tr></table></div>" if rng.random() < 0.3 else f"<p {attributes(rng, style='s')}>{cut(rng, line)}</p>" for line in lines)
    text = " ".join(lines)
    title, day = rng.choice(["", f"MẪU {key}"]), rng.choice([None, datetime.date(2023, 7, 9)])
    field = rng.random() < 0.4
    path = f"<p><a>Trang chủ</a> =&gt; Mẫu <b>hợp</b> đồng =&gt; <span>{escape(title)}</span></p><p>x =&gt; Biểu mẫu <span>second</span></p>"
    link = f"Căn cứ: <a {attributes(rng, href='/van-ban/T-686963.ASPX')}>{cut(rng, 'Thông tư  131/2025/TT-BTC')}</a><a href='/van-ban/b'> </a>" if field else "<a href=/tin>x</a>"
    meta = f"<div><span>Cập nhật: 01/01/2001</span></div><p><span>{f'Cập nhật: {day.day}/0{day.month}/{day.year}' if day else 'Cập nhật: 99/99/2020'}; {link}</span></p>"
    kind = rng.randrange(3)
    frame = [f"<section {attributes(rng, **{'class': 'divNoiDungBM z'})}>{body}</section><div class=divTNPL>no</div>", f"<div class='divTNPL'><div>short</div><div>{body}</div><div>{'ad ' * 99}</div></div>", "<p>nothing</p>"][kind]
    if kind == 1 and len(text) < 200:
        text = "short " + text + " " + " ".join(["ad"] * 99)
        text = " ".join(["ad"] * 99)  # the first large block
    if kind == 2:
        text = ""
    ok = len(text) >= 200
    refs = [("131/2025/TT-BTC", "Thông tư 131/2025/TT-BTC", "https://x/van-ban/T-686963.ASPX", "686963", "field")] if field else [(n, n, None, None, "body") for n in list(dict.fromkeys(numbers))[:8] if n in text]
    return f"<html><head><title>Head {key}</title></head><body>{path}{meta}{frame}", (key, title or f"Head {key}", text if ok else None, day, tuple(refs), "OK" if ok else "EMPTY_BODY")


def test_form_pages_give_what_was_written(spark):
    rng = random.Random(2)
    made = [(k, *detail_page(rng, k)) for k in range(80)]
    got = records.detail(spark.createDataFrame([(k, h) for k, h, _ in made], "page int, html string").repartition(3), "page", "html", base="https://x").collect()
    rows = {r["page"]: (r["page"], r["title"], r["body"], r["updated_on"], tuple(map(tuple, r["refs"])), r["status"]) for r in got}
    for k, _, want in made:
        assert rows[k] == want
    assert {r["status"] for r in got} == {"OK", "EMPTY_BODY"} and all((r["body_html"] is None) == (r["body"] is None) for r in got)


@pytest.mark.parametrize("body, want", [
    ("Mã số thuế: 0315459414 Điện thoại: 028/3930/3279 Số tài khoản: 1234/5678 số 91/2015/QH13", ["91/2015/QH13"]),
    (" ".join(f"{i}/2020/NĐ-CP" for i in range(1, 20)), [f"{i}/2020/NĐ-CP" for i in range(1, 9)]), ("12345/2020/NĐ 1/1850/QH 2/2020/nđ 3A/1999/QĐ 3A/1999/QĐ", ["3A/1999/QĐ"]), (None, []),
])
def test_references_of_a_body(spark, body, want):
    assert spark.createDataFrame([(body,)], "b string").select(forms.body_references(F.col("b")).alias("r")).first()["r"] == want


def test_pages_are_read_in_bounded_parts_and_keep_their_columns(spark):
    page = "<p class=a>" + "x" * 1000 + "</p>"
    parts = list(trees._parts(pa.array([page] * 600 + [None, page * 500, "<b>"])))
    assert [i for at, part in parts for i in range(at, at + len(part))] == list(range(603))
    assert all(len(part) == 1 or sum(len(p or "") for p in part) <= trees.PART for _, part in parts) and len(parts) > 4
    df = spark.createDataFrame([(i, f"<p id={i}>{i}</p>" if i % 3 else None) for i in range(300)], "k int, html string").coalesce(1)
    got = trees.planted(df, "html").select("k", "html", "_t.text", F.get("_t.nodes", F.lit(0))["attrs"]["id"].alias("id")).collect()
    assert {(r["k"], r["html"], r["text"].strip(trees.STRING + trees.BLOCK), r["id"]) for r in got} == {(i, f"<p id={i}>{i}</p>", str(i), str(i)) if i % 3 else (i, None, "", None) for i in range(300)}


def test_small_rows_that_much_is_made_of_are_spread(spark):
    assert spread(spark.range(25_000).coalesce(1), 10_000, "id").rdd.getNumPartitions() == 3
    assert spread(spark.range(0), 10_000).rdd.getNumPartitions() == 1
