"""Text, fact and document-structure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta.functions import facts, phrases, text, values
from statuta.operators import chunking, markup
from statuta.plans.tables import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql

#: Endings that stand in for the numbers of legal documents, which the tables don't have.
ENDINGS = ["QH15", "UBTVQH14", "HĐNN8", "L-CTN", "NĐ-CP", "NQ-CP", "QĐ-TTg", "TTLT-BTC", "TT-BCT", "NQ-HĐND", "QĐ-CTUBND", "QĐ-UBND", "QĐ-BCT", "CT-TTg", "VBHN-VPQH", "TW", "TB-VP", "TTr-CP", "XX"]
_NUMBER = "(o_orderkey || '/2024/' || (['" + "', '".join(ENDINGS) + "'])[o_orderkey % 19 + 1])"
_FOLDED = "upper(replace(strip_accents(replace(replace(n, 'Đ', 'D'), 'đ', 'd')), '_', '-'))"


def _number():
    return F.concat(F.col("o_orderkey").cast("string"), F.lit("/2024/"), F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("o_orderkey") % 19 + 1).cast("int")))


@R.query("SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || E' \\t x ', '\\s+', ' ', 'g'))) || '::' || lower(p_brand) AS k FROM part")
def f01_doc_key(t):
    """Collapsed identity keys."""
    return t.part.select("p_partkey", text.doc_key(F.concat(F.lit("  "), "p_name", F.lit(" \t x ")), "p_brand").alias("k"))


def _count_sql(words: list[tuple[str, float]]) -> str:
    parts = [f"{w}::DOUBLE * len(list_filter(k, lambda x: x = '{t}'))" for t, w in words]
    return f"SELECT doc_id, {' + '.join(parts)} AS points FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS k FROM documents)"


@R.query(_count_sql([("the", 1.0)]))
def f03_word_count(t):
    """whole-word counts of one term."""
    return t.documents.select("doc_id", text.term_count(F.lower("text"), "the", {}).cast("double").alias("points"))


#: Weights, phrases that hold shorter ones, and phrases that mislead.
TERMS = {"the": 3.0, "and": 2.0, "que": 1.0, "und": 1.0, "les": 0.5, "of the": 2.0}
HELD_BY, TRAPS = {"the": ("of the",)}, {"and": ("and the", "hand"), "que": ("es que",)}

#: Every separator between two bars: a word or phrase is a plain string then, and neighbours share no border.
_BARRED = r"'|' || regexp_replace(lower({}), '([^\p{{L}}\p{{N}}_])', '|\1|', 'g') || '|'"


def _hits(text: str, term: str) -> str:
    """SQL: how often a term (an expression) stands in a barred text."""
    return f"((length({text}) - length(replace({text}, '|' || replace({term}, ' ', '| |') || '|', ''))) // length('|' || replace({term}, ' ', '| |') || '|'))"


def _net(term: str) -> str:
    trapped = "".join(f" - (length(low) - length(replace(low, '{x}', ''))) // length('{x}')" for x in TRAPS.get(term, ()))
    return f"greatest(0, {_hits('d', repr(term))}{trapped})"


_POINTS = " + ".join(f"{w}::DOUBLE * greatest(0, {_net(t)}{''.join(f' - {_net(x)}' for x in HELD_BY.get(t, ()))})" for t, w in TERMS.items())


@R.query(f"SELECT doc_id, {_POINTS} AS points FROM (SELECT doc_id, lower(text) AS low, {_BARRED.format('text')} AS d FROM documents)")
def f20_weighted_terms(t):
    """Weighted sum of term counts, less what longer terms hold and what misleads, in one pass."""
    return t.documents.select("doc_id", phrases.weighted_total(F.col("text"), TERMS, HELD_BY, TRAPS).alias("points"))


@R.query(f"""
WITH b AS (SELECT 'N' || (item_id % 20) AS code, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM benchmark),
l AS (SELECT DISTINCT code, w[i] || ' ' || w[i + 1] AS term FROM b, range(1, 6) r(i) WHERE len(w) > i UNION SELECT 'S' || (i % 5), 'src' || i FROM range(20) r(i) UNION SELECT 'L' || x, x FROM (VALUES ('en'), ('fr'), ('the'), ('que')) v(x)),
d AS (SELECT doc_id, {_BARRED.format("array_to_string(string_split(text, ' ')[1:12], ' ')")} AS title, {_BARRED.format("source || ' ' || lang")} AS field, {_BARRED.format('text')} AS body FROM documents),
s AS (SELECT doc_id, code, sum(3 * {_hits('title', 'term')} + 3 * {_hits('field', 'term')} + least(1, {_hits('body', 'term')})) AS score FROM d, l GROUP BY ALL)
SELECT doc_id, code, score::INT AS score FROM s WHERE score >= 3""")
def f21_class_scores(t):
    """classes by hundreds of phrases: title three a hit, field three, body once a phrase; from three on.

    The tables have no lexicon: phrases of two words of the benchmark's texts stand for one, first words for a title.
    """
    b = t.benchmark.select(F.concat(F.lit("N"), (F.col("item_id") % 20).cast("string")).alias("code"), F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("w"))
    pair = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.get("w", i), F.lit(" "), F.get("w", i + 1)))
    spark = t.benchmark.sparkSession
    more = spark.createDataFrame([(f"S{i % 5}", f"src{i}") for i in range(20)] + [(f"L{x}", x) for x in ("en", "fr", "the", "que")], "code string, term string")
    lexicon = b.select("code", F.explode(pair).alias("term")).where("term IS NOT NULL").unionByName(more)
    title, field = F.array_join(F.slice(F.split("text", " "), 1, 12), " "), F.concat("source", F.lit(" "), "lang")
    return phrases.class_scores(t.documents, "doc_id", title, field, F.col("text"), lexicon, traps={})


@R.query("""
SELECT o_orderkey, lower(replace(strip_accents(replace(replace(n, 'Đ', 'D'), 'đ', 'd')), '-', '/')) AS key FROM (SELECT o_orderkey, """ + _NUMBER + """ AS n FROM orders)""")
def f06_fold(t):
    """one key for spellings that differ in marks, case or separators."""
    return t.orders.select("o_orderkey", text.citation_key(_number()).alias("key"))


@R.query("""
SELECT doc_id, string_agg(k, ',' ORDER BY pos) AS found FROM (SELECT doc_id, k, min(i) AS pos FROM
(SELECT doc_id, unnest(a) AS k, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text || ' x 12/2024/ND-CP, 5-TT 12/11', '\\b\\d+[/-](?:\\d{4}[/-])?[A-Z][A-Z0-9a-z\\-]*\\b') AS a FROM documents))
GROUP BY doc_id, k) GROUP BY doc_id""")
def f08_extract_keys(t):
    """Distinct numbers of a text in order; here without the rules for other papers."""
    pattern = r"\b\d+[/-](?:\d{4}[/-])?[A-Z][A-Z0-9a-z\-]*\b"
    found = F.regexp_extract_all(F.concat("text", F.lit(" x 12/2024/ND-CP, 5-TT 12/11")), F.lit(pattern), F.lit(0))
    return t.documents.select("doc_id", F.array_join(F.array_distinct(found), ",").alias("found"))


@R.query("""
SELECT o_orderkey, regexp_replace(regexp_replace(upper(strip_accents(trim(n))), '\\s*/\\s*', '/', 'g'), '\\s*-\\s*', '-', 'g') AS key FROM (SELECT o_orderkey, ' ' || replace(""" + _NUMBER + """, '/', ' / ') || ' ' AS n FROM orders)""")
def f10_normal_number(t):
    """upper case without marks; Đ stays."""
    return t.orders.select("o_orderkey", text.normal_number(F.concat(F.lit(" "), F.replace(_number(), F.lit("/"), F.lit(" / ")), F.lit(" "))).alias("key"))


@R.query("""
SELECT o_orderkey, lower(trim(regexp_replace(strip_accents(replace(replace(n, 'Đ', 'DD'), 'đ', 'dd')), '[^A-Za-z0-9]+', '-', 'g'), '-')) AS slug FROM (SELECT o_orderkey, """ + _NUMBER + """ AS n FROM orders)""")
def f11_slug(t):
    """slugs that keep Đ apart from D."""
    return t.orders.select("o_orderkey", text.slug(_number()).alias("slug"))


@R.query("""
SELECT o_orderkey, CASE WHEN s IN ('F') AND e <= TIMESTAMP '1998-01-01' THEN 'het_toan_bo' WHEN s = 'F' THEN 'con_hieu_luc' WHEN s = 'P' THEN 'het_mot_phan'
WHEN e <= TIMESTAMP '1998-01-01' THEN 'het_toan_bo' WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 'chua_hieu_luc' ELSE 'khong_ro' END AS state
FROM (SELECT o_orderkey, o_orderdate, o_orderstatus AS s, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 100 DAY END AS e FROM orders)""")
def f13_effectivity(t):
    """State as of a date, by status text, then dates, else unknown."""
    s = F.when(F.col("o_orderstatus") == "F", "  Còn  HIỆU lực ").when(F.col("o_orderstatus") == "P", "Hết hiệu lực một phần")
    ends = F.when(F.col("o_orderkey") % 3 == 0, F.date_add(F.to_date("o_orderdate"), 100))
    e = facts.effectivity(s, F.to_date("o_orderdate"), ends, F.lit("1998-01-01").cast("date"))
    return t.orders.select("o_orderkey", e["state"].alias("state"))


def _ladder(what: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(k, '{r[0]}') THEN {r[what] if isinstance(r[what], int) else repr(r[what])}" for r in facts.NUMBER_RULES) + (" ELSE 99 END" if what == 1 else " ELSE 'khong_xac_dinh' END")


@R.query(f"SELECT o_orderkey, {_ladder(1)} AS level, {_ladder(2)} AS kind, {_ladder(3)} AS scope FROM (SELECT o_orderkey, {_FOLDED} AS k FROM (SELECT o_orderkey, {_NUMBER} AS n FROM orders))")
def f14_hierarchy(t):
    """Level, kind and scope by ordered rules on the number."""
    return t.orders.select("o_orderkey", facts.hierarchy(_number()).alias("h")).select("o_orderkey", "h.level", "h.kind", "h.scope")


@R.query("""
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'ha-noi' WHEN 1 THEN 'hai-duong' WHEN 2 THEN 'ba-ria-vung-tau' END AS province_raw,
CASE s_suppkey % 4 WHEN 0 THEN 'ha-noi' WHEN 1 THEN 'hai-phong' WHEN 2 THEN 'ho-chi-minh' END AS province_now FROM supplier""")
def f16_provinces(t):
    """F16: province as written and as of now."""
    names = F.array(F.lit("UBND Thành phố Hà Nội"), F.lit("Hội đồng nhân dân tỉnh Hải Dương"), F.lit("UBND tỉnh Bà Rịa - Vũng Tàu"), F.lit("Bộ Tài chính"))
    s = t.supplier.select("s_suppkey", F.element_at(names, (F.col("s_suppkey") % 4 + 1).cast("int")).alias("agency"))
    return facts.provinces(s, "agency").select("s_suppkey", "province_raw", "province_now")


@R.query("""
SELECT p_partkey, CASE WHEN p_size = 1 THEN 11 WHEN p_size = 2 THEN 12 WHEN lower(p_brand) = 'brand#11' THEN 3 WHEN lower(p_type) LIKE '%steel%' THEN 5 WHEN lower(p_type) LIKE '%copper%' THEN 6 ELSE 27 END AS code FROM part""")
def f17_field_code(t):
    """Code table, name table, first keyword, default."""
    f = facts.field_code(F.col("p_size").cast("string"), F.col("p_brand"), F.col("p_type"), {"1": 11, "2": 12}, {"brand#11": 3}, [("steel", 5), ("copper", 6)])
    return t.part.select("p_partkey", f["code"].alias("code"))


_CLOSE = "'</(?:p|div|li|tr|h[1-6]|blockquote|section|article)>'"
_CLEAN = f"""
h AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<head[^>]*>.*?</head *>|<script.*?</script>|<style.*?</style>', '', 'gis') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(MARKED, '<br */?>', chr(10), 'gi'), {_CLOSE}, chr(10) || chr(10), 'gi') AS x FROM h),
e AS (SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS x FROM b),
c AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), E' \\n') AS x FROM e)"""
_SIGNS = "regexp_replace(regexp_replace(regexp_replace(x, '<h1[^>]*>', chr(10) || chr(10) || '# ', 'gi'), '<li[^>]*>', chr(10) || '- ', 'gi'), '<a [^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>', '[\\2](\\1)', 'gis')"


@R.query(f"WITH {_CLEAN.replace('MARKED', 'x')} SELECT page_id, length(x)::INT AS n_chars, length(x) >= 200 AS meaningful, sha256(x) AS digest FROM c")
def f18_html_text(t):
    """Pages as clean text."""
    c = t.pages.select("page_id", markup.clean_text(F.col("html")).alias("x"))
    return c.select("page_id", F.length("x").alias("n_chars"), markup.is_meaningful(F.col("x")).alias("meaningful"), F.sha2("x", 256).alias("digest"))


@R.query()
def f19_chunk(t):
    """Documents as chunks within size limits."""
    return chunking.chunks(t.documents, "doc_id", "text").select("doc_id", "chunk_index", "heading", "char_count", "kind")


@R.query("""
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag || ' & ' || l_linestatus AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) AS r FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P')
SELECT DISTINCT k AS o_orderkey, 0 AS "table", 0 AS row, 2 AS n_cells, '| Order ' || k || ' |  |' AS line FROM l UNION ALL SELECT k, 0, r, 2, '| ' || n || ' | ' || s || ' |' FROM l""")
def f26_grid(t):
    """tables of landed pages as grids; a page for each order, its heading over two columns."""
    flags = F.concat(F.lit("<TD> "), "l_returnflag", F.lit(" &amp;\n"), "l_linestatus", F.lit("</td></tr>"))
    line = F.concat(F.lit("<tr><td>"), F.col("l_linenumber").cast("string"), F.lit("</td>"), flags)
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", line.alias("x")))), lambda s: s["x"]), "").alias("x"))
    o = t.orders.where("o_orderstatus = 'P'").select("o_orderkey").join(rows, F.col("o_orderkey") == F.col("l_orderkey"))
    page = F.concat(F.lit("<p>x</p><table><tr><th colspan='2'>Order "), F.col("o_orderkey").cast("string"), F.lit("</th></tr>"), "x", F.lit("</table>"))
    return markup.table_rows(o.select("o_orderkey", page.alias("html")), "o_orderkey", "html").select("o_orderkey", "table", "row", F.size("cells").alias("n_cells"), "line")


@R.query(f"WITH {_CLEAN.replace('MARKED', _SIGNS)} SELECT page_id, sha256(x) AS markdown FROM c")
def f25_markdown(t):
    """Pages as markdown: headings, list items, links; blocks break, inline tags join tightly."""
    return t.pages.select("page_id", F.sha2(markup.markdown_text(F.col("html")), 256).alias("markdown"))


@R.query(r"""
WITH b AS (SELECT doc_id, i, trim(b) AS b FROM (SELECT doc_id, unnest(p) AS b, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split('# ' || source || chr(10) || chr(10) || '- a' || chr(10) || '- **b** & c' || chr(10) || chr(10) || replace(text, chr(10), ' '), chr(10) || chr(10)) AS p FROM documents))),
h AS (SELECT doc_id, i, replace(replace(replace(replace(replace(b, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS x FROM b WHERE b <> ''),
m AS (SELECT doc_id, i, regexp_replace(regexp_replace(x, '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g'), '\*(.+?)\*', '<em>\1</em>', 'g') AS x FROM h)
SELECT doc_id, sha256(string_agg(CASE i WHEN 1 THEN '<h1>' || substr(x, 3) || '</h1>' WHEN 2 THEN '<ul><li>a</li><li><strong>b</strong> &amp; c</li></ul>' ELSE CASE WHEN regexp_matches(x, '^#{1,6}\s+[^\n]*$') THEN 'heading' WHEN x LIKE '- %' THEN '<ul><li>' || substr(x, 3) || '</li></ul>' ELSE '<p>' || x || '</p>' END END, '' ORDER BY i)) AS html FROM m GROUP BY doc_id""")
def f27_safe_html(t):
    """Markdown as HTML in which everything is escaped before any tag is made."""
    md = F.concat(F.lit("# "), "source", F.lit("\n\n- a\n- **b** & c\n\n"), F.replace("text", F.lit("\n"), F.lit(" ")))
    return t.documents.select("doc_id", F.sha2(markup.safe_html(md), 256).alias("html"))


@R.query("SELECT doc_id, sha256(text || chr(31) || lang || chr(31) || source) AS digest FROM documents")
def f29_fingerprint(t):
    """one digest of several fields."""
    return t.documents.select("doc_id", F.sha2(F.concat_ws("\x1f", "text", "lang", "source"), 256).alias("digest"))


@R.query("SELECT doc_id, CASE WHEN length(text) > 80 THEN rtrim(substr(text, 1, 79)) || '…' ELSE text END AS short FROM documents")
def f32_shorten(t):
    """F32: ends marked where a text is cut."""
    return t.documents.select("doc_id", text.shorten("text", 80).alias("short"))


@R.query("""
SELECT page_id, regexp_extract(url, '([^/]+)/?$', 1) AS tail, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""")
def f34_url_parts(t):
    """parts of addresses; whole pages of escaped markup."""
    return t.pages.select("page_id", F.regexp_extract("url", r"([^/]+)/?$", 1).alias("tail"), text.escape_html("html").alias("escaped"))


@R.query("""
SELECT o_orderkey, o_orderdate::DATE AS d, greatest(0, date_diff('day', o_orderdate::DATE, DATE '1998-01-01'))::INT AS days,
year(o_orderdate) || '-Q' || quarter(o_orderdate) AS q, greatest(o_orderdate::DATE - 45, DATE '1996-01-01') AS cutoff FROM orders""")
def f50_dates(t):
    """dates of several formats, ages, quarters, cutoffs."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    s = F.when(k % 3 == 0, F.date_format(d, "dd/MM/yyyy")).when(k % 3 == 1, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
    x = values.any_date(s)
    o = t.orders.select("o_orderkey", x.alias("d"))
    floor = F.lit("1996-01-01").cast("date")
    return o.select("o_orderkey", "d", values.days_since(F.col("d"), F.lit("1998-01-01").cast("date")).alias("days"), values.quarter_label(F.col("d")).alias("q"), values.scan_cutoff(F.col("d"), 45, floor).alias("cutoff"))


@R.query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'khac' WHEN event_type = 'click' THEN 'click' ELSE event_type || ',click' END AS tags FROM
(SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'error') THEN event_type ELSE 'click' END AS event_type FROM events)""")
def f60_closed_set(t):
    """a JSON array, malformed ones empty, reduced to a closed set."""
    j = F.when(F.col("event_id") % 4 == 0, "[broken").otherwise(F.concat(F.lit('[" '), F.upper("event_type"), F.lit('", "click"]')))
    c = values.closed_set(values.json_array(j), ["click", "view", "error"], "khac")
    return t.events.select("event_id", F.array_join(c, ",").alias("tags"))


@R.query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN (props->>'k')::INT END AS k FROM events")
def f62_embedded_json(t):
    """an object inside other text."""
    noisy = F.when(F.col("event_id") % 5 == 0, F.lit("no object")).otherwise(F.concat(F.lit("```json "), "props", F.lit(" ```")))
    return t.events.select("event_id", F.from_json(values.embedded_json(noisy), "k int")["k"].alias("k"))


@R.query("""
SELECT doc_id, text.overlap FROM (SELECT doc_id, {'overlap': round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) ELSE 0 END, 6)} AS text
FROM (SELECT d.doc_id, list_distinct(list_filter(regexp_extract_all(lower(d.text), '[\\p{L}\\p{N}\\p{M}_]+'), lambda x: length(x) > 2)) AS a, list_distinct(list_filter(regexp_extract_all(lower(b.text), '[\\p{L}\\p{N}\\p{M}_]+'), lambda x: length(x) > 2)) AS b
FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40))""")
def f30_overlap(t):
    """shared words of two texts as a share of the smaller set."""
    j = t.documents.join(t.benchmark.select("item_id", F.col("text").alias("b")), F.col("item_id") == F.col("doc_id") % 40)
    return j.select("doc_id", F.round(text.token_overlap("text", "b"), 6).alias("overlap"))
