"""Records around reports and forms: parsed pages, gates, job outcomes, run logs, context, folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import fold, shorten
from statuta.operators import kept, trees
from statuta.operators.forms import body_references
from statuta.session import written

#: Kinds of documents that stand before a number.
KINDS = (
    "Bộ luật", "Luật", "Pháp lệnh", "Hiến pháp", "Nghị quyết", "Nghị quyết liên tịch", "Nghị định", "Quyết định", "Chỉ thị", "Thông tư",
    "Thông tư liên tịch", "Công văn", "Thông báo", "Kế hoạch", "Hướng dẫn", "Lệnh", "Sắc lệnh",
)


def kept_in_order(df: DataFrame, key: str, items: str, allowed: DataFrame, name: str) -> DataFrame:
    """(key, items): of each list the items that are in `allowed` (column name), in the list's order."""
    e = df.select(key, F.posexplode(items).alias("_pos", name)).join(allowed.select(name).distinct(), name, "left_semi")
    lists = e.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", name))).alias("_l"))
    return lists.select(key, F.transform("_l", lambda s: s[name]).alias(items))


def latest_runs(log: DataFrame, run: str, at: str, metrics: list[str]) -> DataFrame:
    """One row a run of an append-only log (run, at, status, metrics as a map): start, end, last status and the known metrics.

    A run without an end is RUNNING; metrics of other names are ignored.
    """
    last = F.max_by("status", at)
    g = log.groupBy(run).agg(F.min(at).alias("started_at"), F.max(F.when(F.col("status") != "RUNNING", F.col(at))).alias("finished_at"), last.alias("status"), F.max_by("metrics", F.struct(F.col("metrics").isNotNull(), F.col(at))).alias("_m"))
    return g.select(run, "started_at", "finished_at", "status", *[F.try_element_at("_m", F.lit(m)).alias(m) for m in metrics])


def whitelist(setting: Column, default: list[int]) -> Column:
    """Codes of a setting separated by `;` or `,`; the default if it is empty or holds anything but numbers."""
    parts = F.filter(F.transform(F.split(F.coalesce(setting, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    good = (F.size(parts) > 0) & F.forall(parts, lambda x: x.rlike(r"^[+-]?\d+$"))
    return F.when(good, F.array_sort(F.array_distinct(F.transform(parts, lambda x: x.try_cast("int"))))).otherwise(F.array(*[F.lit(x) for x in sorted(default)]))


def replaced_by_source(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """Edges after a rebuild: those of every source in `new` are its new ones, the others stay."""
    return old.join(new.select(source).distinct(), source, "left_anti").unionByName(new.distinct())


#: States of a report job.
DONE, FAILED, BLOCKED = "DONE", "FAILED", "BLOCKED_CITATION"


def _unknown(cited: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of cited (number and more) whose number isn't known, however often a number is cited.

    Up to FEW known numbers go to every task. Of more, a number of over FEW rows is at most one in FEW rows, so those go, and
    only the rows of other numbers are dealt by number.
    """
    known = known.select("number")
    if known.count() <= kept.FEW:
        return cited.join(F.broadcast(known), "number", "left_anti")
    cited = written(cited, "cited")
    hot = written(cited.groupBy("number").agg(F.count("*").alias("_n")).where(F.col("_n") > kept.FEW).select("number"), "cited-often")
    lost = hot.join(known, "number", "left_anti")
    return cited.join(F.broadcast(lost), "number", "left_semi").unionByName(cited.join(F.broadcast(hot), "number", "left_anti").join(known, "number", "left_anti"))


def outcomes(jobs: DataFrame, outputs: DataFrame, known: DataFrame) -> DataFrame:
    """(job, status, citation_total, citation_missing, error) of jobs that ran.

    jobs: job, kind, parent; outputs: job, error, cited, allowed (numbers, arrays); known: number.
    A job without output or with an error fails, and so does one of kind c whose parent has no
    output. A cited number that is neither known nor allowed blocks the job.
    """
    o = outputs.select(F.col("job").alias("_job"), "error", F.array_distinct("cited").alias("cited"), "allowed")
    parents = outputs.where("error IS NULL").select(F.col("job").alias("_p"))
    # Only jobs that need a parent look for it, by two numbers: rows of no parent would all meet in one task.
    asking = jobs.where("kind = 'c' AND parent IS NOT NULL").select(F.col("job").alias("_fed"), "parent")
    fed = asking.join(parents, F.col("parent") == F.col("_p"), "left_semi").select("_fed").distinct()
    j = jobs.join(o, F.col("job") == F.col("_job"), "left").join(fed, F.col("job") == F.col("_fed"), "left")
    lone = (F.col("kind") == "c") & F.col("_fed").isNull()
    j = j.withColumn("error", F.when(lone, "parent has no output").when(F.col("_job").isNull(), F.coalesce("error", F.lit("no output"))).otherwise(F.col("error")))
    cited = j.where("error IS NULL").select("job", F.explode(F.array_except("cited", F.coalesce("allowed", F.array().cast("array<string>")))).alias("number"))
    missing = _unknown(cited, known).groupBy(F.col("job").alias("_m")).agg(F.count("*").alias("_missing"))
    j = j.join(missing, F.col("job") == F.col("_m"), "left").withColumn("_missing", F.coalesce("_missing", F.lit(0)))
    status = F.when(F.col("error").isNotNull(), FAILED).when(F.col("_missing") > 0, BLOCKED).otherwise(DONE)
    ran = F.col("error").isNull()
    return j.select("job", "kind", status.alias("status"), F.when(ran, F.size("cited")).cast("long").alias("citation_total"), F.when(ran, F.col("_missing")).cast("long").alias("citation_missing"), "error")


def chained(done: DataFrame, affected: DataFrame, queued: DataFrame) -> DataFrame:
    """(key, code, parent, reason, priority): a job of kind c for each industry that a finished job of kind b affects,
    if none of that key is queued; affected: job, code, intensity."""
    b = done.where(f"kind = 'b' AND status = '{DONE}'").select("job").join(affected, "job")
    key = F.concat("code", F.lit("-"), F.col("job").cast("string"))
    reason = F.format_string("bao_cao_b_%d_cuong_do_%.0f", F.col("job"), F.col("intensity"))
    rows = b.select(key.alias("key"), "code", F.col("job").alias("parent"), reason.alias("reason"), F.col("intensity").alias("priority"))
    return rows.dropDuplicates(["key"]).join(queued.select("key"), "key", "left_anti")


_PATH = r"^/(bieumau|hopdong)/(\d+)/([^/?#]*)"
_DAY = r"(\d{1,2}/\d{1,2}/\d{4})"


def _day(text: Column) -> Column:
    """The first day/month/year of a text; null if there is none or it is no date."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(text, _DAY, 1), F.lit("")), F.lit("d/M/yyyy")).cast("date")


def listing(pages: DataFrame, key: str, html: str, base: str = "") -> DataFrame:
    """(key, form_key, source, external_id, slug, title, url, keywords, updated_on, pos, total, has_next, error): items of
    listing pages, the first of each form of a page.

    An item is a link right inside a title paragraph; its keywords and its date stand in the row around it. total is the
    count that the page states, if any. A page that can't be read is one row with an error and no item; a page
    without items gives no row.
    """
    p = trees.planted(pages.select(F.col(key), F.col(html).alias("_html")), "_html").drop("_html")
    text = F.col("_t.text")

    def item(a: Column, divs: Column, words: Column) -> Column:
        around = F.filter(divs, lambda d: trees.within(a, d))
        striped = F.filter(around, lambda d: F.exists(d["classes"], lambda c: c.rlike(r"^content-\d+$")))
        path = lambda i: F.regexp_extract(a["attrs"]["href"], _PATH, i)

        def row(block: Column) -> Column:
            said = F.transform(F.filter(words, lambda k: trees.within(k, block)), lambda k: trees.text_of(text, k))
            right = trees.first(F.filter(divs, lambda d: trees.within(d, block) & F.array_contains(d["classes"], "right-col")))
            return F.struct(
                F.concat(path(1), F.lit("-"), path(2)).alias("form_key"), path(1).alias("source"), path(2).alias("external_id"), path(3).alias("slug"), trees.text_of(text, a).alias("title"),
                F.concat(F.lit(base), a["attrs"]["href"]).alias("url"), F.filter(said, lambda k: k != "").alias("keywords"), _day(trees.text_of(text, right)).alias("updated_on"), block.isNotNull().alias("_held"),
            )

        return trees.bound(F.coalesce(trees.nearest(striped), trees.nearest(around)), row)

    def items(nodes: Column) -> Column:
        titled = lambda n: trees.select(F.array(trees.parent(nodes, n)), "p", "nqTitle")
        links = trees.select(nodes, "a", where=lambda n: (F.size(titled(n)) > 0) & n["attrs"]["href"].rlike(_PATH))
        bots = trees.select(nodes, "p", "links-bot")
        inner = trees.bound(bots, lambda b: trees.select(nodes, "a", where=lambda n: F.exists(b, lambda p: trees.within(n, p))))
        return trees.bound(trees.select(nodes, "div"), lambda divs: trees.bound(inner, lambda words: F.transform(links, lambda a: item(a, divs, words))))

    said = F.regexp_extract(trees.joined(text, " "), r"(?iU)Tìm thấy\s*([\d.,]+)\s*(?:biểu\s*)?mẫu", 1)
    more = F.exists(trees.select(F.col("_t.nodes"), "a"), lambda a: F.lower(trees.text_of(text, a)).contains("trang sau"))
    p = p.select(key, items(F.col("_t.nodes")).alias("_items"), F.regexp_replace(said, "[.,]", "").try_cast("int").alias("total"), more.alias("has_next"), F.col("_t.error").alias("error"))
    kept = F.when(F.col("error").isNotNull(), F.array(F.lit(None).cast(p.schema["_items"].dataType.elementType))).otherwise(F.filter("_items", lambda i: i["_held"]))
    e = p.select(key, F.posexplode(kept).alias("pos", "_i"), "total", "has_next", "error")
    rows = e.select(key, "_i.*", "pos", "total", "has_next", "error").drop("_held")
    return rows.groupBy(key, "form_key").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in (key, "form_key")]), "pos").alias("_r")).select(key, "form_key", "_r.*")


def detail(pages: DataFrame, key: str, html: str, base: str = "", kinds: tuple[str, ...] = KINDS, least: int = 200) -> DataFrame:
    """(key, title, body_html, body, updated_on, refs, status) of form pages.

    The title stands in the path line, else in the page's title; the day and the references in the span under it; the
    body in its own element, else in the first large one of the frame around it. refs: doc_num (without the kind before it),
    label, url, document_id and source (`field` or `body`): where the page names none, those of the head of the
    body count. A body that is too short is no error of the job but a status, EMPTY_BODY; a page that can't be read
    has the status UNREADABLE.
    """
    p = trees.planted(pages.select(F.col(key), F.col(html).alias("_html")), "_html")
    text, nodes = F.col("_t.text"), F.col("_t.nodes")
    plain = lambda n: trees.joined(trees.raw_text(text, n))
    spans = trees.select(nodes, "span", where=lambda n: (trees.parent(nodes, n)["tag"] == "p") & plain(n).contains("Cập nhật:"))

    def path_line(n: Column) -> Column:
        return trees.bound(plain(n), lambda t: t.contains("=>") & (t.contains("Biểu mẫu") | t.contains("Mẫu hợp đồng")))

    said = trees.bound(trees.first(trees.select(nodes, "p", where=path_line)), lambda line: trees.text_of(text, trees.first(trees.select(nodes, "span", where=lambda n: trees.within(n, line)))))
    head = trees.text_of(text, trees.first(trees.select(nodes, "title")))

    def frame(outer: Column) -> Column:
        large = trees.select(nodes, "div", where=lambda n: (n["parent"] == outer["at"]) & (F.length(trees.text_of(text, n)) >= least))
        return F.coalesce(trees.first(large), outer)

    body = F.coalesce(trees.first(trees.select(nodes, cls="divNoiDungBM")), trees.bound(trees.first(trees.select(nodes, "div", "divTNPL")), frame))

    def field(span: Column) -> Column:
        links = trees.select(nodes, "a", where=lambda n: trees.within(n, span) & n["attrs"]["href"].contains("/van-ban/"))

        def ref(a: Column) -> Column:
            href, label = a["attrs"]["href"], trees.text_of(text, a)
            url = F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))
            document = F.nullif(F.regexp_extract(href, r"(?i)-(\d+)\.aspx", 1), F.lit(""))
            return F.struct(without_kind(label, kinds).alias("doc_num"), label.alias("label"), url.alias("url"), document.alias("document_id"), F.lit("field").alias("source"))

        return F.filter(F.transform(links, ref), lambda r: r["label"] != "")

    p = p.select(key, "_html", "_t", F.coalesce(F.nullif(said, F.lit("")), head, F.lit("")).alias("title"), trees.first(spans).alias("_span"), body.alias("_body"))
    content = F.coalesce(trees.squeezed(trees.joined(trees.raw_text(text, F.col("_body")), "", "\n")), F.lit(""))
    day = _day(F.regexp_extract(plain(F.col("_span")), rf"(?U)Cập\s*nhật:\s*{_DAY}", 1))
    p = p.select(key, "title", trees.inner_html(F.col("_html"), F.col("_body")).alias("body_html"), content.alias("body"), day.alias("updated_on"),
                 F.coalesce(field(F.col("_span")), F.array()).alias("_field"), F.col("_t.error").alias("_error"))
    none = F.lit(None).cast("string")
    told = F.transform(body_references(F.col("body")), lambda x: F.struct(x.alias("doc_num"), x.alias("label"), none.alias("url"), none.alias("document_id"), F.lit("body").alias("source")))
    short = F.length("body") < least
    status = F.when(F.col("_error").isNotNull(), "UNREADABLE").when(short, "EMPTY_BODY").otherwise("OK")
    kept = lambda c: F.when(~short, F.col(c)).alias(c)
    return p.select(key, "title", kept("body_html"), kept("body"), "updated_on", F.when(F.size("_field") > 0, F.col("_field")).otherwise(told).alias("refs"), status.alias("status"))


def field_references(field: Column) -> Column:
    """Array of (id, label) of the links to documents in a piece of markup; other links are none."""
    number = r"(?i)/van-ban/.*-(\d+)\.aspx"

    def read(t: Column) -> Column:
        links = trees.select(t["nodes"], "a", where=lambda n: n["attrs"]["href"].rlike(number))
        return F.transform(links, lambda n: F.struct(F.regexp_extract(n["attrs"]["href"], number, 1).alias("id"), trees.text_of(t["text"], n).alias("label")))

    return trees.bound(trees.tree(field), read)


def without_kind(label: Column, kinds: list[str]) -> Column:
    """A reference's label without the kind of document before it, if a number (with a slash) is left."""
    whole = F.trim(F.regexp_replace(label, r"(?U)\s+", " "))
    names = "|".join(sorted(kinds, key=lambda k: (-len(k), k)))
    rest = F.trim(F.regexp_replace(whole, rf"(?iU)^(?:{names})\s+(?:số\s+)?", ""))
    return F.when(rest.contains("/"), rest).otherwise(whole)


#: Signs of a title that was taken from a form's body (words only; with punctuation), limits in characters.
BODY_SIGNS = (
    ("quốc hiệu", r"\bcong hoa (xa hoi )?(chu nghia )?viet nam\b"), ("tiêu ngữ", r"\bdoc lap tu do\b"), ("mẫu số", r"\bmau so\b"),
    ("phụ lục", r"\bphu luc\b"), ("biểu mẫu số", r"\bbieu mau so\b"), ("tên cơ quan/đơn vị", r"\bten co quan\b"),
)
MARKED_SIGNS = (("đơn vị:", r"\bdon vi\s*:"), ("tên cơ quan/đơn vị:", r"\bten co quan\s*[/:]"))


def title_fault(title: Column, least: int, most: int) -> Column:
    """Why a title is refused; null if it is not."""
    whole = F.trim(F.coalesce(title, F.lit("")))
    low = F.lower(fold(whole))
    words = F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))
    tests = [(F.length(whole) < least, "too short"), (F.length(whole) > most, "too long")]
    tests += [(words.rlike(p), name) for name, p in BODY_SIGNS] + [(low.rlike(p), name) for name, p in MARKED_SIGNS]
    return F.coalesce(*[F.when(c, F.lit(r)) for c, r in tests])


def article_fault(title: Column, description: Column, body: Column, cited_ok: Column, limits: tuple[int, int, int, int]) -> Column:
    """Why an article is refused: the first of title, description, body and citations that fails; null if none does."""
    least, most, about, whole = limits
    tests = [
        (F.length(F.trim(F.coalesce(description, F.lit("")))) > about, "description too long"), (F.trim(F.coalesce(body, F.lit(""))) == "", "no body"),
        (F.length(body) > whole, "body too long"), (~F.coalesce(cited_ok, F.lit(False)), "citations"),
    ]
    return F.coalesce(title_fault(title, least, most), *[F.when(c, F.lit(r)) for c, r in tests])


def month_folder(*days: Column) -> Column:
    """year/month of the first date that is there, else the folder of what can't be placed."""
    day = F.coalesce(*days)
    return F.coalesce(F.date_format(day, "yyyy/'Thang_'MM"), F.lit("Chua_Phan_Loai/Chua_Phan_Loai"))


def numbered_folder(code: Column, names: dict[int, str], other: int) -> Column:
    """`NN. name` of a code; unknown codes go to `other`."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    mine = F.when(F.try_element_at(known, code).isNotNull(), code).otherwise(F.lit(other))
    return F.format_string("%02d. %s", mine, F.try_element_at(known, mine))


def profile_sentences(industries: DataFrame, code: str, names: list[str], keywords: str) -> DataFrame:
    """(code, pos, sentence): the names, then one sentence a keyword."""
    said = F.transform(keywords, lambda k: F.concat(F.lit("Quy định pháp luật về "), k, F.lit(".")))
    return industries.select(code, F.posexplode(F.concat(F.array(*names), said)).alias("pos", "sentence"))


def section(text: Column, head: str) -> Column:
    """What stands under `## head` up to the next `## `, trimmed; null without such a head."""
    found = F.regexp_extract(F.concat(F.lit("\n"), text, F.lit("\n## ")), rf"(?s)\n## {head}[ \t]*\n(.*?)(?=\n## )", 1)
    return F.nullif(F.trim(F.regexp_replace(found, r"^\s+|\s+$", "")), F.lit(""))


def context(body: Column, sources: Column, cap: int, each: int, number: str) -> Column:
    """Struct (text, allowed): a capped body and capped sources, and the numbers that can be read in them.

    Texts are cut before their numbers are taken: a number behind the cut was never read.
    """
    cut = F.transform(sources, lambda s: shorten(s, each))
    text = F.array_join(F.concat(F.array(shorten(body, cap)), cut), "\n\n")
    return F.struct(text.alias("text"), F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(number), F.lit(0)))).alias("allowed"))


def evolved(*snapshots: DataFrame) -> DataFrame:
    """Snapshots of growing schemas as one table: a column that a snapshot lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), snapshots)
