"""Text functions as Column expressions: identity keys, folding, slugs, citations, term counts."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x: Column | str) -> Column:
    """Blanks collapsed and trimmed, lower case (all of Unicode)."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)\s+", " ")))


def doc_key(number: Column | str, agency: Column | str) -> Column:
    """Identity of a document: its number and agency, both collapsed."""
    return F.concat(collapse(number), F.lit("::"), collapse(agency))


def _marked_letters(compose: str) -> tuple[str, str]:
    """Latin letters with marks and their bases under a normal form that splits them."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = [p for p in unicodedata.normalize(compose, chr(code)) if not unicodedata.combining(p)]
        if len(parts) == 1 and parts[0] != chr(code):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_marks(x: Column | str) -> Column:
    """Drop combining marks of Latin letters; a stroke (Đ) is no mark and stays."""
    marked, bare = _marked_letters("NFKD")
    return F.regexp_replace(F.translate(_c(x), marked, bare), r"\p{Mn}", "")


def fold(x: Column | str) -> Column:
    """strip_marks with Đ and đ as D and d."""
    return strip_marks(F.translate(_c(x), "Đđ", "Dd"))


def citation_key(x: Column | str) -> Column:
    """One key for spellings of a number that differ in marks, case or separators."""
    return F.replace(F.lower(fold(x)), F.lit("-"), F.lit("/"))


def normal_number(x: Column | str) -> Column:
    """Upper-case number without marks (Đ stays) and without blanks around separators."""
    s = F.upper(strip_marks(F.trim(F.coalesce(_c(x), F.lit("")))))
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(s, r"\s*/\s*", "/"), r"\s*-\s*", "-")


def slug(x: Column | str) -> Column:
    """Lower-case ASCII words joined by hyphens; Đ turns into DD so that it stays apart from D."""
    s = F.replace(F.replace(F.trim(F.coalesce(_c(x), F.lit(""))), F.lit("Đ"), F.lit("DD")), F.lit("đ"), F.lit("dd"))
    return F.lower(F.regexp_replace(F.regexp_replace(strip_marks(s), r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", ""))


#: Endings of local numbers, slugs that say nothing, and the shape that slugs keep apart.
LOCAL_ENDING, EMPTY_SLUGS, EXACT_SHAPE = r"(?iu)-(UBND|HĐND|HDND)\s*$", ("", "khong-so", "khong-xac-dinh"), r"^\d+/\d{4}/[A-Za-z0-9]+(-[A-Za-z0-9]+)*$"


def public_slug(number: Column | str, key: Column | str) -> Column:
    """A slug that stays the same for the same document; four digest digits keep doubtful ones apart."""
    base, trimmed = slug(number), F.trim(F.coalesce(_c(number), F.lit("")))
    plain = strip_marks(F.replace(F.replace(trimmed, F.lit("Đ"), F.lit("DD")), F.lit("đ"), F.lit("dd")))
    doubtful = trimmed.rlike(LOCAL_ENDING) | base.isin(*EMPTY_SLUGS) | ~plain.rlike(EXACT_SHAPE)
    tail = F.substring(F.sha2(F.coalesce(F.nullif(_c(key), F.lit("")), _c(number)), 256), 1, 4)
    return F.when(doubtful, F.concat(F.when(base == "", "khong-so").otherwise(base), F.lit("--"), tail)).otherwise(base)


#: Shapes of document numbers and prefixes of papers that are no legal documents.
CITATION = r"\b\d+[/-](?:\d{4}[/-])?[A-ZĐ][A-ZĐ0-9a-z\-]*\b"
TITLE_NUMBER = r"\b(\d+[A-Za-zĐđ]{0,3}/(?:\d{4}/)?[A-Za-zĐđÀ-ỹ][A-Za-zĐđÀ-ỹ0-9]*(?:[-–][A-Za-zĐđÀ-ỹ0-9.]+)*|\d+-[A-Za-zĐđÀ-ỹ][A-Za-zĐđÀ-ỹ0-9]*/[A-Za-zĐđÀ-ỹ][A-Za-zĐđÀ-ỹ0-9.\-]*)"
PAPER_PREFIXES = ("HD", "PLHD", "BB", "GXN", "GUQ", "DN", "TTR")


def citations(x: Column | str, pattern: str = "(?U)" + CITATION) -> Column:
    """Distinct document numbers of a text, in the order in which they appear."""
    found = F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(pattern), F.lit(0))
    found = F.transform(found, lambda t: F.regexp_replace(t, r"[.,;:]+$", ""))

    def keep(t: Column) -> Column:
        letters = F.upper(fold(F.regexp_extract(t, r"^\d+[/-](?:\d{4}[/-])?([A-Za-zĐđ]+)", 1)))
        paper = letters.rlike("^(" + "|".join(PAPER_PREFIXES) + ")")
        return ~t.rlike(r"^\d+[/-]\d{1,2}$") & ~paper

    return F.array_distinct(F.filter(found, keep))


def title_number(x: Column | str) -> Column:
    """The first document number of a title, or an empty string. Running numbers have any count of digits: where
    seven were none, a later reference in the title passed for its number."""
    return F.regexp_extract(F.coalesce(_c(x), F.lit("")), "(?U)" + TITLE_NUMBER, 1)


#: Keywords that also occur inside phrases of another meaning.
TRAPS = {
    "điện": ("bưu điện", "điện tử", "điện thoại", "công điện", "điện báo", "điện văn"),
    "nước": ("nhà nước", "trong nước", "nước ngoài", "ngoài nước", "cả nước", "toàn nước"),
    "mạng": ("mạng lưới", "tính mạng"),
    "khí": ("không khí", "khí hậu", "khí tượng"),
    "dữ liệu": ("dữ liệu báo cáo", "dữ liệu thống kê"),
    "phải": ("bên phải", "phía phải", "tay phải", "lẽ phải", "phải chăng", "trái phải", "cánh phải"),
}
#: Obligation terms with weights, and longer terms that hold shorter ones.
RESTRICTIONS = {
    "nghiêm cấm": 3.0, "cấm": 3.0, "không được phép": 2.0, "không được": 2.0, "chỉ được": 2.0, "bắt buộc": 2.0, "buộc phải": 2.0,
    "phải": 1.0, "có trách nhiệm": 1.0, "có nghĩa vụ": 1.0, "chậm nhất": 0.5, "không quá": 0.5, "tối thiểu": 0.5,
}
HELD_BY = {"không được": ("không được phép",), "cấm": ("nghiêm cấm",)}


def term_count(x: Column | str, term: str, traps: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Whole-word occurrences of a term in lower-case text, less the phrases that mislead; 0 at least."""
    x = F.coalesce(_c(x), F.lit(""))
    hits = F.regexp_count(x, F.lit(rf"(?U)(?<!\w){re.escape(term)}(?!\w)"))
    for trap in (TRAPS if traps is None else traps).get(term, ()):
        hits = hits - ((F.length(x) - F.length(F.replace(x, F.lit(trap), F.lit("")))) / len(trap)).cast("int")
    return F.greatest(F.lit(0), hits)


def token_overlap(a: Column | str, b: Column | str, longer_than: int = 2) -> Column:
    """Shared tokens as a share of the smaller token set."""

    def tokens(x: Column) -> Column:
        parts = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
        return F.array_distinct(F.filter(parts, lambda t: F.length(t) > longer_than))

    ta, tb = tokens(_c(a)), tokens(_c(b))
    least = F.least(F.size(ta), F.size(tb))
    return F.when(least > 0, F.size(F.array_intersect(ta, tb)) / least).otherwise(0.0)


def shorten(x: Column | str, length: int, mark: str = "…") -> Column:
    x = _c(x)
    return F.when(F.length(x) > length, F.concat(F.rtrim(F.substring(x, 1, length - 1)), F.lit(mark))).otherwise(x)


def nearest_before(x: Column | str, anchor: Column, verbs: list[str], reach: int = 140) -> Column:
    """Of the verbs in the `reach` characters before the anchor the one that ends last."""
    x = _c(x)
    at = F.locate("\x00", F.concat(F.lit(""), x)) if anchor is None else F.instr(x, anchor)
    before = F.lower(F.substring(x, F.greatest(F.lit(1), at - reach), F.least(F.lit(reach), at - 1)))
    places = F.array(*[F.struct((F.length(before) - F.locate(v[::-1], F.reverse(before)) - len(v) + 2).alias("p"), F.lit(v).alias("v"), F.contains(before, F.lit(v)).alias("ok")) for v in verbs])
    best = F.array_max(F.filter(places, lambda s: s["ok"]))
    return F.when(at > 0, best["v"])


def content_hash(pairs: Column | str) -> Column:
    """Digest of a list of (heading, content) structs; borders can't be mistaken for text."""
    parts = F.transform(_c(pairs), lambda p: F.concat(p["heading"], F.lit("\x00"), p["content"], F.lit("\x01")))
    return F.sha2(F.array_join(parts, ""), 256)


def escape_html(x: Column | str) -> Column:
    out = _c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
