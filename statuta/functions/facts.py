"""Rule-derived facts of legal documents: hierarchy, territory, effectivity, field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import fold

NO_NORM = 99
#: Fixed values: (pattern, level, kind, scope, agency, normative), the first that matches wins.
NUMBER_RULES = [
    (r"/QH\d*$", 2, "luat", "trung_uong", "Quốc hội", True),
    (r"/(PL-)?UBTVQH\d*$", 3, "phap_lenh", "trung_uong", "Ủy ban Thường vụ Quốc hội", True),
    (r"/HDNN\d*$", 3, "phap_lenh", "trung_uong", "Hội đồng Nhà nước", True),
    (r"/(L|QD)-CTN$", 4, "lenh_ctn", "trung_uong", "Chủ tịch nước", True),
    (r"/ND-CP$", 5, "nghi_dinh", "trung_uong", "Chính phủ", True),
    (r"/NQ-CP$", 5, "nghi_quyet_cp", "trung_uong", "Chính phủ", True),
    (r"/QD-TTG$", 6, "quyet_dinh_ttg", "trung_uong", "Thủ tướng Chính phủ", True),
    (r"/TTLT-", 7, "thong_tu_lien_tich", "trung_uong", None, True),
    (r"/TT-", 7, "thong_tu", "trung_uong", None, True),
    (r"NQ-HDND$", 8, "nghi_quyet_hdnd", "tinh", None, True),
    (r"/QD-CTUBND$", NO_NORM, "quyet_dinh_ca_biet", "tinh", None, False),
    (r"/QD-UBND", 9, "quyet_dinh_ubnd", "tinh", None, True),
    (r"/QD-", NO_NORM, "quyet_dinh_ca_biet", "khong_xac_dinh", None, False),
    (r"/CT-", NO_NORM, "chi_thi", "khong_xac_dinh", None, False),
    (r"/VBHN-", NO_NORM, "van_ban_hop_nhat", "trung_uong", None, False),
    (r"/(TW|VPTW)$", NO_NORM, "van_ban_dang", "trung_uong", None, False),
    # TTr can never match an upper-cased number; that is so on purpose.
    (r"/(TB|CD|KH|CV|TTr|BC)-", NO_NORM, "hanh_chinh", "khong_xac_dinh", None, False),
]
#: The same facts by the document's type, where the number says nothing.
TYPE_RULES = {
    "hiến pháp": (1, "hien_phap", "trung_uong", "Quốc hội", True),
    "bộ luật": (2, "luat", "trung_uong", "Quốc hội", True),
    "luật": (2, "luat", "trung_uong", "Quốc hội", True),
    "pháp lệnh": (3, "phap_lenh", "trung_uong", "Ủy ban Thường vụ Quốc hội", True),
    "lệnh": (4, "lenh_ctn", "trung_uong", "Chủ tịch nước", True),
    "nghị định": (5, "nghi_dinh", "trung_uong", "Chính phủ", True),
    "thông tư": (7, "thong_tu", "trung_uong", None, True),
    "thông tư liên tịch": (7, "thong_tu_lien_tich", "trung_uong", None, True),
    "văn bản hợp nhất": (NO_NORM, "van_ban_hop_nhat", "trung_uong", None, False),
    "quyết định": (NO_NORM, "quyet_dinh_ca_biet", "khong_xac_dinh", None, False),
}
LOCAL_AGENCY = r"(?i)^\s*(UBND|HĐND|Ủy ban nhân dân|Hội đồng nhân dân)"
#: Weight of a rule by the level of its document.
LEVEL_WEIGHTS = {1: 1.0, 2: 1.0, 3: 0.9, 4: 0.9, 5: 0.8, 6: 0.7, 7: 0.6, 8: 0.4, 9: 0.4, NO_NORM: 0.1}
#: Status texts, the first that is contained wins.
STATUS_TEXTS = [
    ("hết hiệu lực toàn bộ", "het_toan_bo"), ("hết hiệu lực một phần", "het_mot_phan"), ("hết hiệu lực", "het_toan_bo"),
    ("chưa có hiệu lực", "chua_hieu_luc"), ("còn hiệu lực", "con_hieu_luc"), ("chưa xác định", "khong_ro"),
]
#: Current provinces with the names they took in.
PROVINCES = {
    "Hà Nội": (), "Huế": (), "Hải Phòng": ("Hải Dương",), "Đà Nẵng": ("Quảng Nam",),
    "Hồ Chí Minh": ("Bình Dương", "Bà Rịa - Vũng Tàu"), "Cần Thơ": ("Sóc Trăng", "Hậu Giang"),
    "Cao Bằng": (), "Điện Biên": (), "Hà Tĩnh": (), "Lai Châu": (), "Lạng Sơn": (), "Nghệ An": (), "Quảng Ninh": (), "Sơn La": (), "Thanh Hóa": (),
    "Tuyên Quang": ("Hà Giang",), "Lào Cai": ("Yên Bái",), "Thái Nguyên": ("Bắc Kạn",), "Phú Thọ": ("Vĩnh Phúc", "Hòa Bình"),
    "Bắc Ninh": ("Bắc Giang",), "Hưng Yên": ("Thái Bình",), "Ninh Bình": ("Hà Nam", "Nam Định"), "Quảng Trị": ("Quảng Bình",),
    "Quảng Ngãi": ("Kon Tum",), "Gia Lai": ("Bình Định",), "Khánh Hòa": ("Ninh Thuận",), "Lâm Đồng": ("Đắk Nông", "Bình Thuận"),
    "Đắk Lắk": ("Phú Yên",), "Đồng Nai": ("Bình Phước",), "Tây Ninh": ("Long An",), "Vĩnh Long": ("Bến Tre", "Trà Vinh"),
    "Đồng Tháp": ("Tiền Giang",), "Cà Mau": ("Bạc Liêu",), "An Giang": ("Kiên Giang",),
}


def ascii_number(number: Column) -> Column:
    n = fold(F.coalesce(number, F.lit("")))
    return F.trim(F.upper(F.regexp_replace(n, r"(?U)[_\s]+", "-")))


def hierarchy(number: Column, kind: Column | None = None, agency: Column | None = None) -> Column:
    """Struct (level, kind, scope, agency, normative) by number, else type, else local agency."""

    def facts(level, name, scope, issuer, normative) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(name).alias("kind"), F.lit(scope).alias("scope"), F.lit(issuer).cast("string").alias("agency"), F.lit(normative).alias("normative"))

    def ladder(key: Column) -> Column:
        out = F.when(F.coalesce(number, F.lit("")).rlike(r"(?iU)^\s*(Dự thảo|Dự án)\b"), facts(NO_NORM, "du_thao", "khong_xac_dinh", None, False))
        for pattern, *rest in NUMBER_RULES:
            out = out.when(key.rlike(pattern), facts(*rest))
        if kind is not None:
            for name, rest in TYPE_RULES.items():
                out = out.when(F.lower(F.trim(kind)) == name, facts(*rest))
        if agency is not None:
            out = out.when(agency.rlike(LOCAL_AGENCY), facts(NO_NORM, "khong_xac_dinh", "tinh", None, False))
        return out.otherwise(facts(NO_NORM, "khong_xac_dinh", "khong_xac_dinh", None, False))

    # One element: the key is made once a row, however many rules look at it.
    return F.get(F.transform(F.array(ascii_number(number)), ladder), F.lit(0))


def level_weight(level: Column) -> Column:
    out = F.when(level == NO_NORM, LEVEL_WEIGHTS[NO_NORM])
    for k, w in LEVEL_WEIGHTS.items():
        out = out.when(level == k, w)
    return out.otherwise(LEVEL_WEIGHTS[NO_NORM])


def effectivity(status: Column, begins: Column, ends: Column, as_of: Column) -> Column:
    """Struct (state, as_of, source): the published status, else dates, else unknown; never by default in force."""
    text = F.lower(F.trim(F.regexp_replace(F.coalesce(status, F.lit("")), r"(?U)\s+", " ")))
    said = F.lit(None).cast("string")
    for needle, state in reversed(STATUS_TEXTS):
        said = F.when(F.contains(text, F.lit(needle)), state).otherwise(said)
    over, ahead = ends.isNotNull() & (ends <= as_of), begins.isNotNull() & (begins > as_of)
    state = F.when((said == "con_hieu_luc") & over, "het_toan_bo").when(said.isNotNull(), said).when(over, "het_toan_bo").when(ahead, "chua_hieu_luc").otherwise("khong_ro")
    source = F.when((said == "con_hieu_luc") & over, "ngay_thang").when(said.isNotNull(), "trang_thai").when(over | ahead, "ngay_thang").otherwise("khong_ro")
    return F.struct(state.alias("state"), as_of.alias("as_of"), source.alias("source"))


def place_key(name: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(fold(F.coalesce(name, F.lit(""))), "[^a-zA-Z0-9]+", " ")))


def provinces(docs: DataFrame, agency: str) -> DataFrame:
    """Add province_raw (as written) and province_now by the name after the agency's title."""
    rows = [(old, now) for now, olds in PROVINCES.items() for old in (now, *olds)]
    dim = docs.sparkSession.createDataFrame(rows, "_old string, _now string")
    code = lambda c: F.replace(place_key(F.col(c)), F.lit(" "), F.lit("-"))
    dim = dim.select(place_key(F.col("_old")).alias("_place"), code("_old").alias("province_raw"), code("_now").alias("province_now"))
    rest = F.regexp_replace(F.col(agency), r"(?iU)^\s*(UBND|HĐND|Ủy ban nhân dân|Hội đồng nhân dân)\s*(tỉnh|thành phố|tp\.?)?\s*", "")
    place = F.when(F.col(agency).rlike(LOCAL_AGENCY), place_key(rest))
    return docs.withColumn("_at", place).join(F.broadcast(dim), F.col("_at") == F.col("_place"), "left").drop("_at", "_place")  # 63 rows


def field_code(code: Column, name: Column, title: Column, by_code: dict[str, int], by_name: dict[str, int], keywords: list[tuple[str, int]], default: int = 27) -> Column:
    """Struct (code, source): code table, then name table, then the first keyword of the title, then the default."""
    def look(x: Column, table: dict[str, int]) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x) if table else F.lit(None).cast("int")

    low = F.lower(F.coalesce(title, F.lit("")))
    word = F.lit(None).cast("int")
    for k, v in reversed(keywords):
        word = F.when(F.contains(low, F.lit(k)), v).otherwise(word)
    a, b = look(code, by_code), look(F.lower(F.trim(name)), by_name)
    source = F.when(a.isNotNull(), "code").when(b.isNotNull(), "name").when(word.isNotNull(), "title").otherwise("default")
    return F.struct(F.coalesce(a, b, word, F.lit(default)).alias("code"), source.alias("source"))
