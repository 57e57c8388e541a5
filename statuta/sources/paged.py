"""A registry that is read page by page, newest first, as a Spark data source: batch, or a stream that resumes by page.

    spark.dataSource.register(paged.PagedSource)
    spark.read.format("paged").options(path=..., cutoff="2024-01-20").load()

Pages are the folders `page=1`, `page=2`, … under a path (see `land`), each one JSON response in any of the layouts that
registries send, in a store that pyarrow opens. Reading goes on to the next page until one holds an item older than the cutoff, one is
empty or missing, or `cap` pages were read: later pages are never opened. An item older than the cutoff is left out,
one without a date is not. A page that can't be read is one row with its error and no item; the next page is read.

A batch read plans one partition a page: the driver looks at the dates alone (`cap` pages at most), tasks parse the items.
A stream takes `pages` pages a batch; its offset is the next page, the newest date so far and whether the scan is over, so a query that
was stopped goes on with the page after its last one, and `high_water` tells the next scan's mark only when the scan is over.
"""

from __future__ import annotations

import ast
import datetime
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "page int, pos int, id string, issued date, item string, error string"
#: Fixed value: pages a scan reads at most.
CAP = 40


def _day(text: str | None) -> datetime.date | None:
    """The date of a response: ISO, with or without a time, or day/month/year; null if it is none."""
    for form, part in (("%Y-%m-%d", slice(0, 10)), ("%d/%m/%Y", slice(0, 10))):
        try:
            return datetime.datetime.strptime((text or "")[part], form).date()
        except (ValueError, TypeError):
            continue
    return None


def items_of(response: str) -> list[dict]:
    """The items of a response: `data.items`, `data.data`, `data` or `items`; each may be wrapped in `data` once more."""
    body = json.loads(response)
    found = body.get("data", body.get("items")) if isinstance(body, dict) else body
    if isinstance(found, dict):
        found = found.get("items") or found.get("data") or []
    return [i.get("data", i) for i in found or [] if isinstance(i, dict)]


class Pages:
    """Responses by number, from a folder."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def response(self, page: int) -> str | None:
        """A page's text; None if there is no such page."""
        from pyarrow import fs

        at = f"{self.path}/page={page}"
        at = f"file://{at[5:]}" if at.startswith("file:/") and not at.startswith("file://") else at
        store, where = fs.FileSystem.from_uri(at if "://" in at else f"file://{at}")
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(where, allow_not_found=True)) if f.is_file and not f.base_name.startswith((".", "_")))
        if not files:
            return None
        parts = []
        for f in files:
            with store.open_input_stream(f) as s:
                parts.append(s.read().decode("utf-8"))
        return "".join(parts)

    def rows(self, page: int, cutoff: datetime.date | None) -> tuple[list[tuple], bool, bool]:
        """(rows, whether the page holds an item older than the cutoff, whether it holds anything)."""
        text = self.response(page)
        if text is None:
            return [], False, False
        try:
            items = items_of(text)
        except (ValueError, AttributeError) as e:
            return [(page, None, None, None, None, f"{type(e).__name__}: {e}")], False, True
        days = [_day(i.get("issueDate")) for i in items]
        old = [d is not None and cutoff is not None and d < cutoff for d in days]
        rows = [(page, n, str(i.get("id", "")), d, json.dumps(i, ensure_ascii=False), None) for n, (i, d, o) in enumerate(zip(items, days, old)) if not o]
        return rows, any(old), bool(items)


class _Page(InputPartition):
    def __init__(self, page: int) -> None:
        self.page = page


class _Options:
    def __init__(self, options: dict[str, str]) -> None:
        self.pages, self.cap = Pages(options["path"]), int(options.get("cap", CAP))
        self.cutoff = _day(options.get("cutoff"))
        self.start, self.each = int(options.get("start", 1)), int(options.get("pages", 5))


class _Batch(_Options, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for page in range(self.start, self.cap + 1):
            _, past, some = self.pages.rows(page, self.cutoff)
            if not some:
                break
            out.append(_Page(page))
            if past:
                break
        return out or [_Page(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.page:
            yield from self.pages.rows(partition.page, self.cutoff)[0]


class _Stream(_Options, SimpleDataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"page": self.start, "high": "", "over": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows: list[tuple] = []
        page, high, over = start["page"], start["high"], start["over"]
        for _ in range(self.each):
            if over or page > self.cap:
                over = True
                break
            found, past, some = self.pages.rows(page, self.cutoff)
            rows += found
            high = max([high, *(r[3].isoformat() for r in found if r[3])])
            page, over = page + some, past or not some
        return iter(rows), {"page": page, "high": high, "over": over}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for page in range(start["page"], end["page"]):
            yield from self.pages.rows(page, self.cutoff)[0]

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """Options: path, cutoff (a date), cap (pages at most), start (first page), pages (a batch of a stream)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


def land(items: DataFrame, path: str, page: str, pos: str, item: str) -> str:
    """Write responses: rows of (page, pos, item as JSON) become one JSON text a page."""
    lists = items.groupBy(F.col(page).alias("page")).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(item).alias("i")))).alias("l"))  # a page's items
    text = F.concat(F.lit('{"data":{"items":['), F.array_join(F.transform("l", lambda x: x["i"]), ","), F.lit("]}}"))
    lists.select("page", text.alias("value")).write.mode("overwrite").partitionBy("page").text(path)
    return path


def scan(spark: SparkSession, path: str, cutoff: str | None = None, cap: int = CAP, start: int = 1) -> DataFrame:
    """(page, pos, id, issued, item, error): a batch read with each id once, where it came first; error rows stay."""
    spark.dataSource.register(PagedSource)
    options = {"path": path, "cap": str(cap), "start": str(start)} | ({"cutoff": cutoff} if cutoff else {})
    rows = spark.read.format("paged").options(**options).load()
    first = rows.where("error IS NULL").groupBy("id").agg(F.min(F.struct("page", "pos", "issued", "item")).alias("f")).select("f.page", "f.pos", "id", "f.issued", "f.item", F.lit(None).cast("string").alias("error"))
    return first.unionByName(rows.where("error IS NOT NULL"))


def high_water(offset: str | dict, before: str = "") -> str:
    """The mark after an offset, as a stream's progress tells it: the newest date if the scan is over, else the one before."""
    at = ast.literal_eval(offset) if isinstance(offset, str) else offset
    return max(at["high"], before) if at["over"] else before
