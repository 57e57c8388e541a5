"""Landed payloads: registry JSON, feeds, chunk files, page listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.functions.facts import hierarchy
from statuta.functions.values import any_date
from statuta.streaming.scans import whole_row

#: Reference kinds by code; other codes are not verified and keep their number.
RELATIONS = {1: "Bãi bỏ", 3: "Căn cứ", 9: "Căn cứ", 10: "Sửa đổi, bổ sung", 12: "Thay thế"}
ITEM = (
    "id string, docNum string, title string, docType struct<name:string>, effStatus struct<name:string>, agencyName string, "
    "organization struct<name:string>, issueDate string, effFrom string, effTo string, fields array<struct<name:string>>, "
    "references array<struct<referenceType:int,label:string,targetDocNum:string,targetDocument:struct<docNum:string,id:string>>>, "
    "documentContent struct<content:string>, content string"
)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed list or detail responses, whichever of the three layouts they have."""
    raw = spark.read.text(path, wholetext=True)
    whole = F.from_json("value", f"data struct<items:array<struct<{_inline(ITEM)}>>,data:array<struct<{_inline(ITEM)}>>>, items array<struct<{_inline(ITEM)}>>")
    one = F.from_json("value", f"data struct<{_inline(ITEM)}>")
    lists = F.coalesce(F.col("w.data.items"), F.col("w.data.data"), F.col("w.items"), F.when(F.col("o.data.id").isNotNull(), F.array("o.data")))
    return raw.select(whole.alias("w"), one.alias("o")).select(F.explode(lists).alias("i")).select("i.*")


def _inline(fields: str) -> str:
    """A DDL column list as the inside of a struct type."""
    out, depth = [], 0
    word = ""
    for ch in fields:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(word.strip())
            word = ""
        else:
            word += ch
    out.append(word.strip())
    return ",".join(x.replace(" ", ":", 1) for x in out)


def document_rows(items: DataFrame, base_url: str = "") -> DataFrame:
    """One flat row a registry item; the agency named beats its organisation, the number's own agency beats both."""
    return items.select(
        F.col("id").alias("moj_id"), F.col("docNum").alias("doc_num"), "title", F.col("docType.name").alias("doc_type"), F.col("effStatus.name").alias("eff_status"),
        F.coalesce(hierarchy(F.col("docNum"))["agency"], "agencyName", "organization.name").alias("agency_name"), any_date(F.col("issueDate")).alias("issue_date"),
        any_date(F.col("effFrom")).alias("eff_from"), any_date(F.col("effTo")).alias("eff_to"),
        F.when(F.trim("id") != "", F.concat(F.lit(f"{base_url}/doc/"), F.trim("id"))).otherwise("").alias("url"),
        F.coalesce("documentContent.content", "content").alias("html"),
    )


def relation_label(code: Column) -> Column:
    known = F.try_element_at(F.create_map(*[F.lit(v) for kv in RELATIONS.items() for v in kv]), code)
    return F.coalesce(known, F.format_string("Chưa xác định (mã %d)", code))


def reference_rows(items: DataFrame) -> DataFrame:
    """(moj_id, target_doc_num, target_moj_id, relation); references without a number go."""
    r = items.select(F.col("id").alias("moj_id"), F.explode("references").alias("r"))
    number = F.coalesce("r.targetDocument.docNum", "r.targetDocNum")
    return r.select("moj_id", number.alias("target_doc_num"), F.col("r.targetDocument.id").alias("target_moj_id"), F.coalesce("r.label", relation_label(F.col("r.referenceType"))).alias("relation")).where("trim(target_doc_num) <> ''")


def incremental(items: DataFrame, cutoff: Column) -> DataFrame:
    """Items by id, once each (the latest, of several the one of the smallest hash), not older than the cutoff."""
    d = items.withColumn("_d", any_date(F.col("issueDate")))
    r = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_d"), *whole_row(items)))
    return d.where(F.col("_d") >= cutoff).withColumn("_r", r).where("_r = 1").drop("_r", "_d")


ENTRY = "title string, link string, category string, pubDate string"


def feed(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Entries of landed RSS files whose link or category names one of the fields; entries without an id go."""
    return _entries(spark.read.format("xml").option("rowTag", "item").schema(ENTRY).load(path), fields)


def feeds(texts: DataFrame, fields: list[str], text: str = "value") -> DataFrame:
    """The same of a table with an RSS text a row: many feeds are few files. Of a text that breaks off its whole entries count."""
    items = texts.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?s)<item[\s>].*?</item>"), F.lit(0))).alias("item"))
    return _entries(items.select(F.from_xml("item", ENTRY).alias("i")).select("i.*"), fields)


def _entries(x: DataFrame, fields: list[str]) -> DataFrame:
    x = x.withColumn("tvpl_id", F.regexp_extract("link", r"-(\d+)\.aspx", 1)).withColumn("slug", F.regexp_extract("link", r"/([^/]+)-\d+\.aspx", 1))
    hay = F.lower(F.concat_ws(" ", "link", "category"))
    wanted = F.lit(False)
    for f in fields:
        wanted = wanted | F.contains(hay, F.lit(f.lower()))
    return x.where(wanted & (F.col("tvpl_id") != "")).withColumn("pub_date", F.try_to_date(F.nullif(F.regexp_extract("pubDate", r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1), F.lit("")), "d MMM yyyy"))


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """Chunk arrays of *_chunks.json files with the id in the file's name."""
    c = spark.read.schema("chunk_index int, heading string, content string, char_count int, chunk_type string").json(path, multiLine=True)
    return c.withColumn("moj_id", F.regexp_extract(F.input_file_name(), r"([^/]+)_chunks\.json$", 1))


def text_with_fallbacks(docs: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """docs with the text found by the first key that has one; texts has (name, text)."""
    out, found = docs, []
    for i, k in enumerate(keys):
        t = texts.select(F.col("name").alias(f"_n{i}"), F.col("text").alias(f"_t{i}"))
        out = out.join(t, F.col(k) == F.col(f"_n{i}"), "left").drop(f"_n{i}")
        found.append(f"_t{i}")
    return out.withColumn("text", F.coalesce(*found)).drop(*found)


def vault_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a published index; entries without a slug, or with one that leaves the folder, go."""
    rows = spark.read.schema("documents array<struct<slug:string,num:string,state:string,refs:array<string>>>").json(path, multiLine=True)
    d = rows.select(F.explode("documents").alias("d")).select("d.*")
    return d.where(F.col("slug").isNotNull() & ~F.contains("slug", F.lit("..")) & ~F.contains("slug", F.lit("/")))


def adjacency(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """(source slug, target slug, relation) from index triples (i, j, relation) of an exported list."""
    a = documents.select(F.col("index").alias("i"), F.col("slug").alias("source"))
    b = documents.select(F.col("index").alias("j"), F.col("slug").alias("target"))
    return edges.join(a, "i").join(b, "j").select("source", "target", "relation")
