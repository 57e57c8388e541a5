"""Session settings and written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build(name: str = "statuta", **conf: str) -> SparkSession:
    """A session with adaptive plans and UTC; master and memory come from spark-submit."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The application's folder among what all executors share. A local one serves only a single-machine session."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if not root:
        master = conf.get("spark.master", "")
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{tempfile.gettempdir()}/statuta-work"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def _file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, tag: str, batch: int | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors.

    The application's folder goes when the application ends. batch: rows of an Arrow batch in this write, where texts go to
    Python; the session's own setting is put back.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(RECORDS)
    if batch is not None and (int(before) <= 0 or int(before) > batch):
        spark.conf.set(RECORDS, batch)
    try:
        df.write.parquet(path)
    finally:
        if batch is not None:
            spark.conf.set(RECORDS, before)
    p, files = _file_system(spark, folder)
    files.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *by: Column | str) -> DataFrame:
    """df in parts of about `rows` rows, by columns if named: for small rows that much is made of. Input splits and adaptive
    plans go by bytes, so a million keys may be one task."""
    return df.repartition(max(1, -(-df.count() // rows)), *by)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing will read again."""
    for t in tables:
        for name in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            p, files = _file_system(t.sparkSession, name)
            files.delete(p, True)
