"""Readers and writers: Parquet tables as views, files by extension, inline rows, sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

READERS = {"parquet": "parquet", "orc": "orc", "json": "json", "jsonl": "json", "ndjson": "json", "csv": "csv", "tsv": "csv", "txt": "text", "avro": "avro", "xml": "xml"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register tables as temporary views of their own names."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def file_scan(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """``FROM 'file'``: the reader follows from the extension."""
    stem = path.rstrip("/").removesuffix(".gz").rpartition(".")[2].lower()
    if stem not in READERS:
        raise ValueError(f"no reader for {path}")
    reader = spark.read.options(**options)
    if stem in ("csv", "tsv"):
        reader = reader.option("header", options.get("header", "true")).option("sep", "\t" if stem == "tsv" else options.get("sep", ","))
    return (reader.schema(schema) if schema else reader).format(READERS[stem]).load(path)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder that the driver and all executors reach, below ``spark.checkpoint.dir``.

    Only a local session may lack that setting; it gets a temporary folder.  A path
    without a scheme lies in Hadoop's default file system, as everywhere in Spark.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        base = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        context.setCheckpointDir(base)
    path = context._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()


def materialized(df: DataFrame, label: str = "rows") -> DataFrame:
    """``df`` written once to a shared folder and read again, so later steps see the same rows."""
    folder = shared_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fresh_names(stems: str, *frames: DataFrame) -> list[str]:
    """Names that none of ``frames`` has as a column (names compare without case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    out = []
    for name in stems.split():
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Inline VALUES."""
    return spark.createDataFrame(rows, schema)


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, **options) -> None:
    """COPY / EXPORT: one sink call for all formats."""
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
