"""Readers: JSON lines, whole files, API documents, tables of a database."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(spark: SparkSession, path: str, schema: str, sort_by: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """JSON lines with a declared schema, from a folder and all below it; file_path tells where a row stood."""
    r = spark.read.schema(schema).option("recursiveFileLookup", "true")
    df = (r.option("pathGlobFilter", pattern) if pattern else r).json(path).withColumn("file_path", F.col("_metadata.file_path"))
    return df.orderBy(*sort_by) if sort_by else df


def json_document(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """One row per file: a member of the JSON document that the whole file is."""
    return spark.read.text(path, wholetext=True).select(F.get_json_object("value", f"$.{field}").alias(field))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Text of PDF files, page by page: what stands in uncompressed or deflated content streams' text operators.

    Encodings other than the standard ones need a PDF library, which is not part of this engine.
    """

    def text_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("path"), pa.array([_pdf_text(x) for x in b.column("content").to_pylist()], pa.string())], ["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(text_of, "path string, text string")


def _pdf_text(data: bytes) -> str:
    import zlib

    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        raw = m[1]
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass  # the stream is not deflated
        for t in re.finditer(rb"\(((?:\\.|[^\\()])*)\)\s*Tj|\[((?:\\.|[^\]])*)\]\s*TJ", raw, re.S):
            parts = [t[1]] if t[1] is not None else re.findall(rb"\(((?:\\.|[^\\()])*)\)", t[2])
            out.append(re.sub(rb"\\([()\\])", rb"\1", b"".join(parts)).decode("latin-1"))
    return " ".join(out)


API_FIELDS = ("user_name", "api_name", "api_call", "api_version", "api_arguments", "functionality")


def api_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON list of API documents (or one per line), each as one JSON string; without a required field the read fails."""
    df = spark.read.option("multiLine", str(not lines).lower()).option("primitivesAsString", "true").json(path)
    missing = [c for c in API_FIELDS if c not in df.columns]
    if missing:
        raise ValueError(f"API documents lack {missing}")
    return df.select(F.to_json(F.struct(*df.columns)).alias("chunk"))


def arrow_rows(df: DataFrame, content: str, schema: str) -> DataFrame:
    """Rows of datasets in Arrow's stream or file format, one dataset in each row of ``df`` (binaryFile gives them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                raw = data.as_buffer()
                opened = pa.ipc.open_file(raw) if raw[:6].to_pybytes() == b"ARROW1" else pa.ipc.open_stream(raw)
                yield from opened.read_all().to_batches()

    return df.select(content).mapInArrow(run, schema)


def sqlite_rows(df: DataFrame, content: str, sql: str, schema: str) -> DataFrame:
    """Rows that a query gives on SQLite databases, one database in each row of ``df`` (binaryFile gives them)."""
    import sqlite3

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf[content]:
                with sqlite3.connect(":memory:") as con:
                    con.deserialize(bytes(data))
                    yield pd.read_sql_query(sql, con)

    return df.select(content).mapInPandas(run, schema)


def database_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table over JDBC; give partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def schema_text(tables: dict[str, DataFrame]) -> str:
    """The schemas of tables as text for a prompt."""
    return "\n".join(f"Table: {n}\n" + "\n".join(f"  {f.name} ({f.dataType.simpleString()})" for f in df.schema) for n, df in tables.items())


def page_markdown(html: "F.Column") -> "F.Column":
    """A page as plain text: scripts, styles and comments go, headings and list items are marked, tags go."""
    x = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<head\b.*?</head\s*>", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)<h[1-6][^>]*>", "\n# "), r"(?i)<li[^>]*>", "\n* ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)</?(p|div|br|tr|ul|ol|h[1-6]|article|section)\b[^>]*>", "\n"), r"<[^>]*>", "")
    return F.trim(F.regexp_replace(x, r"\s*\n\s*", "\n"))
