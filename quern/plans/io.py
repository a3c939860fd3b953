"""Readers and writers, each by a round trip through the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from quern.functions import ids
from quern.plans.registry import Tables, query
from quern.plans.results import GROUP_SQL, RESULTS, results
from quern.session import shared_folder
from quern.sources import readers, sinks


def folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/io-{uuid.uuid4().hex}"


@query("src_jsonl", "SELECT doc_id, lang, md5(text) AS digest FROM documents")
def src_jsonl(t):
    path = folder(t)
    sinks.write_jsonl(t.documents.select("doc_id", "lang", "text"), path)
    return readers.jsonl(t.spark, path, "doc_id long, lang string, text string", ["doc_id"]).select("doc_id", "lang", F.md5("text").alias("digest"))


@query("src_recursive", "SELECT doc_id, lang AS folder FROM documents")
def src_recursive(t):
    path = folder(t)
    sinks.write_jsonl(t.documents.select("doc_id", "lang"), path, "lang")
    return readers.jsonl(t.spark, path, "doc_id long", pattern="*.json").select("doc_id", F.regexp_extract("file_path", r"lang=(\w+)/", 1).alias("folder"))


def by_item(t: Tables, text) -> str:
    """One text file per test item."""
    path = folder(t)
    t.benchmark.select("item_id", text.alias("value")).write.partitionBy("item_id").text(path)
    return path


def item_of(path: str):
    return F.regexp_extract(path, r"item_id=(\d+)", 1).cast("long").alias("item_id")


@query("src_json_doc", "SELECT md5(text) AS digest, count(*) AS n FROM benchmark GROUP BY 1")
def src_json_doc(t):
    path = by_item(t, F.to_json(F.struct("text")))
    return readers.json_document(t.spark, f"{path}/*", "text").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query("src_txt", "SELECT item_id, md5(text || chr(10)) AS digest FROM benchmark")
def src_txt(t):
    files = readers.text_files(t.spark, f"{by_item(t, F.col('text'))}/*")
    return files.select(item_of("file_path"), F.md5("text").alias("digest"))


@query("src_pdf", "SELECT item_id, 'item (' || item_id || ') end' AS text FROM benchmark")
def src_pdf(t):
    n = F.col("item_id").cast("string")
    page = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<<>>\nstream\nBT (item \\("), n, F.lit("\\)) Tj (end) Tj ET\nendstream\nendobj"))
    return readers.pdf_files(t.spark, f"{by_item(t, page)}/*").select(item_of("path"), "text")


@query("src_api", "SELECT s_name AS api_name, s_suppkey::VARCHAR AS version, s_nationkey::VARCHAR AS nation FROM supplier")
def src_api(t):
    path = folder(t)
    doc = F.struct(F.lit("u").alias("user_name"), F.col("s_name").alias("api_name"), F.lit("f()").alias("api_call"), F.col("s_suppkey").alias("api_version"), F.create_map(F.lit("nation"), F.col("s_nationkey")).alias("api_arguments"), F.lit("x").alias("functionality"))
    t.supplier.select(doc.alias("d")).select("d.*").write.json(path)  # a list, or one document per line
    c = readers.api_documents(t.spark, path, lines=True).select("chunk")
    return c.select(*[F.get_json_object("chunk", f"$.{p}").alias(n) for p, n in (("api_name", "api_name"), ("api_version", "version"), ("api_arguments.nation", "nation"))])


@query("src_hf", "SELECT n_nationkey, n_name FROM nation")
def src_hf(t):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["content"])

    packed = t.nation.select("n_nationkey", "n_name").mapInArrow(pack, "content binary")
    return readers.arrow_rows(packed, "content", "n_nationkey int, n_name string")


@query("src_sqlite", "SELECT n_nationkey::BIGINT AS id, upper(n_name) AS name FROM nation WHERE n_regionkey > 0")
def src_sqlite(t):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for pdf in batches:
            with sqlite3.connect(":memory:") as con:
                pdf.to_sql("nation", con, index=False)
                yield pd.DataFrame({"content": [con.serialize()]})

    packed = t.nation.select("n_nationkey", "n_name", "n_regionkey").mapInPandas(pack, "content binary")
    return readers.sqlite_rows(packed, "content", "SELECT n_nationkey AS id, upper(n_name) AS name FROM nation WHERE n_regionkey > 0", "id long, name string")


TAGS = (
    (r"<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<head\b.*?</head\s*>", "''"), (r"<h[1-6][^>]*>", "chr(10) || '# '"), (r"<li[^>]*>", "chr(10) || '* '"),
    (r"</?(?:p|div|br|tr|ul|ol|h[1-6]|article|section)\b[^>]*>", "chr(10)"), (r"<[^>]*>", "''"), (r"\s*\n\s*", "chr(10)"),
)
MARKDOWN = "html"
for _pattern, _new in TAGS:
    MARKDOWN = f"regexp_replace({MARKDOWN}, '{_pattern}', {_new}, 'gis')"


@query("src_html", f"SELECT page_id, md5(trim({MARKDOWN})) AS digest FROM pages")
def src_html(t):
    return t.pages.select("page_id", F.md5(readers.page_markdown(F.col("html"))).alias("digest"))


@query("snk_jsonl", "SELECT doc_id, source, md5(text) AS digest, doc_id % 3 = 0 AS odd FROM documents")
def snk_jsonl(t):
    path = folder(t)
    odd = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string").cast("binary"))
    sinks.write_jsonl(t.documents.select("doc_id", "source", "text", odd.alias("raw")), path)
    lines = t.spark.read.text(path)
    got = {n: F.get_json_object("value", f"$.{n}") for n in ("doc_id", "source", "text", "raw")}
    return lines.select(got["doc_id"].cast("long").alias("doc_id"), got["source"].alias("source"), F.md5(got["text"]).alias("digest"), got["raw"].isNotNull().alias("odd"))


@query("snk_upsert", "SELECT doc_id, coalesce(max_by(l.quality + 10, l.toxic * 2 + l.quality), any_value(d.n_chars))::BIGINT AS v FROM documents d FULL JOIN labels l USING (doc_id) GROUP BY doc_id")
def snk_upsert(t):
    old = t.documents.select("doc_id", F.col("n_chars").alias("v"))
    new = t.labels.select("doc_id", (F.col("quality") + 10).cast("long").alias("v"), (F.col("toxic") * 2 + F.col("quality")).alias("_seq"))
    return sinks.merged(old, new, "doc_id")


@query("snk_partition", f"WITH {RESULTS} SELECT {GROUP_SQL} AS grp, category, count(*) AS n, sum(valid::INT)::BIGINT AS correct FROM results GROUP BY ALL")
def snk_partition(t):
    path = folder(t)
    sinks.write_jsonl(results(t).withColumn("grp", ids.group_of(F.col("category"))).select("grp", "category", "id", "valid"), path, "grp", "category")
    got = t.spark.read.schema("id string, valid boolean, grp string, category string").json(path)
    return got.groupBy("grp", "category").agg(F.count("*").alias("n"), F.sum(F.col("valid").cast("int")).alias("correct"))


@query("snk_export", "SELECT doc_id, lang, k FROM documents, (VALUES ('jsonl'), ('parquet')) v(k)")
def snk_export(t):
    out = None
    for kind in ("jsonl", "parquet"):
        where = sinks.export(t.documents.select("doc_id", "lang"), folder(t), kind)
        got = (t.spark.read.schema("doc_id long, lang string").json(where) if kind == "jsonl" else t.spark.read.parquet(where)).withColumn("k", F.lit(where.rsplit(".", 1)[1]))
        out = got if out is None else out.unionByName(got)
    return out


@query("chk_resume", "SELECT doc_id, n_chars, doc_id % 4 AS chunk FROM documents")
def chk_resume(t):
    work, path = t.documents.select("doc_id", "n_chars", (F.col("doc_id") % 4).alias("chunk")), folder(t)
    sinks.checkpointed(t.spark, work.filter("chunk < 2"), path, "chunk", lambda df: df)  # a run that ended early
    return sinks.checkpointed(t.spark, work, path, "chunk", lambda df: df).select("doc_id", "n_chars", F.col("chunk").cast("long").alias("chunk"))


@query("schema_prompt", "SELECT 'Table: region' || chr(10) || '  r_regionkey (int)' || chr(10) || '  r_name (string)' || chr(10) || 'Table: labels' || chr(10) || '  doc_id (bigint)' || chr(10) || '  quality (int)' || chr(10) || '  toxic (int)' AS prompt")
def schema_prompt(t):
    return t.spark.createDataFrame([(readers.schema_text({"region": t.region, "labels": t.labels}),)], "prompt string")
