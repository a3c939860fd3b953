"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm._common import fresh, lookup, rows_with, stash, table


def normalized(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after white space is normalised; null counts as empty. The row with the
    smallest id is kept; a null id comes after all others, and of rows with the same id one is kept. A very long text is
    one value of the grouping, in a row's memory. Columns other than id and text are ignored, whatever their names. An
    empty table gives an empty result.

    Hashes and ids only are shuffled for rows that are alone with their hash. The texts of the others are grouped by
    (hash, text) with partial aggregation: a group of copies is one row per task, however large. If a hash has more
    than one text (``digest`` is a parameter so that tests can force this), its rows are regrouped by text.
    """
    src = docs.select(F.col(id_col).alias("id"), normalized(F.col(text_col)).alias("t"))
    base = stash(src.select("id", F.unhex(digest(F.col("t"))).alias("h"), F.unhex(F.sha2("t", 256)).alias("sha"), F.monotonically_increasing_id().alias("row")))
    first = F.min(F.struct(F.isnull("id").alias("no_id"), "id", "row"))
    groups = stash(base.groupBy("h").agg(first.alias("keep"), F.count("*").alias("n")).filter("n > 1"))
    total, copies = base.count(), groups.agg(F.sum("n")).head()[0] or 0

    members = lookup(base.select("h", "id"), groups.select("h", "n"), "h", "inner", "n", total).select("id").distinct()
    with_text = rows_with(src, "id", members, copies).select("id", "t", F.unhex(digest(F.col("t"))).alias("h"))
    texts = with_text.groupBy("h", "t").agg(F.count("*").alias("n"))
    mixed = stash(texts.groupBy("h").agg(F.count("*").alias("texts")).filter("texts > 1").select("h"))

    whole = groups.join(mixed, "h", "left_anti") if (collided := mixed.count()) else groups
    plain = base.join(mixed, "h", "left_anti") if collided else base
    kept = lookup(plain, stash(whole) if collided else whole, "h", "left", "n", total)
    out = kept.select(
        "id",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("row") == F.col("keep.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    if collided:
        w = Window.partitionBy("h", "t")
        again = with_text.join(mixed, "h", "left_semi").withColumn("rank", F.row_number().over(w.orderBy(F.col("id").asc_nulls_last())))
        out = out.unionByName(
            again.select("id", F.min("id").over(w).alias("keep_id"), F.count("*").over(w).alias("group_size"), (F.col("rank") == 1).alias("kept"), F.sha2("t", 256).alias("text_sha256"))
        )
    return out.withColumnRenamed("id", id_col)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_groups keeps, all columns: one row of each group.

    Where an id has several rows, rows are told apart by id and text, and of repeated ones one stays. Null and empty
    texts are one group; a null id stays only if its group has no other. No rows give no rows.
    """
    groups = stash(exact_groups(docs.select(id_col, text_col), id_col, text_col))
    if groups.groupBy(id_col).count().filter("count > 1").isEmpty():
        gone = stash(groups.filter("not kept").select(id_col))
        return rows_with(docs, id_col, gone, gone.count(), "left_anti")
    sha, kept_id, kept_sha = (fresh() for _ in range(3))
    kept = groups.filter("kept").select(F.col(id_col).alias(kept_id), F.col("text_sha256").alias(kept_sha))
    told = docs.withColumn(sha, F.sha2(normalized(F.col(text_col)), 256)).dropDuplicates([id_col, sha])
    return told.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha)), "left_semi").drop(sha)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""
