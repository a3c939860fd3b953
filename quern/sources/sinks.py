"""Writers: JSON lines, merge by id, partitions, ranked CSV, rating text, resume by chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, *partition_by: str) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def with_extension(path: str, extension: str) -> str:
    return path if path.endswith(f".{extension}") else f"{path}.{extension}"


def export(df: DataFrame, path: str, kind: str = "jsonl") -> str:
    """Writes a dataset as jsonl or parquet; where it is: the extension is added if it is missing."""
    where = with_extension(path, kind)
    w = df.write.mode("overwrite")
    w.json(where) if kind == "jsonl" else w.parquet(where)
    return where


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of both; of a key the last new one. New rows must carry their order in ``_seq``."""
    both = old.withColumn("_seq", F.lit(-1).cast("long")).unionByName(new.withColumn("_seq", F.col("_seq").cast("long")))
    rest = [c for c in old.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), "_seq").alias("_last")).select(key, "_last.*").select(*old.columns)


def rank_lines(df: DataFrame, by: str, name: str) -> DataFrame:
    """Lines ``rank,name,percent``, best first, rows without a value last. A leaderboard has a row per model."""
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last(by), name)).cast("string")
    return df.select(F.concat_ws(",", rank, name, F.when(F.col(by).isNull(), "N/A").otherwise(F.format_string("%.2f%%", F.col(by) * 100))).alias("line"))


def rating_lines(ratings: DataFrame) -> DataFrame:
    """(category, pos, line): a heading for each category, then ``name: rating``, best first."""
    pos = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("rating"), "name"))
    head = ratings.select("category").distinct().select("category", F.lit(0).alias("pos"), F.concat(F.lit("ELO Ratings for "), "category", F.lit(" category:")).alias("line"))
    return head.unionByName(ratings.select("category", pos.alias("pos"), F.concat("name", F.lit(": "), F.col("rating").cast("string")).alias("line")))


def parse_rating_lines(lines: DataFrame, order: str, file: str) -> DataFrame:
    """(category, name, rating) from such lines; a line belongs to the last heading before it in its file."""
    head = F.nullif(F.regexp_extract("line", r"^ELO Ratings for (.*) category:$", 1), F.lit(""))
    carried = F.last(head, ignorenulls=True).over(Window.partitionBy(file).orderBy(order))
    x = lines.withColumn("category", carried).withColumn("is_head", head.isNotNull()).filter("not is_head and line <> ''")
    return x.select("category", F.regexp_extract("line", r"^(.*): ([^:]*)$", 1).alias("name"), F.regexp_extract("line", r"^(.*): ([^:]*)$", 2).cast("double").alias("rating"))


def checkpointed(spark: SparkSession, work: DataFrame, path: str, chunk: str, compute) -> DataFrame:
    """Computes the chunks that ``path`` doesn't have yet, adds them there, and returns all of them."""
    try:
        done = spark.read.parquet(path).select(chunk).distinct()
        left = work.join(done, chunk, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        left = work
    compute(left).write.mode("append").partitionBy(chunk).parquet(path)
    return spark.read.parquet(path)
