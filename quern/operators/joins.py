"""Joins, set operations and order helpers of the evaluation workloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import materialize


def subset(entries: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The entries whose key is among ``ids``; a semi-join never repeats an entry."""
    return entries.join(ids, key, "left_semi")


def not_done(entries: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return entries.join(done.select(key), key, "left_anti")


def missing_chunks(spark: SparkSession, n: int, done: DataFrame) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "chunk_id").join(done, "chunk_id", "left_anti")


def expand_groups(asked: DataFrame, members: DataFrame) -> DataFrame:
    """Names of groups become their members, other names stay; each once. ``members`` (grp, category) is a small list."""
    return asked.join(F.broadcast(members), F.col("name") == F.col("grp"), "left").select(F.coalesce("category", "name").alias("category")).distinct()


def keep_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Only these columns; one that isn't there is an analysis error."""
    return df.select(*names)


def search(df: DataFrame, what: str, *cols: str) -> DataFrame:
    """Rows in which any of the columns holds the text, in any case."""
    return df.filter(reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(what.lower()) for c in cols]))


def any_equals(df: DataFrame, value: Column, *cols: str) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).eqNullSafe(value) for c in cols]))


def group_log(df: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """The values of each key in order of ``seq``, as an array: the log itself is the result, so a group is a row."""
    return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(seq, value))), lambda x: x[value]).alias("backs"))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Position from 1 in a total order.

    A single window would send all rows to one task. Rows are dealt by range of the order instead; each partition is
    numbered on its own, and gets the number of rows before it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return own.join(F.broadcast(before), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")


def attach_docs(entries: DataFrame, docs: DataFrame, held_out: DataFrame) -> DataFrame:
    """Each entry's classes replaced by their docs, in order; classes that are held out or have no doc are left out."""
    x = entries.select(*[c for c in entries.columns if c != "classes"], F.posexplode("classes").alias("p", "cls"))
    x = x.join(F.broadcast(held_out), "cls", "left_anti").join(docs, "cls")
    keys = [c for c in entries.columns if c != "classes"]
    return x.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "doc"))), lambda s: s["doc"]).alias("docs"))


def levels(entries: DataFrame, chain: str, pos: str) -> DataFrame:
    """Entries of a chain depend on those before them: level is how many, needs the id of the last of them."""
    w = Window.partitionBy(chain).orderBy(pos)
    prev = F.lag(pos).over(w)
    return entries.withColumn("level", (F.row_number().over(w) - 1).cast("long")).withColumn("needs", F.when(prev.isNotNull(), F.concat_ws("-", F.col(chain).cast("string"), prev.cast("string"))))


def bag_contains(a: Column, b: Column) -> Column:
    """Whether array ``b`` has each value no more often than ``a``."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y.eqNullSafe(x)))
    return F.forall(b, lambda x: count(a, x) >= count(b, x))


def is_subsequence(a: Column, b: Column) -> Column:
    """Whether the values of ``b`` occur in ``a`` in this order."""
    n = F.size(b)
    return F.aggregate(a, F.lit(0), lambda k, x: k + F.when((k < n) & F.get(b, k).eqNullSafe(x), 1).otherwise(0)) == n
