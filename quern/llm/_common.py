"""Shared pieces: tables written to the shared folder, heavy-hitter joins, connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds at least 1/HOT_SHARE of all rows is "hot"; at most HOT_SHARE keys can, so a table of them is bounded.
HOT_SHARE = 1000
#: Rows below which no key is hot, however few there are in all.
LEAST_HOT = 256
#: Rows of a table of a few numbers that is broadcast whole.
SMALL = 100_000
#: Copies of a hot row that is too large to broadcast.
SALTS = 64
#: Up to so many ids are broadcast to find their rows; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where all runs on one machine can it be unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where or "file:" + os.path.join(tempfile.gettempdir(), f"quern-checkpoints-{os.getpid()}")


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing will read again."""
    for t in tables:
        spark, path = t.sparkSession, t.stashed_at
        _delete(spark, path)
        _written[:] = [x for x in _written if x[1] != path]


def stashed_now() -> int:
    """A mark: tables stashed after it can be dropped together."""
    return len(_written)


def drop_stash(since: int = 0, but: DataFrame | None = None) -> None:
    """Delete every stashed table of this process, or those after a mark but one; call it once results are saved."""
    rest = [x for x in _written[since:] if but is not None and x[1] == but.stashed_at]
    mine = [x for x in _written[since:] if x not in rest]
    _written[since:] = rest
    for spark, path in mine:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit
            return


atexit.register(drop_stash)


#: In a Python worker: how to drop what each operator keeps between tasks.
_kept: dict[str, Callable[[], None]] = {}


def keep(name: str, drop: Callable[[], None]) -> None:
    """Tells that an operator keeps something in this Python worker, and how to drop it."""
    _kept[name] = drop


def drop_kept(but: str = "") -> None:
    """Drops what other operators keep in this Python worker, which later stages use as well, and gives free memory back.

    Called as a task begins.
    """
    for name in [n for n in _kept if n != but]:
        _kept.pop(name)()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def fresh() -> str:
    """A column name that no table has."""
    return f"_{uuid.uuid4().hex}"


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str, n: str, total: int, salt: str = "") -> DataFrame:
    """Join ``rows`` with ``table``, which has one row per ``key`` and in column ``n`` how many of the ``total`` rows have that key.

    Keys of at least total/HOT_SHARE rows (at most HOT_SHARE keys), and LEAST_HOT, are joined by broadcast, so that no task gets all
    rows of a hot key; the others by a shuffle in which no key exceeds that share. Where rows of the table have no bound
    of size, ``salt`` names a column of ``rows``: hot keys are then joined by a shuffle too, dealt by it to SALTS copies
    of the table's row. A table of at most SMALL rows is broadcast whole otherwise. ``how`` is inner or left; null keys
    match nothing. ``table`` should be stashed, as it is read three times.
    """
    if not salt and table.count() <= SMALL:
        return rows.join(F.broadcast(table), key, how)
    least = max(total // HOT_SHARE, LEAST_HOT)
    hot, cold = table.filter(F.col(n) >= least), table.filter(F.col(n) < least)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    if not salt:
        return rows.join(F.broadcast(hot), key, "inner").unionByName(others)
    s = fresh()
    copies = hot.withColumn(s, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    some = rows.join(F.broadcast(hot.select(key)), key, "left_semi").withColumn(s, F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return some.join(copies, [key, s], "inner").drop(s).unionByName(others)


def rows_with(docs: DataFrame, id_col: str, ids: DataFrame, n: int, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` with (left_semi) or without (left_anti) one of ``ids``, a table of one column and at most
    ``n`` rows; a null id equals a null id. Texts are not shuffled if the ids are few enough to broadcast."""
    name = fresh()
    ids = ids.toDF(name)
    return docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, F.col(f"`{id_col}`").eqNullSafe(F.col(name)), how)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, component) for every node with an edge; component is the smallest node that can be reached.

    Alternating large-star and small-star rounds over stashed edge tables; nothing is collected but counts.
    Null ends and self-loops are ignored; repeated edges count once; an empty table gives an empty result.
    """
    e = stash(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour of u points to the least of u and its neighbours
        s, least = _star(both)
        large = stash(s.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        release(least)
        # small star: u and its smaller neighbours point to the least of them
        s, least = _star(large)
        nxt = stash(s.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(s.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        done = _same(e, nxt)
        release(least, large, e)
        if done:
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(nxt.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        e = nxt


def _star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each edge (u, v) with m, the least of u and u's neighbours; and the stashed table of these."""
    m = stash(e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("deg")))
    return lookup(e, m, "u", "inner", "deg", m.agg(F.sum("deg")).head()[0] or 0), m


def _same(a: DataFrame, b: DataFrame) -> bool:
    mark = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    return a.agg(*mark).head() == b.agg(*mark).head()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
