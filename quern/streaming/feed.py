"""Streams of executions: rates in sliding windows, agents that fail most, the newest rows, sessions that time out.

Late rows: the watermark says how late a row may be; rows that come later are dropped, and counted by the engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.session import shared_folder

LATE, WINDOW, SLIDE = "10 minutes", "30 minutes", "5 minutes"
TIMEOUT_MS = 90_000
#: How long, in event time, a job that was closed stays known, so that a later chunk of it opens no second one.
CLOSED_MS = 86_400_000


def files(spark: SparkSession, folder: str, name: str, schema: str, per_batch: int = 1000) -> DataFrame:
    """A stream of the files of a folder with that name, or of those in a folder of that name, in batches of so many files."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.globStatus(path)
    if found and any(f.isDirectory() for f in found):
        return r.parquet(f"{folder}/{name}")
    return r.option("pathGlobFilter", name).parquet(folder)


def drained(stream: DataFrame, mode: str = "append", merge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All that a stream gives until it has read what there is, as a table in the shared folder.

    Batches are written with their number; a batch that runs again writes the same folder. ``merge`` makes one table
    of the batches (column ``_batch``) of the modes update and complete.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def put(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows/_batch={n}")

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put).start()
    q.awaitTermination()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/rows/_batch=-1")
    got = spark.read.schema(schema.add("_batch", "long")).parquet(f"{path}/rows")
    return merge(got) if merge else got.drop("_batch")


def last_batch(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """Of each key the row of its last batch."""

    def merge(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys and c != "_batch"]
        return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row")).select(*keys, "_row.*")

    return merge


def token_steps(texts: DataFrame, key: str, text: str = "text", every: int = 2) -> DataFrame:
    """(key, step, delta): what a client that shows a text as it is made gets, ``every`` tokens at a time.

    Tokens are what single spaces divide, with the space before them; the deltas of a key join to its text. A null text
    has no step.
    """
    tokens = F.split(text, " ")
    steps = F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / every).cast("int"))
    delta = lambda s: F.concat(F.when(s > 0, " ").otherwise(""), F.array_join(F.slice(tokens, s * every + 1, every), " "))
    return texts.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.transform(steps, delta)).alias("step", "delta"))


def rates(events: DataFrame, at: str = "ts", ok: str = "ok", late: str = LATE, window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """(start, n, success_rate, fail_rate) in percent of each sliding window."""
    x = events.withWatermark(at, late).groupBy(F.window(at, window, slide).alias("w"))
    good = F.avg(F.col(ok).cast("int")) * 100
    return x.agg(F.count("*").alias("n"), good.alias("g")).select(F.col("w.start").alias("start"), "n", F.round("g", 6).alias("success_rate"), F.round(100 - F.col("g"), 6).alias("fail_rate"))


def failing(events: DataFrame, agent: str = "agent", ok: str = "ok") -> DataFrame:
    """(agent, failures) of a stream or a table."""
    return events.filter(~F.col(ok)).groupBy(agent).agg(F.count("*").alias("failures"))


def newest(rows: DataFrame, n: int = 50, at: str = "ts", tie: str = "event_id", errors_only: bool = False, ok: str = "ok") -> DataFrame:
    """The newest rows of a table; each task keeps n at most."""
    x = rows.filter(~F.col(ok)) if errors_only else rows
    return x.orderBy(F.desc(at), F.desc(tie)).limit(n)


def timed_out(chunks: DataFrame, key: str = "job", text: str = "text", at: str = "ts", timeout_ms: int = TIMEOUT_MS, late: str = "0 seconds", closed_ms: int = CLOSED_MS) -> DataFrame:
    """(job, text, n, complete): the text that each job streamed, closed by an empty chunk or when event time says that
    ``timeout_ms`` went by since its first chunk; what had come by then is kept, and what comes later is not.

    A job gives one row. That it was closed is kept until the watermark has passed its first chunk by ``timeout_ms`` and
    ``closed_ms``; an id that comes again after that is a new job.
    """

    def held(batches: Iterator[pd.DataFrame], start: int) -> list[tuple]:
        """The rows in order, up to the first that ends the job: what comes after it is dropped batch by batch."""
        rows: list[tuple] = []
        fresh = 0
        for b in batches:
            rows += zip(b[at].astype("datetime64[ms]").astype("int64"), b["seq"], b[text])
            fresh += len(b)
            if fresh >= len(rows) // 2:
                rows, fresh = cut(rows, start), 0
        return cut(rows, start)

    def cut(rows: list[tuple], start: int) -> list[tuple]:
        rows.sort(key=lambda r: (r[0], r[1]))
        first = start if start >= 0 or not rows else rows[0][0]
        end = next((k for k, (ms, _, t) in enumerate(rows) if t == "" or ms - first > timeout_ms), len(rows))
        del rows[end + 1 :]
        return rows

    def closed(state: GroupState, start: int) -> None:
        state.update(("", start, -1))
        state.setTimeoutTimestamp(max(start + timeout_ms + closed_ms, state.getCurrentWatermarkMs() + 1))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts, start, n = state.get if state.exists else ("", -1, 0)
        if state.hasTimedOut and n < 0:
            state.remove()
            return
        if state.hasTimedOut:
            closed(state, start)
            yield pd.DataFrame([(k[0], parts, n, False)], columns=["job", "text", "n", "complete"])
            return
        if n < 0:
            closed(state, start)
            return
        rows = held(batches, start)
        ended = False
        for ms, _, t in rows:
            start = ms if start < 0 else start
            if ended or ms - start > timeout_ms:
                ended = True
                continue
            if t == "":
                ended = None
                break
            parts, n = parts + t, n + 1
        if ended is not False:
            closed(state, start)
            yield pd.DataFrame([(k[0], parts, n, ended is None)], columns=["job", "text", "n", "complete"])
            return
        state.update((parts, start, n))
        state.setTimeoutTimestamp(max(start + timeout_ms, state.getCurrentWatermarkMs() + 1))

    kind = dict(chunks.dtypes)[key]
    x = chunks.select(F.col(key).alias("job"), at, "seq", text).withWatermark(at, late)
    return x.groupBy("job").applyInPandasWithState(step, f"job {kind}, text string, n long, complete boolean", "text string, start long, n long", "append", GroupStateTimeout.EventTimeTimeout)
