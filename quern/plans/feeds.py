"""Streams over ``events``, and reversible changes."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from quern.operators import decoding, tools, transactions
from quern.plans.registry import query
from quern.session import shared_folder
from quern.streaming import feed

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


#: Jobs below zero that the rows of str_timeout far ahead of the others belong to.
MARKS = 1024


def executions(t):
    """A stream of events as executions: agent, ok, ts."""
    x = feed.files(t.spark, t.sf_dir, "events.parquet", EVENTS)
    return x.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("agent"), (F.col("user_id") % 9).cast("string")).alias("agent"), (F.col("event_type") != "error").alias("ok"))


NEWEST = "SELECT event_id, 'agent' || (user_id % 9) AS agent FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50"


@query("str_exec", NEWEST)
def str_exec(t):
    return feed.newest(feed.drained(executions(t)), 50, errors_only=True).select("event_id", "agent")


@query("topk_recent", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def topk_recent(t):
    return feed.newest(t.events, 50).select("event_id")


@query("str_rate30", "SELECT start, count(*) AS n, round(avg((event_type <> 'error')::INT) * 100, 6) AS success_rate, round(100 - avg((event_type <> 'error')::INT) * 100, 6) AS fail_rate FROM (SELECT event_type, unnest([time_bucket(INTERVAL 5 MINUTES, ts, TIMESTAMP '1970-01-01') - INTERVAL (5 * k) MINUTES FOR k IN range(0, 6)]) AS start FROM events) GROUP BY start")
def str_rate30(t):
    got = feed.drained(feed.rates(executions(t)), "update", feed.last_batch("start"))
    return got.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str_topfail", "SELECT 'agent' || (user_id % 9) AS agent, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY 1")
def str_topfail(t):
    return feed.drained(feed.failing(executions(t)), "complete", feed.last_batch("agent"))


@query("str_late", "SELECT count(*) AS n FROM events")
def str_late(t):
    """Within one batch nothing is late: the watermark moves between batches."""
    seen = feed.drained(executions(t).withWatermark("ts", feed.LATE).dropDuplicatesWithinWatermark(["event_id"]))
    return seen.agg(F.count("*").alias("n"))


@query("str_timeout", "SELECT user_id AS job, count(*) AS n, false AS complete FROM events WHERE user_id % 2 = 1 GROUP BY user_id UNION ALL SELECT user_id, count(*), true FROM events WHERE user_id % 2 = 0 GROUP BY user_id")
def str_timeout(t):
    """Jobs stream chunks at the same moment; even jobs also an end. Those without one are closed by the watermark, which a row far ahead of the others moves."""
    e = feed.files(t.spark, t.sf_dir, "events.parquet", EVENTS)
    start = F.lit("2024-01-01").cast("timestamp")
    last = F.lit("2024-01-02").cast("timestamp")
    ends = F.when(F.col("user_id") % 2 == 0, F.array(F.struct(F.col("user_id").alias("job"), F.lit(1).alias("seq"), F.lit("").alias("text"), start.alias("ts"))))
    own = F.array(F.struct(F.col("user_id").alias("job"), F.lit(0).alias("seq"), F.lit("x").alias("text"), start.alias("ts")))
    far = (-1 - F.pmod(F.xxhash64("event_id"), F.lit(MARKS))).alias("job")  # the rows far ahead are dealt to many jobs
    mark = F.array(F.struct(far, F.lit(0).alias("seq"), F.lit("").alias("text"), last.alias("ts")))
    rows = e.select(F.explode(F.concat(own, F.coalesce(ends, F.slice(own, 1, 0)), mark)).alias("r")).select("r.*")
    got = feed.drained(feed.timed_out(rows, "job"))
    return got.filter("job >= 0").select("job", "n", "complete")


def folder(t) -> str:
    return f"{shared_folder(t.spark)}/tx-{uuid.uuid4().hex}"


@query("tx_sql", "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal, 0 AS status FROM supplier WHERE s_suppkey <> 3 UNION ALL SELECT -1, 0.5, 0 UNION ALL SELECT s_suppkey + 1000000, s_acctbal, 0 FROM supplier WHERE s_nationkey = 7 AND s_suppkey <> 3")
def tx_sql(t):
    db = transactions.Database(t.spark, folder(t))
    db.create("supplier", t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal"))
    status = db.execute("UPDATE supplier SET s_acctbal = s_acctbal + 1 WHERE s_nationkey < 5; DELETE FROM supplier WHERE s_suppkey = 3; INSERT INTO supplier VALUES (-1, 0, 0.5); SELECT count(*) FROM supplier; INSERT INTO supplier SELECT s_suppkey + 1000000, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey = 7 AND s_suppkey <> 3")
    db.commit()
    db.execute("DELETE FROM supplier")
    db.rollback()
    return db.table("supplier").select("s_suppkey", "s_acctbal", F.lit(status).alias("status"))


@query("tx_undo", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def tx_undo(t):
    v = transactions.Versions(t.spark, folder(t))
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    for df in (n, n.filter("n_regionkey = 1"), n.filter("n_regionkey = 2"), n.limit(0)):
        v.commit(df)
    v.undo()
    v.undo()
    return v.read().select("n_nationkey", "n_name")


@query("tx_fs", "SELECT 'r' || n_regionkey || '/' || n_name || '.txt' AS path, md5(n_name || chr(10) || n_nationkey) AS content, CASE WHEN n_nationkey % 3 = 0 THEN 'changed' ELSE 'kept' END AS was FROM nation")
def tx_fs(t):
    """Files of a first version, after some were changed, some removed and one added, and all that undone."""
    f = transactions.Folder(t.spark, folder(t), folder(t))
    first = t.nation.select(F.concat(F.lit("r"), "n_regionkey", F.lit("/"), "n_name", F.lit(".txt")).alias("path"), F.concat("n_name", F.lit("\n"), "n_nationkey").alias("content"), "n_nationkey")
    f.write(first)
    f.commit()
    f.write(first.filter("n_nationkey % 3 = 0").withColumn("content", F.lit("other")))
    f.write(first.limit(1).select(F.lit("new.txt").alias("path"), "content"))
    was = f.changes().filter("change = 'changed'").select("path", "change").toLocalIterator()
    changed = [r["path"] for r in was]  # as many as were written above
    f.commit()
    f.undo()
    now = f.files().select("path", F.md5("content").alias("content"))
    return now.withColumn("was", F.when(F.col("path").isin(changed), "changed").otherwise("kept"))


@query("tx_retry", "SELECT event_id, least(user_id % 5 + 1, 4) AS attempts, user_id % 5 < 4 AS ok FROM events")
def tx_retry(t):
    """Calls that fail a number of times before they succeed; four attempts each."""

    def call(user: int) -> dict:
        tries = []

        def once() -> None:
            tries.append(1)
            if len(tries) <= user % 5:
                raise OSError("not yet")

        try:
            transactions.retried(once, attempts=4, errors=(OSError,), sleep=lambda s: None)
        except OSError:
            return {"attempts": len(tries), "ok": False}
        return {"attempts": len(tries), "ok": True}

    got = decoding.rowwise(call, "struct<attempts:bigint,ok:boolean>", pa.struct([("attempts", pa.int64()), ("ok", pa.bool_())]))
    return t.events.select("event_id", got(F.col("user_id")).alias("r")).select("event_id", "r.*")


@query("str_tokens", """WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, ceil(len(w) / 2)::BIGINT AS steps, array_to_string(w[1:2], ' ') AS first, CASE WHEN len(w) > 2 THEN ' ' ELSE '' END || array_to_string(w[len(w) - (len(w) + 1) % 2:], ' ') AS last, md5(array_to_string(w, ' ')) AS whole FROM d""")
def str_tokens(t):
    docs = feed.files(t.spark, t.sf_dir, "documents.parquet", "doc_id long, text string, lang string, source string, n_chars long")
    got = feed.drained(feed.token_steps(docs, "doc_id"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "delta"))), lambda x: x["delta"]), "")
    shown = got.groupBy("doc_id").agg(F.count("*").alias("steps"), F.min_by("delta", "step").alias("first"), F.max_by("delta", "step").alias("last"), F.md5(whole).alias("whole"))
    none = [F.lit(None).cast(dict(shown.dtypes)[c]).alias(c) for c in shown.columns[1:]]
    return shown.unionByName(t.documents.filter("text IS NULL").select("doc_id", *none))  # texts without a step


@query("tx_neg", "SELECT event_type AS forward, min_by(user_id::VARCHAR, event_id) FILTER (value >= 50) AS success, md5(string_agg(user_id::VARCHAR, ',' ORDER BY event_id) FILTER (value < 50)) AS failures FROM events GROUP BY event_type")
def tx_neg(t):
    log = t.events.select(F.col("event_type").alias("forward"), F.col("user_id").cast("string").alias("back"), (F.col("value") >= 50).alias("outcome"), F.col("event_id").alias("seq"))
    return transactions.reversals(log).withColumn("failures", F.md5(F.array_join("failures", ",")))


@query("tx_tree", "SELECT lang || '/' AS at, '    + ' || lang || '/' AS line FROM documents GROUP BY lang UNION ALL SELECT lang || '/' || source || '/', '        + ' || source || '/' FROM documents GROUP BY lang, source UNION ALL SELECT lang || '/' || source || '/' || doc_id, '            - ' || doc_id FROM documents")
def tx_tree(t):
    path = F.concat_ws("/", F.lit("/data"), "lang", "source", F.col("doc_id").cast("string"))
    return tools.tree_lines(t.documents.select(path.alias("path")), "path", "/data")
