"""Operators whose behaviour SQL doesn't show: transactions, retries, resumed work, ratings, chunks, skewed order."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import arena, dataset, joins, textsim, transactions
from quern.sources import readers, sinks


def test_versions(spark, tmp_path):
    v = transactions.Versions(spark, f"file:{tmp_path}/t")
    for n in (1, 2, 3):
        v.commit(spark.range(n))
    assert v.read().count() == 3 and v.undo() and v.read().count() == 2
    v.commit(spark.range(9))
    assert v.read().count() == 9 and v.undo() and v.undo() and v.read().count() == 1 and not v.undo()


def test_database_errors(spark, tmp_path):
    db = transactions.Database(spark, f"file:{tmp_path}")
    db.create("t", spark.createDataFrame([(1, "a"), (2, None)], "k int, s string"))
    assert db.execute("-- nothing; DROP TABLE t") == 1 and db.execute("DELETE FROM t WHERE nope = 1") == 1
    assert db.execute("UPDATE t SET s = concat(s, 'x') WHERE k < 5") == 0
    assert [r["s"] for r in db.table("t").orderBy("k").collect()] == ["ax", None]
    db.rollback()
    assert db.fetch("SELECT count(*) AS n FROM t").head()["n"] == 2 and db.fetch("SELECT nope") is None


def test_retries():
    seen = []

    def fails_twice():
        seen.append(1)
        if len(seen) < 3:
            raise OSError
        return "ok"

    assert transactions.retried(fails_twice, sleep=lambda s: None) == "ok"
    with pytest.raises(OSError):
        transactions.retried(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=lambda s: None)


def test_resume_computes_the_rest_only(spark, tmp_path):
    work, seen = spark.range(8).select("id", (F.col("id") % 4).alias("c")), []

    def compute(df):
        seen.append(df.count())
        return df

    path = f"file:{tmp_path}/out"
    sinks.checkpointed(spark, work.filter("c < 3"), path, "c", compute)
    assert sinks.checkpointed(spark, work, path, "c", compute).count() == 8 and seen == [6, 2]


def test_bradley_terry_recovers_strengths(spark):
    rng, strength = random.Random(1), {"a": 1.0, "b": 0.0, "c": -1.0}
    rows = []
    for _ in range(6000):
        x, y = rng.sample("abc", 2)
        won = rng.random() < 1 / (1 + np.exp(strength[y] - strength[x]))
        rows.append((x, y, arena.A_WINS if won else arena.B_WINS))
    got = dict(arena.bradley_terry(arena.win_matrix(spark.createDataFrame(rows, "a string, b string, rating string"))).collect())
    assert abs(got["a"] - got["b"] - 400 / np.log(10)) < 25 and got["b"] > got["c"] and abs(np.mean(list(got.values())) - 1000) < 1e-6


def test_many_agents_are_fitted_by_pairs(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"g{rng.randrange(40)}", f"g{rng.randrange(40)}", rng.randint(1, 9)) for _ in range(600)]
    wins = spark.createDataFrame(rows, "a string, b string, w long")
    dense = dict(arena.bradley_terry(wins, c=0.7).collect())
    monkeypatch.setattr(arena, "DENSE", 5)
    assert dict(arena.bradley_terry(wins, c=0.7).collect()) == pytest.approx(dense, abs=1e-5)


def test_elo_of_unknown_rating_raises(spark):
    bad = spark.createDataFrame([(1, "x", "y", "Won", 0)], "seq long, a string, b string, rating string, pool int")
    with pytest.raises(Exception, match="unexpected rating"):
        arena.online_elo(bad, "seq", "pool").collect()


def test_chunks_join_to_the_text(spark):
    texts = ["", "abc", "x" * 1000, "añb" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in dataset.fixed_chunks(df, "t", 7, "i").orderBy("i", "chunk_id").collect():
        got[r["i"]] = got.get(r["i"], "") + r["chunk"]
    assert got == {k: t for k, t in enumerate(texts) if t}
    assert " ".join(dataset.cut_by_meaning("A cat sat. A cat ran. Stocks fell today. Stocks rose.", 30)) == "A cat sat. A cat ran. Stocks fell today. Stocks rose."
    assert len(dataset.cut_by_meaning("A cat sat. A cat ran. Stocks fell today. Stocks fell.", 30)) == 2


def test_distractors_differ(spark):
    at = spark.range(11).select(F.col("id").alias("pos"))
    rows = dataset.distractors(at, 4).filter("rank < 4").groupBy("pos").agg(F.collect_set("other").alias("o")).collect()
    assert len(rows) == 11 and all(len(r["o"]) == 4 and r["pos"] not in r["o"] for r in rows)
    with pytest.raises(ValueError):
        dataset.distractors(at, 11)


def test_numbered_is_a_total_order(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"))
    got = joins.numbered(df, "pos", "k").orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1, 501)) and [r["k"] for r in got] == list(range(500))


def test_bleu_as_columns_equals_the_local_one(spark):
    from quern.functions import similarity as S

    rng = random.Random(3)
    words = lambda: [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
    rows = [(k, [words(), words()], words()) for k in range(40)]
    df = spark.createDataFrame(rows, "pair_id int, refs array<array<string>>, hyp array<string>")
    for method in (0, 1, 2, 3, 4, 5):
        got = {r["pair_id"]: r["bleu"] for r in textsim.bleu(df, method).collect()}
        for k, refs, hyp in rows:
            assert got[k] == pytest.approx(S.bleu([(refs, hyp)], method=method), abs=1e-12), (method, k)
    assert textsim.bleu(df, corpus=True).head()["bleu"] == pytest.approx(S.bleu([(r, h) for _, r, h in rows]))


def test_reading_needs_fields(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"user_name": "u"}]')
    with pytest.raises(ValueError, match="lack"):
        readers.api_documents(spark, f"file:{tmp_path}/a.json")


def test_unknown_column(spark):
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        joins.keep_columns(spark.range(1), ["nope"])


def test_statements_read_tables_as_they_are(spark, tmp_path):
    db = transactions.Database(spark, f"file:{tmp_path}")
    db.create("t", spark.createDataFrame([(1, "a"), (2, None)], "k int, s string"))
    db.create("u", spark.createDataFrame([(2, "b")], "k int, s string"))
    assert db.execute("SELECT * FROM t") == 0 and db.execute("SELECT * FROM nope") == 1
    assert db.execute("DELETE FROM t WHERE k = 1; INSERT INTO t SELECT k + 10, (SELECT max(s) FROM u) FROM t; INSERT INTO u SELECT t.k, 'from t' FROM t JOIN u ON t.k = u.k") == 0
    assert sorted(map(tuple, db.table("t").collect())) == [(2, None), (12, "b")] and db.table("u").count() == 2
    assert transactions.Database(spark, f"file:{tmp_path}").table("t").count() == 2  # not committed yet: the old rows
    assert transactions.Database(spark, f"file:{tmp_path}").table("u").count() == 1
    db.commit()
    assert transactions.Database(spark, f"file:{tmp_path}").table("u").count() == 2
    log = spark.read.json(f"file:{tmp_path}/commits").filter("seq = 2")
    assert sorted(r["name"] for r in log.collect()) == ["t", "u"] and len(log.inputFiles()) == 3
    assert not [x for x in spark.catalog.listTables() if x.name in "tu"]


def test_late_chunk_opens_no_second_job(spark, tmp_path):
    from quern.streaming import feed

    schema, at = "job long, seq int, text string, ts timestamp", "2024-01-01 00:{:02d}:00"
    batches = [[(1, 0, "x", 0), (2, 0, "y", 0)], [(9, 0, "", 5)], [(9, 1, "", 6)], [(1, 1, "late", 7), (2, 1, "", 7)], [(9, 2, "", 20)], [(1, 2, "later", 21)], [(9, 3, "", 40)]]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(j, s, t, at.format(m)) for j, s, t, m in rows], "job long, seq int, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.parquet(f"file:{tmp_path}/in{k}")
    import glob
    import os
    import shutil

    os.makedirs(tmp_path / "all")
    for k in range(len(batches)):
        part = glob.glob(f"{tmp_path}/in{k}/part*")[0]
        shutil.copy(part, tmp_path / "all" / f"{k}.parquet")
        os.utime(tmp_path / "all" / f"{k}.parquet", (1e9 + k, 1e9 + k))
    got = feed.drained(feed.timed_out(feed.files(spark, f"file:{tmp_path}/all", "*.parquet", schema, per_batch=1)))
    assert sorted((r["job"], r["text"], r["complete"]) for r in got.filter("job < 9").collect()) == [(1, "x", False), (2, "y", False)]


def test_bm25_plus_answers_unknown_words(spark):
    from quern.operators import retrieval

    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", "b c", "d"])], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "b"), (2, "nope")], "query_id long, text string")
    for plus in (True, False):
        got = retrieval.bm25(docs, asked, 2, plus).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["doc_id"]) for r in got if r["query_id"] == 2] == [(2, 0), (2, 1)] and len(got) == 4


def test_bm25_prefers_no_match_to_a_negative_one(spark):
    """Words that most documents have weigh less than nothing, if most words are such; beyond the first documents too."""
    from quern.operators import retrieval

    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a c"] * 5 + ["d"])], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert [(r["doc_id"], r["score"]) for r in retrieval.bm25(docs, asked, 1).collect()] == [(5, 0.0)]


def test_bm25_writes_no_pairs_of_queries_and_documents(spark, monkeypatch):
    from quern.operators import retrieval

    written, write = [], retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df: written.append(write(df)) or written[-1])
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("x y w"), F.col("id") % 7).alias("text"))
    asked = spark.range(30).select(F.col("id").alias("query_id"), F.concat(F.lit("x w"), F.col("id") % 7).alias("text"))
    for plus in (False, True):
        got = retrieval.bm25(docs, asked, 3, plus).collect()
        assert len(got) == 90 and all(r["doc_id"] == r["query_id"] % 7 + 7 * (r["rank"] - 1) for r in got)
    assert max(t.count() for t in written) < 200


def test_bm25_in_parts(spark, monkeypatch):
    """Queries, matrices, texts and documents in parts of any size, and ids that are texts, give the same hits."""
    from quern.operators import retrieval

    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefg") + rng.choice("hi_J") for _ in range(rng.randint(0, 9)))
    docs = spark.createDataFrame([(f"d{k:03}", text() if k % 9 else None) for k in range(90)], "doc_id string, text string").repartition(3)
    asked = spark.createDataFrame([(f"q{k}", text()) for k in range(20)] + [("none", None)], "query_id string, text string")
    for plus in (False, True):
        whole = sorted(tuple(r) for r in retrieval.bm25(docs, asked, 4, plus).collect())
        with monkeypatch.context() as m:
            m.setattr(retrieval, "MATRIX_CELLS", 40)
            m.setattr(retrieval, "SLICE_BYTES", 50)
            assert sorted(tuple(r) for r in retrieval.bm25(docs, asked, 4, plus, block=9).collect()) == whole and len(whole) == 84


def test_equal_rows_of_batches_share_a_call(spark, monkeypatch):
    """Within a task's memory, and with the right rows where it overflows; nulls give null."""
    import pyarrow as pa

    from quern.operators import decoding

    calls = spark.sparkContext.accumulator(0)

    def one(*x):
        calls.add(1)
        return "-".join(map(str, x))

    monkeypatch.setattr(decoding, "REMEMBERED", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        for m in (10, 300):
            before = calls.value
            df = spark.range(0, 400, 1, 1).select("id", F.when(F.col("id") % 9 > 0, (F.col("id") % m).cast("string")).alias("s"), (F.col("id") % m).alias("n"))
            got = df.select("id", decoding.rowwise(one, "string", pa.string())("s").alias("a"), decoding.rowwise(one, "string", pa.string())("s", "n").alias("b")).collect()
            assert all((r["a"], r["b"]) == ((str(r["id"] % m), f"{r['id'] % m}-{r['id'] % m}") if r["id"] % 9 else (None, None)) for r in got) and len(got) == 400
            assert m > 10 or calls.value - before == 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_vendor_calls_are_read_in_one_scan(spark):
    from quern.plans import QUERIES

    plan = QUERIES["dec_vendor"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_training_rows_move_texts_twice(spark, monkeypatch):
    """Chunks are numbered by their keys alone: no text is written, or shuffled to be numbered."""
    written, write = [], joins.materialize
    monkeypatch.setattr(joins, "materialize", lambda df: written.append(df.columns) or write(df))
    chunks = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_id"), F.concat(F.lit("text "), "id").alias("chunk"), F.concat(F.lit("q"), "id").alias("question"))
    rows = dataset.training_rows(chunks, 3, 0.5).collect()
    assert written and all("chunk" not in columns for columns in written)
    assert sorted(r["pos"] for r in rows) == list(range(40)) and 0 < sum(r["oracle"] for r in rows) < 40
    for r in rows:
        assert len(set(r["docs"])) >= 3 and (r["chunk"] in r["docs"]) == r["oracle"] and len(r["docs"]) == 4
        assert r["chunk"] == f"text {r['pos']}" and r["instruction"] == "".join(f"<DOCUMENT>{d}</DOCUMENT>\n" for d in r["docs"]) + f"q{r['pos']}"


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from quern import session

    class Elsewhere:
        conf = spark.conf
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(Elsewhere)
    assert session.shared_folder(spark)


def test_equal_rows_share_one_call(spark):
    import pyarrow as pa

    from quern.operators import decoding

    calls = spark.sparkContext.accumulator(0)

    def f(x, y):
        calls.add(1)
        return {"x": x, "n": len(y)}

    one = decoding.rowwise(f, "struct<x:bigint,n:bigint>", pa.struct([("x", pa.int64()), ("n", pa.int64())]))
    rows = [(k, k % 3 or None, ["a"] * (k % 2)) for k in range(600)]
    df = spark.createDataFrame(rows, "k long, x long, y array<string>").coalesce(1)
    got = df.select("k", "x", "y", one(F.col("x"), F.col("y")).alias("r")).collect()
    assert all((r["r"] is None) if r["x"] is None else (r["r"]["x"], r["r"]["n"]) == (r["x"], len(r["y"])) for r in got) and len(got) == 600
    assert calls.value == 4


def test_tasks_grow_with_the_files(spark, tmp_path):
    from quern.session import spread

    spark.range(200_000).selectExpr("id", "md5(cast(id as string)) AS t").coalesce(1).write.parquet(f"file:{tmp_path}/x")
    df = spark.read.parquet(f"file:{tmp_path}/x")
    assert spread(df, 1 << 20).rdd.getNumPartitions() > spread(df, 1 << 30).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(df, 1 << 20).agg(F.sum("id")).head()[0] == 199_999 * 100_000


def test_one_replay_gives_outcomes_and_state(spark):
    from quern.operators import decoding as D

    calls = F.array(F.lit("fillFuelTank(fuelAmount=3)"), F.lit("nothing()"))
    config = F.lit('{"vehicle": {"fuelLevel": 5.0}}')
    r = spark.range(1).select(D.replayed_with_state(["vehicle"], config, calls).alias("r"), D.replayed(["vehicle"], config, calls).alias("o"), D.state_after(["vehicle"], config, calls).alias("s")).head()
    assert (r["r"]["outcomes"], r["r"]["state"]) == (r["o"], r["s"]) and '"fuelLevel": 8.0' in r["s"]


def test_a_stream_reads_a_folder_of_files(spark, tmp_path):
    from quern.streaming import feed

    spark.range(10).selectExpr("id AS doc_id", "'a b c' AS text").repartition(3).write.parquet(f"file:{tmp_path}/documents.parquet")
    docs = feed.files(spark, f"file:{tmp_path}", "documents.parquet", "doc_id long, text string")
    got = feed.drained(feed.token_steps(docs, "doc_id"))
    assert sorted((r["doc_id"], r["step"], r["delta"]) for r in got.collect()) == [x for k in range(10) for x in ((k, 0, "a b"), (k, 1, " c"))]


def test_a_job_holds_no_rows_after_its_end(spark, tmp_path):
    """50,000 ends of one job, in batches of 100 rows: the Python process never holds them all."""
    from quern.streaming import feed

    rows = spark.range(50_000).selectExpr("9L AS job", "cast(id AS int) AS seq", "CASE WHEN id = 3 OR id > 100 THEN '' ELSE cast(id AS string) END AS text", "timestamp'2024-01-01' AS ts")
    rows.repartition(1).write.parquet(f"file:{tmp_path}/x.parquet")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = feed.drained(feed.timed_out(feed.files(spark, f"file:{tmp_path}", "x.parquet", "job long, seq int, text string, ts timestamp")))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert [(r["job"], r["text"], r["n"], r["complete"]) for r in got.collect()] == [(9, "012", 3, True)]


def test_str_tokens_of_a_folder_with_null_and_empty_texts(spark, tmp_path):
    import duckdb

    from quern.plans import ORACLE_SQL, QUERIES

    rows = [(1, "a b c"), (2, None), (3, ""), (4, " x  y "), (5, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars").repartition(2).write.parquet(f"file:{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL["str_tokens"]).fetchall()
    got = QUERIES["str_tokens"](spark, str(tmp_path)).select("doc_id", "steps", "first", "last", "whole").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_bleu_counts_pairs_in_their_rows(spark):
    refs = [["a", "b", "a", "b"], None, ["x"] * 50 + ["a", "b", "c"]]
    rows = [(1, refs, ["a", "b", "c", "a", "a"]), (2, [None], ["a"]), (3, [["a"]], None), (4, [], []), (5, [["a"], ["a", "a"]], ["a", "a", "a"])]
    df = spark.createDataFrame(rows, "pair_id int, refs array<array<string>>, hyp array<string>")
    x = textsim.precisions(df)
    assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()
    got = {(r["pair_id"], r["n"]): (r["matched"], r["total"]) for r in x.collect()}
    assert len(got) == 20
    assert [got[1, n] for n in (1, 2, 3, 4)] == [(4, 5), (2, 4), (1, 3), (0, 2)]
    assert [got[2, 1], got[3, 1], got[4, 1], got[5, 1], got[5, 2], got[5, 4]] == [(0, 1), (0, 1), (0, 1), (2, 3), (1, 2), (0, 1)]
