"""Retrieval queries: ``benchmark`` asks, ``documents`` and ``embeddings`` answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import retrieval as R
from quern.plans.registry import query

OKAPI_WORDS = "string_split(text, ' ')"
PLUS_WORDS = r"list_filter(regexp_split_to_array(replace(lower(text), '_', ' '), '[ \t\n\r\f\v]+'), lambda x: x <> '')"


#: The test items, one of them with an unknown word, and a question of unknown words only.
ASKED = "SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT -1, 'zyzzyva zyzzyva' UNION ALL SELECT -2, (SELECT min(text) FROM benchmark) || ' zyzzyva'"


def bm25_sql(words: str, plus: bool, k: int) -> str:
    idf = "ln((n + 1) / df)" if plus else "CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END"
    add = "+ coalesce((SELECT sum(qtf * i2.idf) FROM q q2 JOIN i i2 USING (term) WHERE q2.query_id = s.query_id), 0)" if plus else ""
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
b AS ({ASKED}), q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({words}) AS term FROM b) GROUP BY ALL),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, ln(max(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term), mn AS (SELECT avg(raw) AS mean FROM df),
i AS (SELECT term, {idf} AS idf FROM df, st, mn),
s AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN i USING (term) JOIN q USING (term), st GROUP BY ALL),
r AS (SELECT s.query_id, s.doc_id, round(coalesce(p.score, 0) {add}, 6) AS score FROM (SELECT query_id, doc_id FROM b, d) s LEFT JOIN s p USING (query_id, doc_id))
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= {k}"""


def asked(t):
    b = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    least = t.benchmark.agg(F.lit(-2).cast("long").alias("query_id"), F.concat(F.min("text"), F.lit(" zyzzyva")).alias("text"))
    more = t.spark.range(1).select(F.lit(-1).cast("long").alias("query_id"), F.lit("zyzzyva zyzzyva").alias("text")).unionByName(least)
    return b.unionByName(more)


def hits(t, plus: bool, k: int):
    return R.bm25(t.documents.select("doc_id", "text"), asked(t), k, plus)


@query("bm25_okapi", bm25_sql(OKAPI_WORDS, False, 5))
def bm25_okapi(t):
    return hits(t, False, 5)


@query("bm25_plus", bm25_sql(PLUS_WORDS, True, 5))
def bm25_plus(t):
    return hits(t, True, 5)


@query("ret_augment", f"SELECT b.query_id, md5(b.text || coalesce(string_agg(chr(10) || 'API ' || (rank - 1) || ': ' || d.text, '' ORDER BY rank), '')) AS prompt FROM ({ASKED}) b LEFT JOIN ({bm25_sql(PLUS_WORDS, True, 3)}) h USING (query_id) LEFT JOIN documents d USING (doc_id) GROUP BY b.query_id, b.text")
def ret_augment(t):
    return R.augmented(asked(t), hits(t, True, 3), t.documents.select("doc_id", "text")).withColumn("prompt", F.md5("prompt"))


@query("udf_retriever", """WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents),
s AS (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM q JOIN d USING (w) WHERE w <> '' GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 3""")
def udf_retriever(t):
    """A retriever that a user adds: documents by the number of distinct words that they share with the query."""

    def shared_words(docs, queries, k):
        words = lambda df, key: df.select(key, F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w")).filter("w <> ''")
        scored = words(docs, "doc_id").join(F.broadcast(words(queries, "query_id")), "w").groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score"))
        return R.top_k(scored, "query_id", "score", "doc_id", k)

    R.RETRIEVERS["shared_words"] = shared_words
    return R.retrieved("shared_words", t.documents.select("doc_id", "text"), t.benchmark.select(F.col("item_id").alias("query_id"), "text"), 3)


NORM_SQL = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v)"


def vector_sql(table: str, k: int) -> str:
    return f"WITH {NORM_SQL}, s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(q.e, c.e), 9) AS score FROM {table} q, {table} c WHERE q.vec_id % 20 = 0) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= {k}"


def vector_queries(t):
    return t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("cos_topk", vector_sql("u", 5))
def cos_topk(t):
    return R.vector_top_k(t.embeddings, vector_queries(t), 5)


@query("ip_topk", vector_sql("u", 3))
def ip_topk(t):
    unit = lambda df, key: df.select(key, R.normalized(F.col("embedding")).alias("embedding"))
    return R.vector_top_k(unit(t.embeddings, "vec_id"), unit(vector_queries(t), "query_id"), 3, cosine=False)


@query("join_sim", vector_sql("u", 1))
def join_sim(t):
    return R.vector_top_k(t.embeddings, vector_queries(t), 1)


@query("vec_norm", f"WITH {NORM_SQL} SELECT vec_id, round(e[1], 9) AS first, round(list_sum(list_transform(e, lambda x: x * x)), 9) AS length2 FROM u")
def vec_norm(t):
    u = t.embeddings.select("vec_id", R.normalized(F.col("embedding")).alias("e"))
    return u.select("vec_id", F.round(F.col("e")[0], 9).alias("first"), F.round(R.dot(F.col("e"), F.col("e")), 9).alias("length2"))


@query("idx_build", f"WITH {NORM_SQL} SELECT u.vec_id, label, round(e[2], 9) AS second FROM u JOIN embeddings USING (vec_id)")
def idx_build(t):
    from quern.session import materialize

    index = materialize(t.embeddings.select("vec_id", "label", R.normalized(F.col("embedding")).alias("unit")))
    return index.select("vec_id", "label", F.round(F.col("unit")[1], 9).alias("second"))
