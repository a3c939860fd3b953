"""Queries on evaluation results; ``events`` stands in for a result log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.functions import ids
from quern.operators import joins, scoring
from quern.plans.registry import Tables, query

CATEGORY = {"click": "simple_python", "error": "live_irrelevance", "purchase": "multi_turn_miss_func", "signup": "simple_javascript", "view": "memory_kv"}
SIZES = {"simple_python": 400, "live_irrelevance": 875, "multi_turn_miss_func": 200, "simple_javascript": 50, "memory_kv": 155, "live_relevance": 41, "web_search_base": 100, "simple_java": 100}
CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY.items()) + " END"
RESULTS = f"""results AS (SELECT event_id, ts, 'model_' || (user_id % 7) AS model, {CASE} AS category, value >= 50 AS valid, value AS latency,
  CAST(props->>'k' AS BIGINT) AS tokens, {CASE} || '_' || event_id AS id, 'cfg' || (event_id % 5) AS config FROM events)"""
SIZES_SQL = "sizes(category, size) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in SIZES.items()) + ")"
SCORES = f"WITH {RESULTS}, {SIZES_SQL}, acc AS (SELECT model, category, avg(valid::INT) AS accuracy, count(*) AS total_count FROM results GROUP BY ALL), full_ AS (SELECT m.model, s.category, coalesce(a.accuracy, 0) AS accuracy, coalesce(a.total_count, s.size) AS total_count, a.accuracy IS NULL AS is_na FROM (SELECT DISTINCT model FROM results) m CROSS JOIN sizes s LEFT JOIN acc a ON a.model = m.model AND a.category = s.category)"


def results(t: Tables):
    cat = F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv])[F.col("event_type")]
    e = t.events.withColumn("category", cat)
    return e.select(
        "event_id", "ts", F.concat(F.lit("model_"), (F.col("user_id") % 7).cast("string")).alias("model"), "category", (F.col("value") >= 50).alias("valid"), F.col("value").alias("latency"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.concat_ws("_", "category", F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("cfg"), (F.col("event_id") % 5).cast("string")).alias("config"),
    )


def sizes(t: Tables):
    return t.spark.createDataFrame(list(SIZES.items()), "category string, size long")


def scores(t: Tables):
    r = results(t)
    return scoring.with_missing(scoring.accuracy(r, "model", "category"), r, sizes(t))


LIKE = lambda *p: "(" + " OR ".join(f"contains(category, '{x}')" for x in p) + ")"
PREDICATE_SQL = {
    "is_format_sensitivity": LIKE("format_sensitivity"), "is_web_search": LIKE("web_search"), "is_memory": LIKE("memory"), "is_memory_prereq": LIKE("prereq"),
    "is_first_memory_prereq": LIKE("prereq") + " AND ends_with(category, '-0')", "is_agentic": LIKE("web_search", "memory"), "is_multi_turn": LIKE("multi_turn"), "is_live": LIKE("live"),
    "is_non_live": "NOT " + LIKE("format_sensitivity", "live", "multi_turn", "web_search", "memory"), "is_multi_turn_irrelevance": LIKE("miss_func", "miss_param"), "is_executable": LIKE("exec", "rest"),
    "is_rest": LIKE("rest"), "is_relevance": LIKE("relevance"), "is_chatable": LIKE("chatable"), "is_java": LIKE("java") + " AND NOT " + LIKE("javascript"), "is_js": LIKE("javascript"), "is_sql": LIKE("sql"),
    "is_interactive": LIKE("multi_turn", "web_search", "memory"),
}
GROUP_SQL = "CASE WHEN contains(category, 'format_sensitivity') THEN 'format_sensitivity' WHEN NOT " + LIKE("format_sensitivity", "live", "multi_turn", "web_search", "memory") + " THEN 'non_live' WHEN contains(category, 'live') THEN 'live' WHEN contains(category, 'multi_turn') THEN 'multi_turn' ELSE 'agentic' END"


@query("flt_category", f"WITH {RESULTS} SELECT category, count(*) AS n, " + ", ".join(f"bool_or({s}) AS {k}" for k, s in PREDICATE_SQL.items()) + " FROM results GROUP BY category")
def flt_category(t):
    c = F.col("category")
    return results(t).groupBy("category").agg(F.count("*").alias("n"), *[F.bool_or(p(c)).alias(k) for k, p in ids.PREDICATES.items()])


@query("prj_group", f"WITH {RESULTS} SELECT {GROUP_SQL} AS grp, count(*) AS n, sum(valid::INT)::BIGINT AS correct FROM results GROUP BY ALL")
def prj_group(t):
    return results(t).groupBy(ids.group_of(F.col("category")).alias("grp")).agg(F.count("*").alias("n"), F.sum(F.col("valid").cast("int")).alias("correct"))


FS_ID = "'format_sensitivity_' || event_id || ':ret_fmt=json&cfg=' || (event_id % 5) || ':' || id || '-5-1'"


@query("prj_idparts", f"WITH {RESULTS}, x AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {FS_ID} WHEN event_id % 3 = 1 THEN id ELSE replace(id, '_' || event_id, '_prereq_' || event_id) || '-2-3' END AS eid FROM results) "
       "SELECT event_id, eid, regexp_extract(split_part(eid, ':', 1), '^(.*)_[^_]*$', 1) AS category, regexp_extract(split_part(replace(eid, '_prereq', ''), ':', 1), '^(.*)_[^_]*$', 1) AS plain_category, CASE WHEN contains(eid, ':') THEN split_part(eid, ':', 2) ELSE 'default' END AS config, regexp_extract(split_part(eid, ':', 1), '_(\\d+)(?:-\\d+-\\d+)?$', 1)::INT AS idx FROM x")  # fmt: skip
def prj_idparts(t):
    e, i = F.col("event_id").cast("string"), F.col("id")
    fs = F.concat(F.lit("format_sensitivity_"), e, F.lit(":ret_fmt=json&cfg="), (F.col("event_id") % 5).cast("string"), F.lit(":"), i, F.lit("-5-1"))
    pre = F.concat(F.replace(i, F.concat(F.lit("_"), e), F.concat(F.lit("_prereq_"), e)), F.lit("-2-3"))
    x = F.when(F.col("event_id") % 3 == 0, fs).when(F.col("event_id") % 3 == 1, i).otherwise(pre)
    r = results(t).select("event_id", x.alias("eid"))
    c = F.col("eid")
    return r.select("event_id", "eid", ids.category_of(c).alias("category"), ids.category_of(c, True).alias("plain_category"), ids.config_of(c, "default").alias("config"), ids.index_of(c).alias("idx"))


@query("prj_fname", f"WITH {RESULTS}, f AS (SELECT DISTINCT 'out/' || model || '/V4_' || category || CASE WHEN event_id % 3 = 0 THEN '_score' WHEN event_id % 3 = 1 THEN '_result' ELSE '' END || '.json' AS name FROM results) SELECT name, regexp_extract(name, '.*V4_(\\w+?)(?:_score|_result)?\\.json', 1) AS category FROM f")
def prj_fname(t):
    kind = F.when(F.col("event_id") % 3 == 0, "_score").when(F.col("event_id") % 3 == 1, "_result").otherwise("")
    f = results(t).select(F.concat(F.lit("out/"), "model", F.lit("/V4_"), "category", kind, F.lit(".json")).alias("name")).distinct()
    return f.select("name", ids.file_category(F.col("name"), "V4").alias("category"))


@query("prj_expand", "WITH m(grp, category) AS (VALUES ('all', 'a'), ('all', 'b'), ('all', 'c'), ('live', 'b'), ('java', 'c')), asked(name) AS (VALUES ('live'), ('java'), ('d'), ('b')) SELECT DISTINCT coalesce(m.category, asked.name) AS category FROM asked LEFT JOIN m ON m.grp = asked.name")
def prj_expand(t):
    m = t.spark.createDataFrame([("all", "a"), ("all", "b"), ("all", "c"), ("live", "b"), ("java", "c")], "grp string, category string")
    asked = t.spark.createDataFrame([("live",), ("java",), ("d",), ("b",)], "name string")
    return joins.expand_groups(asked, m).orderBy("category")


@query("prj_columns", "SELECT doc_id, lang FROM documents")
def prj_columns(t):
    return joins.keep_columns(t.documents, ["doc_id", "lang"])


@query("prj_rename", "SELECT doc_id, lang || '<STOP>' AS completion, source AS prompt FROM documents")
def prj_rename(t):
    return t.documents.select("doc_id", F.concat("lang", F.lit("<STOP>")).alias("completion"), F.col("source").alias("prompt"))


@query("prj_firstelem", "SELECT doc_id, list_extract(CASE WHEN doc_id % 4 = 0 THEN [] ELSE string_split(source, 'c') END, 1) AS first FROM documents")
def prj_firstelem(t):
    arr = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.split("source", "c"))
    return t.documents.select("doc_id", F.get(arr, F.lit(0)).alias("first"))


@query("flt_nonempty", "SELECT doc_id, answer FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE lang END AS answer FROM documents) WHERE answer IS NOT NULL AND answer <> ''")
def flt_nonempty(t):
    a = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, "").otherwise(F.col("lang"))
    return t.documents.select("doc_id", a.alias("answer")).filter(F.col("answer").isNotNull() & (F.col("answer") != ""))


@query("flt_alpha", r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text || chr(10) || '123 ...', chr(10))) AS line FROM documents) WHERE regexp_matches(line, '\p{L}') GROUP BY doc_id")
def flt_alpha(t):
    lines = t.documents.select("doc_id", F.explode(F.split(F.concat("text", F.lit("\n123 ...")), "\n")).alias("line"))
    return lines.filter(F.col("line").rlike(r"\p{L}")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("flt_search", "SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'tion') OR contains(lower(coalesce(source, '')), 'src1') OR contains(lower(coalesce(lang, '')), 'tion')")
def flt_search(t):
    return joins.search(t.documents, "TION", "text", "lang").unionByName(joins.search(t.documents, "src1", "source")).select("doc_id").distinct()


@query("flt_agent3", "SELECT event_id FROM (SELECT event_id, user_id % 5 AS l, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (user_id + 1) % 5 END AS r, event_id % 7 AS s FROM events) WHERE coalesce(l = 3, false) OR coalesce(r = 3, false) OR coalesce(s = 3, false)")
def flt_agent3(t):
    e = t.events.select("event_id", (F.col("user_id") % 5).alias("l"), F.when(F.col("event_id") % 3 != 0, (F.col("user_id") + 1) % 5).alias("r"), (F.col("event_id") % 7).alias("s"))
    return joins.any_equals(e, F.lit(3), "l", "r", "s").select("event_id")


@query("flt_modneeded", "SELECT doc_id FROM labels WHERE NOT (toxic = 1)")
def flt_modneeded(t):
    return t.labels.filter(~(F.col("toxic") == 1)).select("doc_id")


@query("val_kv", "SELECT k, n, regexp_matches(k, '^[a-z]+(_[a-z0-9]+)*$') AND n = 1 AND length(k) <= 12 AS ok FROM (SELECT CASE WHEN user_id % 3 = 0 THEN event_type || '_' || user_id WHEN user_id % 3 = 1 THEN upper(event_type) ELSE event_type END AS k, count(*) AS n FROM events GROUP BY 1)")
def val_kv(t):
    u, e = F.col("user_id"), F.col("event_type")
    k = F.when(u % 3 == 0, F.concat_ws("_", e, u.cast("string"))).when(u % 3 == 1, F.upper(e)).otherwise(e)
    x = t.events.groupBy(k.alias("k")).agg(F.count("*").alias("n"))
    return x.withColumn("ok", F.col("k").rlike("^[a-z]+(_[a-z0-9]+)*$") & (F.col("n") == 1) & (F.length("k") <= 12))


@query("agg_accuracy", f"WITH {RESULTS} SELECT model, category, avg(valid::INT) AS accuracy, sum(valid::INT)::BIGINT AS correct_count, count(*) AS total_count FROM results GROUP BY ALL")
def agg_accuracy(t):
    return scoring.accuracy(results(t), "model", "category")


@query("agg_missing_na", f"{SCORES} SELECT model, category, round(accuracy, 8) AS accuracy, total_count, is_na, CASE WHEN is_na THEN 'N/A' ELSE category END AS shown FROM full_")
def agg_missing_na(t):
    return scores(t).select("model", "category", F.round("accuracy", 8).alias("accuracy"), "total_count", "is_na", F.when(F.col("is_na"), "N/A").otherwise(F.col("category")).alias("shown"))


@query("agg_weighted", f"{SCORES} SELECT model, round(sum(accuracy * total_count) / sum(total_count), 8) AS accuracy, sum(total_count)::BIGINT AS total_count, bool_or(is_na) AS is_na FROM full_ GROUP BY model")
def agg_weighted(t):
    return scoring.weighted(scores(t), "model").withColumn("accuracy", F.round("accuracy", 8))


@query("agg_unweighted", f"{SCORES} SELECT model, round(avg(accuracy), 8) AS accuracy, sum(total_count)::BIGINT AS total_count, bool_or(is_na) AS is_na FROM full_ GROUP BY model")
def agg_unweighted(t):
    return scoring.unweighted(scores(t), "model").withColumn("accuracy", F.round("accuracy", 8))


WEIGHT_SQL = f"{SCORES}, g AS (SELECT model, CASE WHEN contains(category, 'relevance') THEN 'irrelevance' ELSE {GROUP_SQL} END AS grp, avg(accuracy) AS accuracy, sum(total_count)::BIGINT AS total_count, bool_or(is_na) AS is_na FROM full_ GROUP BY ALL), w(grp, w) AS (VALUES ('non_live', 10), ('live', 10), ('irrelevance', 10), ('multi_turn', 30), ('agentic', 40)), o AS (SELECT model, sum(accuracy * w) / 100 AS accuracy, sum(total_count)::BIGINT AS total_count, bool_or(is_na) AS is_na FROM g JOIN w USING (grp) GROUP BY model)"


def overall(t: Tables):
    c = F.col("category")
    g = scores(t).withColumn("grp", F.when(ids.PREDICATES["is_relevance"](c), "irrelevance").otherwise(ids.group_of(c)))
    return scoring.percent_weighted(scoring.unweighted(g, "model", "grp"), scoring.OVERALL_WEIGHTS, "grp", "model")


@query("agg_pctweighted", WEIGHT_SQL + " SELECT model, round(accuracy, 8) AS accuracy, total_count, is_na FROM o")
def agg_pctweighted(t):
    return overall(t).withColumn("accuracy", F.round("accuracy", 8))


@query("agg_leaderboard", WEIGHT_SQL + ", p AS (SELECT model, " + ", ".join(f"max(CASE WHEN category = '{c}' AND NOT is_na THEN round(accuracy, 8) END) AS {c}" for c in SIZES) + " FROM full_ GROUP BY model) SELECT p.*, round(o.accuracy, 8) AS overall, row_number() OVER (ORDER BY round(o.accuracy, 8) DESC NULLS LAST, p.model) AS rank FROM p JOIN o USING (model)")
def agg_leaderboard(t):
    wide = scores(t).groupBy("model").pivot("category", list(SIZES)).agg(F.max(F.when(~F.col("is_na"), F.round("accuracy", 8))))
    return scoring.ranked(wide.join(overall(t).select("model", F.round("accuracy", 8).alias("overall")), "model"), "overall", "model")


@query("agg_cost_api", f"WITH {RESULTS}, p(model, i, o) AS (SELECT 'model_' || n, n + 0.5, 2.0 * n FROM range(5) r(n)) SELECT model, round(sum(tokens) * i / 1e6 + sum(tokens * 2) * o / 1e6, 6) AS cost FROM results JOIN p USING (model) GROUP BY model, i, o")
def agg_cost_api(t):
    prices = t.spark.createDataFrame([(f"model_{n}", n + 0.5, 2.0 * n) for n in range(5)], "model string, input_price double, output_price double")
    return scoring.api_cost(results(t).withColumn("input_tokens", F.col("tokens")).withColumn("output_tokens", F.col("tokens") * 2), prices)


@query("agg_cost_gpu", f"WITH {RESULTS} SELECT model, round(sum(latency) / 3600 * 23.92 / 100, 4) AS cost FROM results GROUP BY model")
def agg_cost_gpu(t):
    return scoring.gpu_cost(results(t))


@query("agg_latency", f"WITH {RESULTS}, x AS (SELECT model, unnest([latency, floor(latency / 50)]) AS v FROM results) SELECT model, round(avg(v), 2) AS mean, round(stddev_samp(v), 2) AS std, round(quantile_cont(v, 0.95), 2) AS p95 FROM x WHERE v <> 0 GROUP BY model")
def agg_latency(t):
    nested = F.array(F.array("latency"), F.array(F.floor(F.col("latency") / 50).cast("double")))
    return scoring.latency_stats(results(t).withColumn("l", nested), "l", "model")


@query("agg_fmtsens", f"WITH {RESULTS}, c AS (SELECT model, config, avg(valid::INT) AS a FROM results GROUP BY ALL) SELECT model, round(avg(a), 8) AS accuracy, round((max(a) - min(a)) * 100, 8) AS max_delta, round(var_samp(a) * 100, 8) AS variance, round(stddev_samp(a) * 100, 8) AS std FROM c GROUP BY model")
def agg_fmtsens(t):
    return scoring.config_spread(results(t)).select("model", *[F.round(c, 8).alias(c) for c in ("accuracy", "max_delta", "variance", "std")])


@query("agg_usage", f"WITH {RESULTS} SELECT model, count(*) AS calls, sum(tokens)::BIGINT AS tokens, min(ts) AS started, max(ts) AS ended FROM results GROUP BY model")
def agg_usage(t):
    return results(t).groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@query("agg_vote", "SELECT user_id % 50 AS agent, CASE WHEN sum((event_type IN ('purchase', 'error'))::INT) = 0 THEN NULL ELSE sum((event_type = 'purchase')::INT) / sum((event_type IN ('purchase', 'error'))::INT) END AS rate FROM events GROUP BY 1")
def agg_vote(t):
    up, down = F.sum((F.col("event_type") == "purchase").cast("int")), F.sum((F.col("event_type") == "error").cast("int"))
    return t.events.groupBy((F.col("user_id") % 50).alias("agent")).agg(F.try_divide(up, up + down).alias("rate"))


@query("agg_hallu", f"WITH {RESULTS} SELECT model, avg(valid::INT) AS accuracy, avg((NOT valid AND category = 'live_irrelevance')::INT) AS hallucination FROM results GROUP BY model")
def agg_hallu(t):
    return results(t).groupBy("model").agg(F.avg(F.col("valid").cast("int")).alias("accuracy"), F.avg((~F.col("valid") & (F.col("category") == "live_irrelevance")).cast("int")).alias("hallucination"))


@query("agg_group_log", "SELECT event_type AS forward, value >= 50 AS outcome, count(*) AS n, min_by(user_id, event_id) AS first_back, md5(string_agg(user_id::VARCHAR, ',' ORDER BY event_id)) AS backs FROM events GROUP BY ALL")
def agg_group_log(t):
    e = t.events.select(F.col("event_type").alias("forward"), (F.col("value") >= 50).alias("outcome"), F.col("user_id").cast("string").alias("back"), F.col("event_id").alias("seq"), "user_id")
    log = joins.group_log(e, ["forward", "outcome"], "back", "seq")
    first = e.groupBy("forward", "outcome").agg(F.min_by("user_id", "seq").alias("first_back"))
    return log.join(first, ["forward", "outcome"]).select("forward", "outcome", F.size("backs").cast("long").alias("n"), "first_back", F.md5(F.array_join("backs", ",")).alias("backs"))


@query("agg_collect_fail", f"WITH {RESULTS} SELECT id, model, category FROM results WHERE NOT valid")
def agg_collect_fail(t):
    return results(t).filter(~F.col("valid")).select("id", "model", "category")


@query("sort_idkey", f"WITH {RESULTS} SELECT id, row_number() OVER (ORDER BY CASE category WHEN 'multi_turn_miss_func' THEN 3 WHEN 'memory_kv' THEN 4 ELSE 2 END, category, event_id) AS pos FROM results")
def sort_idkey(t):
    c = F.col("category")
    return joins.numbered(results(t).withColumn("p", ids.sort_priority(c)).withColumn("i", ids.index_of(F.col("id"))), "pos", "p", "category", "i").select("id", "pos")


@query("join_registry", f"WITH {RESULTS}, reg(model, display_name, org) AS (SELECT 'model/' || n, 'Model ' || n, 'org' || (n % 2) FROM range(7) r(n)) SELECT reg.display_name, reg.org, count(*) AS n FROM results JOIN reg ON replace(results.model, '_', '/') = reg.model GROUP BY ALL")
def join_registry(t):
    reg = t.spark.createDataFrame([(f"model/{n}", f"Model {n}", f"org{n % 2}") for n in range(7)], "model string, display_name string, org string")
    r = results(t).withColumn("model", F.replace("model", F.lit("_"), F.lit("/")))
    return r.join(F.broadcast(reg), "model").groupBy("display_name", "org").agg(F.count("*").alias("n"))


@query("join_subset", f"WITH {RESULTS} SELECT id, category FROM results WHERE event_id IN (SELECT doc_id FROM documents)")
def join_subset(t):
    return joins.subset(results(t), t.documents.select(F.col("doc_id").alias("event_id")), "event_id").select("id", "category")


@query("join_filter_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def join_filter_ids(t):
    return joins.subset(t.documents, t.labels.select("doc_id"), "doc_id").select("doc_id", "lang")


@query("join_eval", "SELECT d.doc_id, l.quality, l.toxic, d.lang FROM documents d JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id) JOIN benchmark b ON b.item_id = d.doc_id % 40")
def join_eval(t):
    answers = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = t.documents.withColumn("item_id", F.col("doc_id") % 40)
    return d.join(answers, "doc_id").join(t.benchmark.select("item_id"), "item_id").select("doc_id", "quality", "toxic", "lang")


@query("join_anti_done", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_anti_done(t):
    return joins.not_done(t.documents, t.labels, "doc_id").select("doc_id")


@query("join_missing_chunk", "SELECT n AS chunk_id FROM range(1200) r(n) WHERE n NOT IN (SELECT doc_id FROM labels)")
def join_missing_chunk(t):
    return joins.missing_chunks(t.spark, 1200, t.labels.select(F.col("doc_id").alias("chunk_id")))


@query("join_cross_cfg", "SELECT 'format_sensitivity_' || (row_number() OVER (ORDER BY item_id, c) - 1) || ':cfg' || c || ':' || item_id AS id FROM benchmark, range(26) r(c)")
def join_cross_cfg(t):
    cfg = t.spark.range(26).select(F.col("id").alias("c"))
    x = joins.numbered(t.benchmark.crossJoin(F.broadcast(cfg)), "pos", "item_id", "c")
    return x.select(F.concat(F.lit("format_sensitivity_"), (F.col("pos") - 1).cast("string"), F.lit(":cfg"), F.col("c").cast("string"), F.lit(":"), F.col("item_id").cast("string")).alias("id"))


@query("join_funcdoc", "WITH c AS (SELECT doc_id, unnest([lang, source, 'none']) AS cls, unnest([0, 1, 2]) AS p FROM documents), d(cls, doc) AS (SELECT DISTINCT lang, 'doc of ' || lang FROM documents UNION SELECT DISTINCT source, 'doc of ' || source FROM documents) SELECT doc_id, string_agg(doc, '|' ORDER BY p) AS docs FROM c JOIN d USING (cls) WHERE cls <> 'src3' GROUP BY doc_id")
def join_funcdoc(t):
    d = t.documents
    docs = d.select(F.col("lang").alias("cls")).union(d.select("source")).distinct().withColumn("doc", F.concat(F.lit("doc of "), "cls"))
    held = t.spark.createDataFrame([("src3",)], "cls string")
    return joins.attach_docs(d.select("doc_id", F.array("lang", "source", F.lit("none")).alias("classes")), docs, held).select("doc_id", F.array_join("docs", "|").alias("docs"))


@query("join_elo_filter", f"WITH {RESULTS}, r(model, elo) AS (SELECT 'model_' || n, CASE WHEN n = 2 THEN 0 ELSE 1000.0 + n END FROM range(1, 6) q(n)) SELECT DISTINCT model, coalesce(nullif(elo, 0), 900) AS score FROM results JOIN r USING (model)")
def join_elo_filter(t):
    r = t.spark.createDataFrame([(f"model_{n}", 0.0 if n == 2 else 1000.0 + n) for n in range(1, 6)], "model string, elo double")
    return results(t).select("model").distinct().join(F.broadcast(r), "model").select("model", F.coalesce(F.nullif("elo", F.lit(0.0)), F.lit(900.0)).alias("score"))


@query("join_api_ref", "SELECT q.item_id, r.doc_id, r.lang = 'en' AS same_domain FROM benchmark q JOIN documents r ON r.doc_id = q.item_id - 1")
def join_api_ref(t):
    return t.benchmark.select("item_id", (F.col("item_id") - 1).alias("doc_id")).join(t.documents, "doc_id").select("item_id", "doc_id", (F.col("lang") == "en").alias("same_domain"))


@query("join_deps", "SELECT conv_id, turn, turn AS level, CASE WHEN turn = 0 THEN NULL ELSE conv_id || '-' || (turn - 1) END AS needs FROM conversations")
def join_deps(t):
    return joins.levels(t.conversations.select("conv_id", "turn"), "conv_id", "turn").select("conv_id", "turn", "level", "needs")


@query("snk_csv_rank", WEIGHT_SQL + " SELECT row_number() OVER (ORDER BY CASE WHEN model = 'model_3' THEN NULL ELSE round(accuracy, 8) END DESC NULLS LAST, model)::VARCHAR || ',' || model || ',' || CASE WHEN model = 'model_3' THEN 'N/A' ELSE printf('%.2f%%', round(accuracy, 8) * 100) END AS line FROM o")
def snk_csv_rank(t):
    from quern.sources.sinks import rank_lines

    o = overall(t).select("model", F.when(F.col("model") != "model_3", F.round("accuracy", 8)).alias("accuracy"))
    return rank_lines(o, "accuracy", "model")
