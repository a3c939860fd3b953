"""Queries of the simulated tools over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import joins
from quern.operators import tools as T
from quern.plans.registry import query

LINES = r"CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\n$', ''), chr(10)) END"


@query("fs_find", "SELECT doc_id FROM documents WHERE contains('/' || lang || '/' || source || '/' || doc_id || '.txt', '/en/') AND contains(doc_id || '.txt', '7.')")
def fs_find(t):
    path = F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return T.find(t.documents.select("doc_id", path.alias("path")), "path", "/en", "7.").select("doc_id")


@query("fs_grep", f"SELECT doc_id, md5(array_to_string(list_filter({LINES}, lambda x: contains(x, 'the')), chr(10))) AS digest FROM documents")
def fs_grep(t):
    return t.documents.select("doc_id", F.md5(F.array_join(T.grep(F.col("text"), "the"), "\n")).alias("digest"))


@query("fs_wc", rf"SELECT doc_id, len({LINES})::INT AS lines, len(list_filter(regexp_split_to_array(text, '[\s\x0B\x1C-\x1F\x85\p{{Z}}]+'), lambda x: x <> ''))::INT AS words, length(text)::INT AS chars FROM documents")
def fs_wc(t):
    return t.documents.select("doc_id", T.word_count(F.col("text")).alias("w")).select("doc_id", "w.*")


@query("fs_sort", f"SELECT doc_id, md5(array_to_string(list_sort({LINES}), chr(10))) AS digest FROM documents")
def fs_sort(t):
    return t.documents.select("doc_id", F.md5(T.sorted_lines(F.col("text"))).alias("digest"))


@query("fs_tail", f"SELECT doc_id, md5(array_to_string(list_slice({LINES}, greatest(len({LINES}) - 2, 1), len({LINES})), chr(10))) AS digest FROM documents")
def fs_tail(t):
    return t.documents.select("doc_id", F.md5(T.tail(F.col("text"), 3)).alias("digest"))


L = LINES.replace("text", "{}.text")


@query("fs_diff", f"SELECT doc_id, md5(array_to_string(list_transform(list_filter(list_zip({L.format('b', 'b')}, {L.format('d', 'd')})[1:least(len({L.format('b', 'b')}), len({L.format('d', 'd')}))], lambda p: p[1] <> p[2]), lambda p: '- ' || p[1] || chr(10) || '+ ' || p[2]), chr(10))) AS digest FROM benchmark b JOIN documents d ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)")
def fs_diff(t):
    b = t.benchmark.select("item_id", F.col("text").alias("a"))
    d = t.documents.select("doc_id", "text", (F.col("doc_id") % max(1, b.count())).alias("item_id"))
    return d.join(b, "item_id").select("doc_id", F.md5(T.diff(F.col("a"), F.col("text"))).alias("digest"))


@query("fs_du", "SELECT source, bytes, CASE WHEN bytes < 1024 THEN printf('%.2f B', bytes::DOUBLE) WHEN bytes < 1048576 THEN printf('%.2f KB', bytes / 1024) ELSE printf('%.2f MB', bytes / 1048576) END AS shown FROM (SELECT source, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source)")
def fs_du(t):
    return T.disk_usage(t.documents, "source", "text")


@query("trd_history", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate <= TIMESTAMP '1995-06-30'")
def trd_history(t):
    return T.in_dates(t.orders, "o_orderdate", "1994-01-01", "1995-06-30").select("o_orderkey", "o_totalprice")


@query("trd_price", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= 950 AND p_retailprice <= 1200")
def trd_price(t):
    return T.priced(t.part, "p_retailprice", 950, 1200).select("p_partkey", "p_retailprice")


@query("trd_notify", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_discount - 0.05) >= 0.04")
def trd_notify(t):
    x = t.lineitem.withColumn("change", F.col("l_discount") - 0.05)
    return T.moved(x, "change", 0.04).select("l_orderkey", "l_linenumber")


@query("trd_sector", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN ['AAPL', 'GOOG', 'MSFT', 'NVDA'] WHEN 1 THEN ['TSLA', 'F', 'GM'] ELSE [] END AS symbols FROM supplier")
def trd_sector(t):
    k = F.col("s_suppkey")
    s = t.supplier.select("s_suppkey", F.when(k % 3 == 0, "Technology").when(k % 3 == 1, "Automobile").otherwise("Mining").alias("sector"))
    return s.join(T.sector_stocks(s.select("sector").distinct()), "sector").select("s_suppkey", "symbols")


@query("msg_search", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the')")
def msg_search(t):
    return t.conversations.filter(T.holds(F.col("text"), "THE")).select("conv_id", "turn")


@query("msg_stats", "SELECT count(*) AS received_count, count(DISTINCT conv_id) AS total_contacts FROM conversations")
def msg_stats(t):
    return T.message_stats(t.conversations, "conv_id")


@query("post_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') OR lower(source) = 'src3' OR lower(lang) = 'src3'")
def post_search(t):
    x = t.documents.withColumn("tags", F.array(F.upper("source"), "lang"))
    return T.posts_about(x, "text", "tags", "TION").select("doc_id").unionByName(T.posts_about(x, "lang", "tags", "Src3").select("doc_id")).distinct()


@query("post_stats", "SELECT user_id AS user, sum((event_type = 'click')::INT)::BIGINT AS tweet_count, sum((event_type = 'view')::INT)::BIGINT AS following_count, sum((event_type = 'signup')::INT)::BIGINT AS retweet_count FROM events WHERE event_type IN ('click', 'view', 'signup') GROUP BY user_id")
def post_stats(t):
    of = lambda kind: t.events.filter(F.col("event_type") == kind).select(F.col("user_id").alias("user"))
    return T.post_stats(of("click"), of("view"), of("signup"))


@query("post_user", "SELECT event_id FROM events WHERE user_id = 7")
def post_user(t):
    return t.events.filter("user_id = 7").select("event_id")


@query("tkt_user", "SELECT event_id FROM events WHERE 'u' || (user_id % 9) = 'u4' AND event_type = 'error'")
def tkt_user(t):
    x = t.events.withColumn("created_by", F.concat(F.lit("u"), (F.col("user_id") % 9).cast("string"))).withColumn("status", F.initcap("event_type"))
    return T.tickets_of(x, "u4", "ERROR").select("event_id")


@query("trv_cost", "SELECT o_orderkey, (c_nationkey * 10 + 100) * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 END * CASE WHEN list_sum(list_transform(string_split(strftime(o_orderdate, '%Y%m%d'), ''), lambda x: x::INT)) % 2 = 0 THEN 2 ELSE 1 END::DOUBLE AS cost FROM orders JOIN customer ON o_custkey = c_custkey")
def trv_cost(t):
    k = F.col("o_orderkey") % 4
    kind = F.when(k == 0, "economy").when(k == 1, "business").when(k == 2, "first").otherwise("cargo")
    x = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return x.select("o_orderkey", T.flight_cost(F.col("c_nationkey") * 10 + 100, kind, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("cost"))


@query("trv_fx", "SELECT o_orderkey, round(CASE o_orderkey % 3 WHEN 0 THEN o_orderkey * 8.8::DOUBLE WHEN 1 THEN o_orderkey / 10 END, 4) AS v FROM orders")
def trv_fx(t):
    k = F.col("o_orderkey") % 3
    source, target = F.when(k == 1, "JPY").when(k == 0, "USD").otherwise("EUR"), F.when(k == 1, "USD").when(k == 0, "EUR").otherwise("JPY")
    return t.orders.select("o_orderkey", F.round(T.exchanged(source, target, F.col("o_orderkey") * 11.0), 4).alias("v"))


@query("trv_history", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def trv_history(t):
    return t.orders.filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "o_totalprice")


CITIES = list(T.ZIPS)


@query("veh_zip", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '83214' WHEN 1 THEN '94016' ELSE '00000' END AS zip FROM supplier")
def veh_zip(t):
    k = F.col("s_suppkey") % 3
    return t.supplier.select("s_suppkey", T.zip_of(F.when(k == 0, "Rivermist").when(k == 1, "San Francisco").otherwise("Atlantis")).alias("zip"))


@query("veh_distance", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 750.0 WHEN 1 THEN 980.0 END AS miles FROM supplier")
def veh_distance(t):
    k = F.col("s_suppkey") % 3
    a, b = F.when(k == 0, "Stonebrook").when(k == 1, "San Francisco").otherwise("Atlantis"), F.lit("Rivermist")
    return t.supplier.select("s_suppkey", T.distance(T.zip_of(a), T.zip_of(b)).alias("miles"))


@query("veh_liter", "SELECT l_orderkey, l_linenumber, round(l_quantity * 3.78541, 5) AS liter FROM lineitem")
def veh_liter(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * T.LITRES_PER_GALLON, 5).alias("liter"))


@query("veh_tires", "SELECT p_partkey, (p_size + 20 + p_size + 22 + 30 + 31) / 4 BETWEEN 30 AND 35 AS healthy FROM part")
def veh_tires(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", T.healthy_pressure(s + 20, s + 22, F.lit(30), F.lit(31)).alias("healthy"))


@query("math_stats", "SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, min(l_quantity) AS lowest, max(l_quantity) AS highest, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY l_suppkey")
def math_stats(t):
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_pop(q), 6).alias("std"), F.min(q).alias("lowest"), F.max(q).alias("highest"), F.round(F.sum(q), 4).alias("total"))


@query("math_scalar", "SELECT p_partkey, round(ln(p_size) / ln(2), 9) AS log2, round(sqrt(p_retailprice), 9) AS root, abs(p_size - 25) AS off, round(p_size / 50 * 100, 6) AS percent, round(p_retailprice, 1) AS rounded, pow(p_size, 2) AS square, CASE WHEN p_size % 5 <> 0 THEN round(p_retailprice / (p_size % 5), 6) END AS quotient, round(p_size * 1000 * (1 / 0.01), 4) AS cm, round(p_size * 0.393701::DOUBLE, 6) AS inches FROM part")
def math_scalar(t):
    s, p = F.col("p_size"), F.col("p_retailprice")
    return t.part.select(
        "p_partkey", F.round(F.log(2.0, s), 9).alias("log2"), F.round(F.sqrt(p), 9).alias("root"), F.abs(s - 25).alias("off"), F.round(s / 50 * 100, 6).alias("percent"), F.round(p, 1).alias("rounded"), F.pow(s, F.lit(2)).alias("square"),
        F.round(F.try_divide(p, s % 5), 6).alias("quotient"), F.round(s * 1000 * (1 / 0.01), 4).alias("cm"), F.round(s * 0.393701, 6).alias("inches"),
    )


# --- memories: each user's events are operations on a memory of their own

OPS = "o AS (SELECT user_id, event_id, event_type AS k, CASE event_id % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'replace' WHEN 2 THEN 'add' ELSE 'remove' END AS op FROM events)"


def operations(t, tool: str):
    i, e = F.col("event_id"), F.col("event_type")
    base = t.events.select(F.col("user_id").alias("entity"), i.alias("seq"), e.alias("k"), i.cast("string").alias("v"))
    verb = F.when(F.col("seq") % 4 == 1, "replace").when(F.col("seq") % 4 == 3, "remove").otherwise("add")
    args = F.when(verb == "remove", F.to_json(F.struct(F.col("k").alias("key")))).otherwise(F.to_json(F.struct(F.col("k").alias("key"), F.col("v").alias("value"))))
    return base.select("entity", "seq", F.concat(F.lit(f"{tool}_memory_"), verb).alias("op"), args.alias("args"))


@query("mem_kv", f"""WITH {OPS}, r AS (SELECT user_id, k, max(event_id) FILTER (op = 'remove') AS gone FROM o GROUP BY ALL),
a AS (SELECT o.user_id, o.k, min(o.event_id) FILTER (op = 'add') AS born FROM o JOIN r USING (user_id, k) WHERE o.event_id > coalesce(gone, -1) GROUP BY ALL)
SELECT o.user_id AS entity, o.k, max(event_id) FILTER (event_id = born OR op = 'replace' AND event_id > born)::VARCHAR AS v FROM o JOIN a USING (user_id, k) WHERE born IS NOT NULL AND event_id >= born GROUP BY ALL""")
def mem_kv(t):
    got = T.replay_memory(operations(t, "archival"), "kv_memory")
    held = F.from_json(F.get_json_object("state", "$.archival_memory"), "map<string,string>")
    return got.select("entity", F.explode(held).alias("k", "v"))


@query("mem_vec", "SELECT user_id AS entity, least(count(*), 50)::BIGINT AS n, greatest(count(*) - 50, 0)::BIGINT AS refused FROM events GROUP BY user_id")
def mem_vec(t):
    ops = t.events.select(F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), F.lit("archival_memory_add").alias("op"), F.to_json(F.struct(F.col("event_type").alias("text"))).alias("args"))
    got = T.replay_memory(ops, "vector_memory")
    return got.select("entity", F.size(F.from_json(F.get_json_object("state", "$.archival_memory"), "map<string,string>")).cast("long").alias("n"), "refused")


MEMORY_SQL = """WITH RECURSIVE e AS (SELECT user_id, repeat(event_type, 300) AS text, length(event_type) * 300 AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), r AS (
  SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS used, false AS kept, 0::BIGINT AS refused FROM e WHERE i = 1
  UNION ALL SELECT r.user_id, e.i, r.used + CASE WHEN r.used + e.n <= 10000 THEN e.n ELSE 0 END, r.used + e.n <= 10000, r.refused + (r.used + e.n > 10000)::BIGINT FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1
) SELECT r.user_id AS entity, md5(coalesce(string_agg(e.text, '' ORDER BY r.i) FILTER (kept), '')) AS memory, max(refused)::BIGINT AS refused FROM r LEFT JOIN e USING (user_id, i) GROUP BY r.user_id"""


@query("mem_sum", MEMORY_SQL)
def mem_sum(t):
    ops = t.events.select(F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), F.lit("memory_append").alias("op"), F.to_json(F.struct(F.repeat("event_type", F.lit(300)).alias("text"))).alias("args"))
    return T.replay_memory(ops, "summary_memory").select("entity", F.md5(F.get_json_object("state", "$.memory")).alias("memory"), F.col("refused").cast("long").alias("refused"))


@query("mem_snap", MEMORY_SQL)
def mem_snap(t):
    """The same in two sessions: the second one starts from the snapshots that the first one left."""
    from quern.session import materialize

    ops = t.events.select(F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), F.lit("memory_append").alias("op"), F.to_json(F.struct(F.repeat("event_type", F.lit(300)).alias("text"))).alias("args"))
    half = ops.agg(F.avg("seq")).head()[0] or 0
    first = materialize(T.replay_memory(ops.filter(F.col("seq") <= half), "summary_memory"))
    second = T.replay_memory(ops.filter(F.col("seq") > half), "summary_memory", first)
    refused = first.select("entity", F.col("refused").alias("r1")).join(second.select("entity", "state", "refused"), "entity", "full")
    memory = F.md5(F.get_json_object("state", "$.memory"))
    return refused.select("entity", memory.alias("memory"), (F.coalesce("r1", F.lit(0)) + F.coalesce("refused", F.lit(0))).cast("long").alias("refused"))


@query("web_query", "SELECT page_id, url FROM pages WHERE contains(lower(html), 'ing')")
def web_query(t):
    return joins.search(t.pages, "ING", "html").drop("html").select("page_id", "url")


# --- order and pages


@query("sort_multi", "SELECT user_id, row_number() OVER (ORDER BY likes DESC, saved DESC, user_id) AS pos FROM (SELECT user_id, sum((event_type = 'click')::INT) AS likes, sum((event_type = 'view')::INT) AS saved FROM events GROUP BY 1)")
def sort_multi(t):
    n = lambda kind: F.sum((F.col("event_type") == kind).cast("int"))
    x = t.events.groupBy("user_id").agg((-n("click")).alias("likes"), (-n("view")).alias("saved"))
    return joins.numbered(x, "pos", "likes", "saved", "user_id").select("user_id", "pos")


@query("sort_field", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS by_balance, row_number() OVER (ORDER BY s_name, s_suppkey) AS by_name FROM supplier")
def sort_field(t):
    x = t.supplier.select("s_suppkey", "s_name", (-F.col("s_acctbal")).alias("b"))
    one = joins.numbered(x, "by_balance", "b", "s_suppkey").select("s_suppkey", "by_balance")
    return one.join(joins.numbered(x, "by_name", "s_name", "s_suppkey").select("s_suppkey", "by_name"), "s_suppkey")


@query("sort_check", "SELECT source, bool_and(coalesce(doc_id >= before, true)) AS in_order, bool_and(coalesce(n_chars >= chars_before, true)) AS by_length FROM (SELECT *, lag(doc_id) OVER w AS before, lag(n_chars) OVER w AS chars_before FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) GROUP BY source")
def sort_check(t):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("doc_id")
    ok = lambda c: F.coalesce(F.col(c) >= F.lag(c).over(w), F.lit(True))
    x = t.documents.select("source", ok("doc_id").alias("a"), ok("n_chars").alias("b"))
    return x.groupBy("source").agg(F.bool_and("a").alias("in_order"), F.bool_and("b").alias("by_length"))


@query("page", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
def page(t):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").offset(20).limit(10)


# --- sets


@query("set_union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def set_union_distinct(t):
    return t.orders.select(F.col("o_custkey").alias("k")).union(t.customer.select("c_custkey")).distinct()


@query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(t):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.select("o_custkey"))


SIDES = "SELECT o_orderkey, list(l_partkey % 5 ORDER BY l_linenumber, l_partkey) AS a, CASE WHEN o_custkey % 2 = 0 THEN [1::BIGINT, 2] ELSE [3::BIGINT, 3] END AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey"


def sides(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"] % 5).alias("a"))
    b = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).otherwise(F.array(F.lit(3).cast("long"), F.lit(3).cast("long")))
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "a", b.alias("b"))


@query("set_bag_contain", f"SELECT o_orderkey, len(list_filter(a, lambda x: x = b[1])) >= len(list_filter(b, lambda x: x = b[1])) AND len(list_filter(a, lambda x: x = b[2])) >= len(list_filter(b, lambda x: x = b[2])) AS holds FROM ({SIDES})")
def set_bag_contain(t):
    return sides(t).select("o_orderkey", joins.bag_contains(F.col("a"), F.col("b")).alias("holds"))


@query("set_subseq", f"SELECT o_orderkey, coalesce(list_position(a, b[1]), 0) > 0 AND coalesce(list_position(list_slice(a, list_position(a, b[1]) + 1, 1000), b[2]), 0) > 0 AS holds FROM ({SIDES})")
def set_subseq(t):
    return sides(t).select("o_orderkey", joins.is_subsequence(F.col("a"), F.col("b")).alias("holds"))
