"""Queries on battles; ``events`` stands in for a log of votes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quern.operators import arena, joins
from quern.operators.scoring import ranked
from quern.plans.registry import query
from quern.sources import sinks

RATING = {"purchase": arena.A_WINS, "error": arena.B_WINS, "view": arena.TIE, "click": arena.BAD, "signup": arena.BAD}
BATTLES = "battles AS (SELECT event_id AS seq, 'agent' || (user_id % 5) AS a, 'agent' || ((user_id + 1 + event_id % 4) % 5) AS b, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RATING.items()) + " END AS rating, user_id % 3 AS pool FROM events)"
WINS = f"{BATTLES}, sides AS (SELECT a, b, CASE rating WHEN '{arena.A_WINS}' THEN 2 WHEN '{arena.B_WINS}' THEN 0 ELSE 1 END AS w FROM battles UNION ALL SELECT b, a, CASE rating WHEN '{arena.B_WINS}' THEN 2 WHEN '{arena.A_WINS}' THEN 0 ELSE 1 END FROM battles), wins AS (SELECT a, b, sum(w)::BIGINT AS w FROM sides GROUP BY ALL)"


def battles(t):
    u, e = F.col("user_id"), F.col("event_id")
    name = lambda c: F.concat(F.lit("agent"), c.cast("string"))
    rating = F.create_map(*[F.lit(x) for kv in RATING.items() for x in kv])[F.col("event_type")]
    return t.events.select(e.alias("seq"), name(u % 5).alias("a"), name((u + 1 + e % 4) % 5).alias("b"), rating.alias("rating"), (u % 3).alias("pool"))


@query("agg_battle_count", f"WITH {BATTLES} SELECT rating, count(*) AS n FROM battles GROUP BY rating")
def agg_battle_count(t):
    return arena.outcome_counts(battles(t))


@query("flt_tie", f"WITH {BATTLES} SELECT rating, count(*) AS n FROM battles WHERE NOT contains(rating, 'Tie') GROUP BY rating")
def flt_tie(t):
    return arena.outcome_counts(arena.without_ties(battles(t)))


@query("agg_battle_agent", f"WITH {BATTLES} SELECT agent, count(*) AS n FROM (SELECT a AS agent FROM battles UNION ALL SELECT b FROM battles) GROUP BY agent")
def agg_battle_agent(t):
    return arena.per_agent(battles(t))


@query("set_union_concat", f"WITH {BATTLES} SELECT a AS agent FROM battles UNION ALL SELECT b FROM battles")
def set_union_concat(t):
    b = battles(t)
    return b.select(F.col("a").alias("agent")).unionByName(b.select(F.col("b").alias("agent")))


@query("agg_distinct_agents", f"WITH {BATTLES} SELECT count(DISTINCT agent) AS n FROM (SELECT a AS agent FROM battles UNION ALL SELECT b FROM battles)")
def agg_distinct_agents(t):
    return arena.sides(battles(t)).agg(F.count_distinct("agent").alias("n"))


@query("agg_pivot_sym", f"WITH {BATTLES}, s AS (SELECT a, b FROM battles UNION ALL SELECT b, a FROM battles), tot AS (SELECT a, count(*) AS n FROM s GROUP BY a ORDER BY n DESC, a LIMIT 4) SELECT x.a, y.a AS b, (SELECT count(*) FROM s WHERE s.a = x.a AND s.b = y.a) AS n FROM tot x, tot y")
def agg_pivot_sym(t):
    return arena.symmetric_counts(battles(t), top=4)


@query("agg_win_matrix", f"WITH {WINS} SELECT * FROM wins")
def agg_win_matrix(t):
    return arena.win_matrix(battles(t))


# SQL over all battles in order: a fold of each pool's list, which starts from an empty table of ratings
BATTLE = "{'m': NULL::MAP(VARCHAR, DOUBLE), 'a': a, 'b': b, 's': CASE rating WHEN 'A is better' THEN 1.0 WHEN 'B is better' THEN 0.0 ELSE 0.5 END::DOUBLE}"
NEXT = """lambda r, x: {'m': map_concat(r.m, map([x.a, x.b], [coalesce(r.m[x.a], 1000) + 4 * (x.s - 1 / (1 + pow(10::DOUBLE, (coalesce(r.m[x.b], 1000) - coalesce(r.m[x.a], 1000)) / 400))),
  coalesce(r.m[x.b], 1000) + 4 * (1 - x.s - 1 / (1 + pow(10::DOUBLE, (coalesce(r.m[x.a], 1000) - coalesce(r.m[x.b], 1000)) / 400)))])), 'a': x.a, 'b': x.b, 's': x.s}"""
START = "{'m': map(['-'], [0.0::DOUBLE]), 'a': '', 'b': '', 's': 0.0::DOUBLE}"


def fold(name: str, order: str, pool: str = "0") -> str:
    """A table (pool, agent, rating) as a common table expression."""
    return f"{name} AS (SELECT pool, agent, m[agent] AS rating FROM (SELECT pool, m, unnest(map_keys(m)) AS agent FROM (SELECT pool, list_reduce(l, {NEXT}, {START}).m AS m FROM (SELECT {pool} AS pool, list({BATTLE} ORDER BY seq {order}) AS l FROM battles GROUP BY 1))) WHERE agent <> '-')"


def elo_sql(order: str) -> str:
    return f"WITH {BATTLES}, {fold('f', order)} SELECT agent, round(rating, 6) AS rating FROM f"


def elo(t, reverse: bool):
    return arena.online_elo(battles(t).withColumn("pool", F.lit(0)), "seq", "pool", reverse).select("agent", F.round("rating", 6).alias("rating"))


@query("elo_online", elo_sql("ASC"))
def elo_online(t):
    return elo(t, False)


@query("elo_reverse", elo_sql("DESC"))
def elo_reverse(t):
    return elo(t, True)


@query("elo_pools", f"WITH {BATTLES}, {fold('f', 'ASC', 'pool')} SELECT pool, agent, round(rating, 6) AS rating FROM f")
def elo_pools(t):
    return arena.online_elo(battles(t), "seq", "pool").withColumn("rating", F.round("rating", 6))


@query("elo_compare", f"WITH {BATTLES}, {fold('f', 'ASC')}, {fold('g', 'DESC')} SELECT agent, floor(f.rating + 0.5)::BIGINT AS first, floor(g.rating + 0.5)::BIGINT AS second FROM f JOIN g USING (agent)")
def elo_compare(t):
    b = battles(t).withColumn("pool", F.lit(0))
    return arena.compare(arena.online_elo(b, "seq", "pool"), arena.online_elo(b, "seq", "pool", True))


@query("rank_desc", f"WITH {WINS}, s AS (SELECT a AS agent, sum(w)::BIGINT AS score FROM wins GROUP BY a) SELECT agent, score, row_number() OVER (ORDER BY score DESC, agent) AS rank FROM s")
def rank_desc(t):
    s = arena.win_matrix(battles(t)).groupBy(F.col("a").alias("agent")).agg(F.sum("w").alias("score"))
    return ranked(s, "score", "agent")


def categorised(t):
    cats = lambda c: F.when(c.isin("agent0", "agent1", "agent2"), F.array(F.lit("math"), F.lit("search"))).otherwise(F.array(F.lit("search"), F.lit("code")))
    b = battles(t)
    return b.withColumn("a_categories", cats(F.col("a"))).withColumn("b_categories", cats(F.col("b")))


@query("flt_overlap", f"WITH {BATTLES} SELECT count(*) AS n FROM battles WHERE a IN ('agent0', 'agent1', 'agent2') AND b IN ('agent0', 'agent1', 'agent2')")
def flt_overlap(t):
    return arena.in_category(categorised(t), "math").agg(F.count("*").alias("n"))


@query("set_intersect", f"WITH {BATTLES} SELECT seq, list_sort(list_intersect(CASE WHEN a IN ('agent0', 'agent1', 'agent2') THEN ['math', 'search'] ELSE ['search', 'code'] END, CASE WHEN b IN ('agent0', 'agent1', 'agent2') THEN ['math', 'search'] ELSE ['search', 'code'] END))::VARCHAR AS shared FROM battles")
def set_intersect(t):
    shared = F.array_sort(F.array_intersect("a_categories", "b_categories"))
    return categorised(t).select("seq", F.concat(F.lit("["), F.array_join(shared, ", "), F.lit("]")).alias("shared"))


def ratings_sql(source: str, ridge: float, steps: int = 1500) -> str:
    """Maximum likelihood by damped Jacobi steps over the list of ratings; ``source`` is SQL of (a, b, w) with w > 0 and a <> b."""
    p = "1 / (1 + exp(s.z[j] - s.z[i]))"
    g = f"list_sum(list_transform(range(1, k + 1), lambda j: w[i][j] * (1 - {p}) - w[j][i] * {p}))"
    h = f"list_sum(list_transform(range(1, k + 1), lambda j: (w[i][j] + w[j][i]) * ({p}) * (1 - {p})))"
    return f"""x AS ({source}), names AS (SELECT list(a ORDER BY a) AS names, count(*) AS k FROM (SELECT a FROM x UNION SELECT b FROM x)),
m AS (SELECT names, k, list_transform(range(1, k + 1), lambda i: list_transform(range(1, k + 1), lambda j: coalesce(c[names[i] || ' ' || names[j]], 0.0))) AS w FROM names, (SELECT map(list(a || ' ' || b), list(w::DOUBLE)) AS c FROM x)),
s AS (SELECT 0 AS n, list_transform(range(k), lambda i: 0.0::DOUBLE) AS z FROM m
  UNION ALL SELECT n + 1, list_transform(range(1, k + 1), lambda i: s.z[i] + 0.5 * ({g} - {ridge!r} * s.z[i]) / ({h} + {ridge!r})) FROM s, m WHERE n < {steps}),
f AS (SELECT names, z, list_avg(z) AS mean FROM s, m WHERE n = {steps}),
r AS (SELECT unnest(names) AS agent, round({arena.SCALE / math.log(arena.BASE)!r} * (unnest(z) - mean) + {arena.INIT}, 4) AS rating FROM f)"""


def wins_sql(battles: str, name: str = "battles") -> str:
    return WINS.replace(BATTLES, battles) if name == "battles" else WINS.replace(BATTLES, battles).replace("FROM battles", f"FROM {name}")


def category_sql() -> str:
    groups = {"math": "a IN ('agent0', 'agent1', 'agent2') AND b IN ('agent0', 'agent1', 'agent2')", "search": "true", "code": "a NOT IN ('agent0', 'agent1', 'agent2') AND b NOT IN ('agent0', 'agent1', 'agent2')"}
    one = "SELECT '{c}' AS category, agent, rating FROM (WITH RECURSIVE {wins}, {ratings} SELECT agent, rating FROM r)"
    source, ridge = "SELECT a, b, w FROM wins WHERE a <> b AND w > 0", 1 / (0.7 * math.log(arena.BASE) ** 2)
    return " UNION ALL ".join(one.format(c=c, wins=wins_sql(BATTLES.replace("battles AS", "every AS") + f", battles AS (SELECT * FROM every WHERE {test})"), ratings=ratings_sql(source, ridge)) for c, test in groups.items())


@query("bt_category", category_sql())
def bt_category(t):
    out = None
    for c in ("math", "search", "code"):
        r = arena.bradley_terry(arena.win_matrix(arena.in_category(categorised(t), c)), c=0.7).select(F.lit(c).alias("category"), "agent", F.round("rating", 4).alias("rating"))
        out = r if out is None else out.unionByName(r)
    return out


def components(t, kind: str, k: int):
    return battles(t).withColumn("a", F.concat(F.lit(kind), (F.col("seq") % k).cast("string"))).withColumn("b", F.concat(F.lit(kind), ((F.col("seq") + 1 + F.col("seq") % (k - 1)) % k).cast("string")))


def _bt_component(name: str, k: int) -> None:
    parts = f"{BATTLES.replace('battles AS', 'every AS')}, battles AS (SELECT seq, '{name}' || (seq % {k}) AS a, '{name}' || ((seq + 1 + seq % {k - 1}) % {k}) AS b, rating FROM every)"

    @query(f"bt_{name}s", f"WITH RECURSIVE {wins_sql(parts)}, {ratings_sql('SELECT a, b, w FROM wins WHERE a <> b AND w > 0', 1e-9)} SELECT agent, rating FROM r")
    def bt(t):
        return arena.bradley_terry(arena.win_matrix(components(t, name, k))).withColumn("rating", F.round("rating", 4))


for _name, _k in (("model", 4), ("tool", 6), ("framework", 3)):
    _bt_component(_name, _k)


COMBINED_SQL = f"""WITH RECURSIVE {BATTLES}, b AS (SELECT seq, (rating = '{arena.A_WINS}')::INT AS won FROM battles),
p AS (SELECT won, list_filter([CASE WHEN (seq % 6) % 2 = ((seq + 1 + seq % 5) % 6) % 2 THEN {{'l': 'tool:t' || seq % 6, 'r': 'tool:t' || (seq + 1 + seq % 5) % 6}} END,
  CASE WHEN seq % 9 <> 0 THEN {{'l': 'model:m' || seq % 4, 'r': 'model:m' || (seq + 1 + seq % 3) % 4}} END, {{'l': 'framework:f' || seq % 3, 'r': 'framework:f' || (seq + 1) % 3}}], lambda x: x IS NOT NULL) AS p FROM b),
d AS (SELECT l, r, won, count(*)::DOUBLE AS n FROM (SELECT list_transform(p, lambda x: x.l) AS l, list_transform(p, lambda x: x.r) AS r, won FROM p UNION ALL SELECT list_transform(p, lambda x: x.r), list_transform(p, lambda x: x.l), 1 - won FROM p) GROUP BY ALL),
names AS (SELECT list(x ORDER BY x) AS names, count(*) AS k FROM (SELECT DISTINCT unnest(l || r) AS x FROM d)),
m AS (SELECT any_value(names) AS names, any_value(k) AS k, list(list_transform(names, lambda x: CASE WHEN list_contains(r, x) THEN -1.0 WHEN list_contains(l, x) THEN 1.0 ELSE 0.0 END * ln(10)) ORDER BY l, r, won) AS x, list(won ORDER BY l, r, won) AS y, list(n ORDER BY l, r, won) AS n FROM d, names),
u AS (SELECT *, list_transform(range(1, k + 1), lambda i: list_transform(range(1, k + 1), lambda j: CASE WHEN part[i] = part[j] THEN 1.0 ELSE 0.0 END)) AS same FROM (SELECT *, list_transform(names, lambda x: string_split(x, ':')[1] || CASE WHEN starts_with(x, 'tool') THEN right(x, 1)::INT % 2 ELSE 0 END) AS part FROM m)),
h AS (SELECT *, list_transform(range(1, k + 1), lambda i: 1 + 6 * 0.25 * list_sum(list_transform(range(1, len(x) + 1), lambda q: n[q] * x[q][i] * x[q][i]))) AS h,
  list_transform(range(1, k + 1), lambda i: list_sum(same[i]) + 3 * 0.25 * list_sum(list_transform(range(1, len(x) + 1), lambda q: n[q] * pow(list_dot_product(x[q], same[i]), 2)))) AS h2 FROM u),
s AS (SELECT 0 AS step, list_transform(range(k), lambda i: 0.0::DOUBLE) AS z, NULL::DOUBLE[] AS e, NULL::DOUBLE[] AS g FROM m
  UNION ALL SELECT step + 1,
    CASE WHEN step % 3 = 2 THEN list_transform(range(1, k + 1), lambda i: z[i] + 0.5 * (g[i] / h[i] + list_dot_product(g, same[i]) / h2[i])) ELSE z END,
    CASE WHEN step % 3 = 0 THEN list_transform(range(1, len(x) + 1), lambda q: n[q] * (y[q] - 1 / (1 + exp(-list_dot_product(x[q], z))))) ELSE e END,
    CASE WHEN step % 3 = 1 THEN list_transform(range(1, k + 1), lambda i: list_sum(list_transform(range(1, len(x) + 1), lambda q: x[q][i] * e[q])) - z[i]) ELSE g END FROM s, h WHERE step < 4500),
f AS (SELECT names, z FROM s, m WHERE step = 4500)
SELECT string_split(name, ':')[1] AS kind, string_split(name, ':')[2] AS name, round({arena.SCALE} * z + {arena.INIT}, 4) AS rating FROM (SELECT unnest(names) AS name, unnest(z) AS z FROM f)"""


@query("bt_combined", COMBINED_SQL)
def bt_combined(t):
    s = F.col("seq")
    n = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    cats = lambda c: F.array(F.when(c % 2 == 0, "even").otherwise("odd"))
    b = battles(t).select("rating", n("t", s % 6).alias("tool_a"), n("t", (s + 1 + s % 5) % 6).alias("tool_b"), cats(s % 6).alias("tool_categories_a"), cats((s + 1 + s % 5) % 6).alias("tool_categories_b"),
                          n("m", s % 4).alias("model_a"), F.when(s % 9 != 0, n("m", (s + 1 + s % 3) % 4)).alias("model_b"), n("f", s % 3).alias("framework_a"), n("f", (s + 1) % 3).alias("framework_b"))
    return arena.bt_combined(b).withColumn("rating", F.round("rating", 4))


@query("snk_text", f"WITH {WINS}, s AS (SELECT CASE WHEN a < 'agent2' THEN 'low' ELSE 'high' END AS category, a AS name, sum(w)::DOUBLE AS rating FROM wins GROUP BY ALL) SELECT category, name, rating FROM s")
def snk_text(t):
    s = arena.win_matrix(battles(t)).groupBy(F.when(F.col("a") < "agent2", "low").otherwise("high").alias("category"), F.col("a").alias("name")).agg(F.sum("w").cast("double").alias("rating"))
    lines = sinks.rating_lines(s)
    numbered = lines.select(F.concat("category", F.lit("/"), F.lpad(F.col("pos").cast("string"), 6, "0")).alias("at"), F.lit("ratings.txt").alias("file"), "line")
    return sinks.parse_rating_lines(numbered, "at", "file")
