"""Similarity of texts and code; pairs are all documents, each with a test item by its number."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import decoding as D
from quern.operators import textsim as T
from quern.plans.registry import query
from quern.session import spread

# hypothesis: the item's words; references: the item without its first words, and the document
PAIRS = "p AS (SELECT d.doc_id AS pair_id, string_split(b.text, ' ') AS hyp, [(string_split(b.text, ' '))[3:] || ['end'], string_split(d.text, ' ')] AS refs FROM benchmark b JOIN documents d ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"
GRAMS = "g AS (SELECT pair_id, n, array_to_string(hyp[i:i + n - 1], ' ') AS gram FROM p, range(1, 5) r(n), unnest(range(1, len(hyp) - n + 2)) q(i)), gr AS (SELECT pair_id, ref, n, array_to_string(t[i:i + n - 1], ' ') AS gram FROM (SELECT pair_id, unnest([1, 2]) AS ref, unnest(refs) AS t FROM p), range(1, 5) r(n), unnest(range(1, len(t) - n + 2)) q(i))"
COUNTS = f"""{PAIRS}, {GRAMS}, own AS (SELECT pair_id, n, gram, count(*) AS c FROM g GROUP BY ALL), best AS (SELECT pair_id, n, gram, max(c) AS r FROM (SELECT pair_id, ref, n, gram, count(*) AS c FROM gr GROUP BY ALL) GROUP BY ALL),
prec AS (SELECT p.pair_id, n.n, coalesce(sum(least(c, coalesce(r, 0))), 0)::BIGINT AS matched, greatest(coalesce(sum(c), 0), 1)::BIGINT AS total FROM p CROSS JOIN range(1, 5) n(n) LEFT JOIN own ON own.pair_id = p.pair_id AND own.n = n.n LEFT JOIN best ON best.pair_id = own.pair_id AND best.n = own.n AND best.gram = own.gram GROUP BY ALL),
len AS (SELECT pair_id, len(hyp) AS h, list_min(list_transform(refs, lambda x: {{'far': abs(len(x) - len(hyp)), 'len': len(x)}})).len AS r FROM p)"""
BP = "CASE WHEN h > r THEN 1.0 WHEN h = 0 THEN 0.0 ELSE exp(1 - r / h) END"
SMOOTH = {
    0: "CASE WHEN m = 0 THEN 2.2250738585072014e-308 ELSE m / t END", 1: "CASE WHEN m = 0 THEN 0.1 / t ELSE m / t END", 2: "(m + 1) / (t + 1)",
    3: "CASE WHEN m = 0 THEN 1 / (pow(2, z) * t) ELSE m / t END", 4: "CASE WHEN m = 0 AND h > 1 THEN (n - 1 + 5 / ln(h)) / t ELSE m / t END",
}


def bleu_sql(method: int, corpus: bool = False) -> str:
    source = "(SELECT 0 AS pair_id, n, sum(matched) AS m, sum(total) AS t FROM prec GROUP BY n)" if corpus else "(SELECT pair_id, n, matched AS m, total AS t FROM prec)"
    lens = "(SELECT 0 AS pair_id, sum(h) AS h, sum(r) AS r FROM len)" if corpus else "len"
    key = "" if corpus else "pair_id, "
    return f"WITH {COUNTS}, x AS (SELECT *, sum((m = 0)::INT) OVER (PARTITION BY pair_id ORDER BY n) AS z FROM {source} JOIN {lens} USING (pair_id)) SELECT {key}round(CASE WHEN max(CASE WHEN n = 1 THEN m END) = 0 THEN 0 ELSE max({BP}) * exp(sum(0.25 * ln({SMOOTH[method]}))) END, 8) AS bleu FROM x GROUP BY pair_id"


def bleu_more_sql(method: int) -> str:
    """Smoothings 5 to 7, which need n-grams of five tokens or the values before: by recurrences over the columns of a pair."""
    counts = COUNTS.replace("range(1, 5)", "range(1, 6)")
    if method == 6:  # the items against themselves without their first words
        counts = counts.replace("[(string_split(b.text, ' '))[3:] || ['end'], string_split(d.text, ' ')]", "[(string_split(b.text, ' '))[3:]]").replace(" JOIN documents d ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)", "").replace("d.doc_id AS pair_id", "item_id AS pair_id").replace("unnest([1, 2]) AS ref", "1 AS ref")
    value = SMOOTH[4].replace("m / t END", "m / t END") if method == 7 else "m / t"
    columns = ", ".join(f"max(CASE WHEN n = {k} THEN {value if k < 5 else 'm / t'} END) AS v{k}, max(CASE WHEN n = {k} THEN m END) AS m{k}, max(CASE WHEN n = {k} THEN t END) AS t{k}" for k in range(1, 6))
    x = f"x AS (SELECT pair_id, max(h) AS h, max(r) AS r, {columns} FROM (SELECT pair_id, n, matched AS m, total AS t FROM prec) JOIN len USING (pair_id) GROUP BY pair_id)"
    if method == 6:
        steps = ["a AS (SELECT *, v1 AS s1, v2 AS s2, (m3 + 5 * v2 * v2 / v1) / (greatest(h - 2, 0) + 5) AS s3 FROM x)", "b AS (SELECT *, (m4 + 5 * s3 * s3 / s2) / (greatest(h - 3, 0) + 5) AS s4 FROM a)", "d AS (SELECT * FROM b)"]
    else:
        steps = ["a AS (SELECT *, (v1 + 1 + v1 + v2) / 3 AS s1 FROM x)", "b AS (SELECT *, (s1 + v2 + v3) / 3 AS s2 FROM a)", "c AS (SELECT *, (s2 + v3 + v4) / 3 AS s3 FROM b)", "d AS (SELECT *, (s3 + v4 + v5) / 3 AS s4 FROM c)"]
    return f"WITH {counts}, {x}, {', '.join(steps)} SELECT pair_id, round(CASE WHEN m1 = 0 THEN 0 ELSE {BP} * exp(0.25 * (ln(s1) + ln(s2) + ln(s3) + ln(s4))) END, 8) AS bleu FROM d"


def pairs(t):
    b = t.benchmark.select("item_id", F.split("text", " ").alias("hyp"))
    d = spread(t.documents).select("doc_id", (F.col("doc_id") % max(1, b.count())).alias("item_id"), F.split("text", " ").alias("doc"))
    short = F.concat(F.expr("slice(hyp, 3, greatest(size(hyp), 1))"), F.array(F.lit("end")))
    return d.join(b, "item_id").select(F.col("doc_id").alias("pair_id"), "hyp", F.array(short, F.col("doc")).alias("refs"))


@query("ngrams", "SELECT item_id, array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|') AS grams, ['<s> <s> ' || w[1], '<s> ' || w[1] || ' ' || w[2]] AS padded FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def ngrams(t):
    w = F.split("text", " ")
    return t.benchmark.select("item_id", F.array_join(T.grams(w, 2), "|").alias("grams"), F.slice(T.grams(w, 3, left="<s>"), 1, 2).alias("padded"))


@query("bleu_precision", f"WITH {COUNTS} SELECT pair_id, n::INT AS n, matched, total FROM prec")
def bleu_precision(t):
    return T.precisions(pairs(t))


@query("bleu_reflen", f"WITH {COUNTS} SELECT pair_id, h, r FROM len")
def bleu_reflen(t):
    return pairs(t).select("pair_id", F.size("hyp").cast("long").alias("h"), T.closest_length(F.col("refs"), F.col("hyp")).cast("long").alias("r"))


@query("bleu_bp", f"WITH {COUNTS} SELECT pair_id, round({BP}, 9) AS bp FROM len")
def bleu_bp(t):
    return pairs(t).select("pair_id", F.round(T.brevity(T.closest_length(F.col("refs"), F.col("hyp")), F.size("hyp")), 9).alias("bp"))


@query("bleu_sentence", bleu_sql(1))
def bleu_sentence(t):
    return T.bleu(pairs(t)).withColumn("bleu", F.round("bleu", 8))


@query("bleu_corpus", bleu_sql(1, corpus=True))
def bleu_corpus(t):
    return T.bleu(pairs(t), corpus=True).withColumn("bleu", F.round("bleu", 8))


def _smooth(method: int) -> None:
    @query(f"bleu_smooth{method}", bleu_sql(method) if method in SMOOTH else bleu_more_sql(method))
    def one(t):
        return T.bleu(pairs(t), method).withColumn("bleu", F.round("bleu", 8))


for _m in (0, 1, 2, 3, 4, 5, 7):
    _smooth(_m)


@query("bleu_smooth6", bleu_more_sql(6))
def bleu_smooth6(t):
    """Defined only where three tokens in a row match: the items against themselves without their first words."""
    x = t.benchmark.select(F.col("item_id").alias("pair_id"), F.split("text", " ").alias("hyp"))
    return T.bleu(x.withColumn("refs", F.array(F.expr("slice(hyp, 3, greatest(size(hyp), 1))"))), 6).withColumn("bleu", F.round("bleu", 8))


@query("wrecall", f"""WITH {PAIRS}, {GRAMS}, own AS (SELECT pair_id, n, gram, count(*) AS h FROM g GROUP BY ALL), ref AS (SELECT pair_id, n, gram, count(*) AS c FROM gr WHERE ref = 1 GROUP BY ALL), kinds AS (SELECT pair_id, count(*) AS kinds FROM ref WHERE n = 1 GROUP BY 1),
w AS (SELECT pair_id, n, gram, c, coalesce(h, 0) AS h, CASE WHEN n = 1 AND kinds = 2 AND gram = 'the' THEN 3.0 WHEN n = 1 AND kinds = 2 AND gram = 'of' THEN 2.0 ELSE 1.0 END AS weight FROM ref LEFT JOIN own USING (pair_id, n, gram) JOIN kinds USING (pair_id))
SELECT p.pair_id, n.n::INT AS n, coalesce(sum(weight * least(c, h)), 0)::DOUBLE AS matched, greatest(coalesce(sum(weight * c), 0), 1)::DOUBLE AS total FROM p CROSS JOIN range(1, 5) n(n) LEFT JOIN w ON w.pair_id = p.pair_id AND w.n = n.n GROUP BY ALL""")
def wrecall(t):
    return T.weighted_recall(pairs(t), {"the": 3.0, "of": 2.0})


def programs(t):
    u, e = F.col("user_id") % 3, F.col("event_type")
    reference = F.concat(F.lit("def f(x):\n    y = x + 1\n    return "), e, F.lit("(y)\n"))
    candidate = F.when(u == 0, F.lit("def g(a):\n    b = a + 1\n    return call(b)\n")).when(u == 1, F.lit("def g(a):\n    return a\n")).otherwise(F.lit("def g(:\n"))
    return spread(t.events).select("event_id", candidate.alias("candidate"), reference.alias("reference"))


@query("syn_match", "SELECT event_id, CASE user_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 ELSE 0 END >= 0.2 AS some, user_id % 3 = 0 AS full_ FROM events")
def syn_match(t):
    scored = programs(t).select("event_id", D.syntax_matched(F.col("candidate"), F.col("reference")).alias("m"))
    return scored.select("event_id", (F.col("m") >= 0.1).alias("some"), (F.col("m") == 1).alias("full_"))


@query("syn_check", "SELECT event_id, CASE WHEN user_id % 3 = 2 THEN -1 ELSE 0 END AS syntax_errors FROM events")
def syn_check(t):
    return programs(t).select("event_id", D.syntax_checked(F.col("candidate")).alias("syntax_errors"))


@query("dfg", "SELECT event_id, unnest(['x', 'x', 'y', 'y']) AS name, unnest(['comesFrom', 'comesFrom', 'computedFrom', 'comesFrom']) AS kind, unnest([[], ['x'], ['x'], ['y']]) AS sources, unnest([0, 1, 2, 3])::BIGINT AS pos FROM events")
def dfg(t):
    return D.flow_rows(programs(t), "event_id", "reference").withColumn("pos", F.col("pos").cast("long"))


@query("dfg_match", "SELECT event_id, CASE user_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS flow_match FROM events")
def dfg_match(t):
    return programs(t).select("event_id", F.round(D.flow_matched(F.col("candidate"), F.col("reference")), 6).alias("flow_match"))
