"""Pairwise battles: counts, win matrices, online Elo, Bradley-Terry ratings."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, SCALE, BASE, INIT = 4.0, 400.0, 10.0, 1000.0
#: Agents up to which ratings are fitted with a dense matrix, and whose names are broadcast.
DENSE, BROADCAST_AGENTS = 2000, 1_000_000
A_WINS, B_WINS, TIE, BAD = "A is better", "B is better", "Tie", "Both are bad"


def outcome_counts(battles: DataFrame) -> DataFrame:
    return battles.groupBy("rating").agg(F.count("*").alias("n"))


def without_ties(battles: DataFrame) -> DataFrame:
    """Drops ratings that say Tie; "Both are bad" stays."""
    return battles.filter(~F.col("rating").contains(TIE))


def per_agent(battles: DataFrame) -> DataFrame:
    return sides(battles).groupBy("agent").agg(F.count("*").alias("n"))


def sides(battles: DataFrame) -> DataFrame:
    return battles.select(F.explode(F.array("a", "b")).alias("agent"))


def symmetric_counts(battles: DataFrame, top: int | None = None) -> DataFrame:
    """(a, b, n) for every pair of agents, battles in either order, 0 where there are none; of the ``top`` busiest.

    The grid has agents squared cells, which is the result itself; it is joined to counts that are aggregated first.
    """
    n = battles.groupBy("a", "b").agg(F.count("*").alias("n"))
    both = n.unionByName(n.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    agents = both.groupBy("a").agg(F.sum("n").alias("total"))
    if top:
        agents = agents.orderBy(F.desc("total"), "a").limit(top)
    names = agents.select("a")
    other = names.withColumnRenamed("a", "b")
    return names.crossJoin(F.broadcast(other) if top or names.count() <= BROADCAST_AGENTS else other).join(both, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def win_matrix(battles: DataFrame) -> DataFrame:
    """(a, b, w): twice the battles in which a beat b, and once their ties, in either order. One pass over both orders."""
    side = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(A_WINS).alias("won")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"), F.lit(B_WINS).alias("won"))))
    w = F.when(F.col("rating") == F.col("s.won"), 2).when(F.col("rating").isin(TIE, BAD), 1).otherwise(0)
    return battles.select("rating", side.alias("s")).groupBy(F.col("s.x").alias("a"), F.col("s.y").alias("b")).agg(F.sum(w).cast("long").alias("w"))


def online_elo(battles: DataFrame, seq: str, pool: str, reverse: bool = False) -> DataFrame:
    """(pool, agent, rating) after all battles of a pool in order of ``seq``.

    Each rating depends on all battles before, so a pool is a sequence and one task runs it; pools run side by side.
    Within a pool rows are consumed as a stream of batches after a sort that can spill, so memory is that of the
    ratings. An unknown rating raises.
    """

    def run(batches):
        now, rating = None, {}
        for pdf in batches:
            for p, a, b, won in pdf.itertuples(index=False):
                if p != now:
                    if now is not None:
                        yield pd.DataFrame([(now, k, v) for k, v in rating.items()], columns=["pool", "agent", "rating"])
                    now, rating = p, {}
                s = {A_WINS: 1.0, B_WINS: 0.0, TIE: 0.5, BAD: 0.5}.get(won)
                if s is None:
                    raise ValueError(f"unexpected rating {won}")
                ra, rb = rating.get(a, INIT), rating.get(b, INIT)
                ea, eb = 1 / (1 + BASE ** ((rb - ra) / SCALE)), 1 / (1 + BASE ** ((ra - rb) / SCALE))
                rating[a] = ra + K * (s - ea)
                rating[b] = rating.get(b, INIT) + K * (1 - s - eb)
        if now is not None:
            yield pd.DataFrame([(now, k, v) for k, v in rating.items()], columns=["pool", "agent", "rating"])

    order = F.desc(seq) if reverse else F.asc(seq)
    dealt = battles.withColumnRenamed(pool, "pool").repartition("pool").sortWithinPartitions("pool", order)
    kind = dict(dealt.dtypes)
    return dealt.select("pool", "a", "b", "rating").mapInPandas(run, f"pool {kind['pool']}, agent {kind['a']}, rating double")


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two ratings of the same agents side by side, rounded half up."""
    up = lambda c: F.floor(c + 0.5)
    return first.select("agent", up(F.col("rating")).alias("first")).join(second.select("agent", up(F.col("rating")).alias("second")), "agent")


def in_category(battles: DataFrame, category: str) -> DataFrame:
    """Battles of which both sides' category arrays have the category."""
    return battles.filter(F.array_contains("a_categories", category) & F.array_contains("b_categories", category))


def bradley_terry(wins: DataFrame, c: float | None = None, steps: int = 50) -> DataFrame:
    """(agent, rating): maximum likelihood from a win matrix (a, b, w), ridge-penalised with strength 1/c if c is given.

    Newton steps on the driver over the distinct agents; the sums over battles are made on the cluster, in ``wins``.
    Ratings are centred on 1000: without a penalty they are known only up to a constant. Agents grow with models that
    exist, not with battles. Up to DENSE agents the Hessian is solved as a matrix; of more, by conjugate gradients over
    the pairs that met, so that memory grows with these.
    """
    import numpy as np

    rows = [(r["a"], r["b"], r["w"]) for r in wins.filter("a <> b and w > 0").collect()]
    names = sorted({x for a, b, _ in rows for x in (a, b)})
    at = {n: k for k, n in enumerate(names)}
    i, j = (np.array([at[r[k]] for r in rows], int) for k in (0, 1))
    w = np.array([r[2] for r in rows], float)
    z, ridge = np.zeros(len(names)), 1e-9 if c is None else 1 / (c * math.log(BASE) ** 2)
    for _ in range(steps if rows else 0):
        p = 1 / (1 + np.exp(-(z[i] - z[j])))
        g = np.bincount(i, w * (1 - p), len(names)) - np.bincount(j, w * (1 - p), len(names)) - ridge * z
        q = w * p * (1 - p)
        if len(names) > DENSE:
            step = _sparse_step(i, j, q, g, ridge)
        else:
            h = np.diag(np.full(len(names), ridge))
            np.add.at(h, (i, i), q)
            np.add.at(h, (j, j), q)
            np.add.at(h, (i, j), -q)
            np.add.at(h, (j, i), -q)
            step = np.linalg.lstsq(h, g, rcond=None)[0]
        z = z + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-12:
            break
    z = z - z.mean() if len(z) else z
    out = [(n, float(SCALE * v / math.log(BASE) + INIT)) for n, v in zip(names, z)]
    return wins.sparkSession.createDataFrame(out, f"agent {dict(wins.dtypes)['a']}, rating double")


def _sparse_step(i, j, q, g, ridge: float):
    """The Newton step of pairs (i, j) with weights q, by conjugate gradients scaled by the diagonal."""
    import numpy as np

    n = len(g)
    diagonal = np.bincount(i, q, n) + np.bincount(j, q, n) + ridge
    x, left = np.zeros(n), g.copy()
    way = left / diagonal
    now = first = left @ way
    for _ in range(4 * n if first > 0 else 0):
        d = q * (way[i] - way[j])
        ahead = np.bincount(i, d, n) - np.bincount(j, d, n) + ridge * way
        far = now / (way @ ahead)
        x, left = x + far * way, left - far * ahead
        z = left / diagonal
        now, before = left @ z, now
        if now <= 1e-20 * first:
            break
        way = z + now / before * way
    return x


def combined_design(battles: DataFrame) -> DataFrame:
    """Signed parts of each battle and its mirror image, counted: (left, right, won, n); parts are ``kind:name``.

    A pair of tools counts only if the tools' categories overlap; a tie counts as a loss of A.
    """
    pair = lambda kind, a, b, ok: F.when(ok & a.isNotNull() & b.isNotNull(), F.struct(F.concat(F.lit(kind + ":"), a).alias("l"), F.concat(F.lit(kind + ":"), b).alias("r")))
    c = F.col
    parts = F.array_compact(F.array(pair("tool", c("tool_a"), c("tool_b"), F.arrays_overlap("tool_categories_a", "tool_categories_b")), pair("model", c("model_a"), c("model_b"), F.lit(True)), pair("framework", c("framework_a"), c("framework_b"), F.lit(True))))
    won = (F.col("rating") == A_WINS).cast("int")
    x = battles.select(parts.alias("p"), won.alias("won"))
    both = x.select(F.transform("p", lambda s: s["l"]).alias("left"), F.transform("p", lambda s: s["r"]).alias("right"), "won").unionByName(
        x.select(F.transform("p", lambda s: s["r"]).alias("left"), F.transform("p", lambda s: s["l"]).alias("right"), (1 - F.col("won")).alias("won"))
    )
    return both.groupBy("left", "right", "won").agg(F.count("*").alias("n"))


def bt_combined(battles: DataFrame, c: float = 1.0, steps: int = 50) -> DataFrame:
    """(kind, name, rating): one rating for each tool, model and framework from joint battles, ridge 1/c."""
    import numpy as np

    rows = combined_design(battles).collect()  # distinct combinations of parts, counted on the cluster
    names = sorted({x for r in rows for x in (*r["left"], *r["right"])})
    at = {n: k for k, n in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for k, r in enumerate(rows):
        for s, side in ((1, r["left"]), (-1, r["right"])):
            for n in side:
                x[k, at[n]] = s * math.log(BASE)
    y, n = np.array([r["won"] for r in rows], float), np.array([r["n"] for r in rows], float)
    b = np.zeros(len(names))
    for _ in range(steps if rows else 0):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + np.eye(len(names)) / c, x.T @ (n * (y - p)) - b / c)
        b = b + step
        if np.abs(step).max() < 1e-12:
            break
    out = [(*m.split(":", 1), float(SCALE * v + INIT)) for m, v in zip(names, b)]
    return battles.sparkSession.createDataFrame(out, "kind string, name string, rating double")


def expected(ra: Column, rb: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(BASE), (rb - ra) / SCALE))
