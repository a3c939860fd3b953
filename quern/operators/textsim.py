"""BLEU and its parts over any number of pairs: a pair's n-grams are counted where its row is, never on a driver."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import similarity as S
from quern.operators.decoding import rowwise


def grams(tokens: Column, n: int, left: str | None = None, right: str | None = None) -> Column:
    """n-grams of an array of tokens as texts joined by spaces, with n-1 pads at the sides that have one."""
    pad = lambda p: [F.array_repeat(F.lit(p), n - 1)] if p is not None and n > 1 else []
    t = F.concat(*pad(left), tokens, *pad(right)) if pad(left) or pad(right) else tokens
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def _counted(df: DataFrame, keys: list[str], tokens: Column, most: int) -> DataFrame:
    """(keys, n, gram, c) of the n-grams up to ``most``."""
    every = F.concat(*[F.transform(grams(tokens, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"))) for n in range(1, most + 1)])
    return df.select(*keys, F.explode(every).alias("g")).groupBy(*keys, "g.n", "g.gram").agg(F.count("*").alias("c"))


def clipped(refs: list[list[str] | None], hyp: list[str] | None, most: int = 4) -> list[dict]:
    """(matched, total) of the n-grams of ``hyp`` for n from 1: each counts at most as often as in the reference that has
    it most often.

    Of a reference only runs of tokens that the hypothesis has are cut into n-grams, so a long one costs one look at each
    of its tokens.
    """
    hyp = hyp or []
    known = set(hyp)
    own = [Counter(zip(*(hyp[k:] for k in range(n)))) for n in range(1, most + 1)]
    best: list[dict] = [{} for _ in own]
    for ref in refs:
        seen: list[dict] = [{} for _ in own]
        run: list[str] = []
        for w in (*ref, None) if ref else ():
            if w is not None and w in known:
                run.append(w)
                continue
            for n in range(1, min(most, len(run)) + 1):
                counts, wanted = seen[n - 1], own[n - 1]
                for g in zip(*(run[k:] for k in range(n))):
                    if g in wanted:
                        counts[g] = counts.get(g, 0) + 1
            run = []
        for counts, most_often in zip(seen, best):
            for g, c in counts.items():
                if c > most_often.get(g, 0):
                    most_often[g] = c
    return [{"matched": sum(min(c, r.get(g, 0)) for g, c in o.items()), "total": max(sum(o.values()), 1)} for o, r in zip(own, best)]


ROWS_AT_ONCE = 256


def _dealt(values: list, a: pa.Array) -> list:
    """``values`` cut into the lists of an array of lists; None for a null."""
    out, at = [], 0
    for n in a.value_lengths().to_pylist():
        out.append(None if n is None else values[at : at + n])
        at += n or 0
    return out


def _tokens(a: pa.Array) -> list:
    return _dealt(a.flatten().to_numpy(zero_copy_only=False).tolist(), a)


def counted(pairs: DataFrame, key: str, most: int) -> DataFrame:
    """(key, h, r, parts): lengths of the hypothesis and its nearest reference, and clipped() as an array, pair by pair.

    All of a pair is in its row, so nothing is shuffled; tokens of ROWS_AT_ONCE rows are held at a time.
    """
    kind = pa.list_(pa.struct([("matched", pa.int64()), ("total", pa.int64())]))

    @F.arrow_udf("array<struct<matched:bigint,total:bigint>>")
    def parts(refs: pa.Array, hyp: pa.Array) -> pa.Array:
        out: list = []
        for at in range(0, len(hyp), ROWS_AT_ONCE):
            r = refs.slice(at, ROWS_AT_ONCE)
            out += [clipped(x or [], h, most) for x, h in zip(_dealt(_tokens(r.flatten()), r), _tokens(hyp.slice(at, ROWS_AT_ONCE)))]
        return pa.array(out, kind)

    return pairs.select(key, F.size("hyp").alias("h"), closest_length(F.col("refs"), F.col("hyp")).alias("r"), parts("refs", "hyp").alias("parts"))


def precisions(pairs: DataFrame, key: str = "pair_id", most: int = 4) -> DataFrame:
    """(key, n, matched, total) of pairs (key, refs, hyp): matches clipped to the reference that has a gram most often."""
    x = counted(pairs, key, most).select(key, F.posexplode("parts").alias("n", "p"))
    return x.select(key, (F.col("n") + 1).alias("n"), F.col("p.matched").alias("matched"), F.col("p.total").alias("total"))


def closest_length(refs: Column, hyp: Column) -> Column:
    """Length of the reference nearest to the hypothesis's, the shorter of two."""
    sized = F.transform(refs, lambda r: F.struct(F.abs(F.size(r) - F.size(hyp)).alias("far"), F.size(r).alias("len")))
    return F.array_min(sized)["len"]


def brevity(reference: Column, hypothesis: Column) -> Column:
    return F.when(hypothesis > reference, 1.0).when(hypothesis == 0, 0.0).otherwise(F.exp(1 - reference / F.nullif(hypothesis, F.lit(0))))


def _smoothed(n: Column, matched: Column, total: Column, method: int, zeros: Column, length: Column) -> Column:
    """Precision as a fraction, by the smoothings that need no other n-grams."""
    plain = matched / total
    zero = matched == 0
    return {
        0: F.when(zero, 2.2250738585072014e-308).otherwise(plain),
        1: F.when(zero, S.EPSILON / total).otherwise(plain),
        2: (matched + 1) / (total + 1),
        3: F.when(zero, 1 / (F.pow(F.lit(2.0), zeros) * total)).otherwise(plain),
        4: F.when(zero & (length > 1), (n - 1 + S.K / F.log(F.greatest(length, F.lit(2)))) / total).when(zero, 2.2250738585072014e-308).otherwise(plain),
    }[method]


def bleu(pairs: DataFrame, method: int = 1, weights: tuple[float, ...] = (0.25,) * 4, key: str = "pair_id", corpus: bool = False) -> DataFrame:
    """(key, bleu) of each pair, or one row of all pairs together if ``corpus``. Methods 0 to 4 are summed up as columns;
    5 to 7 need more n-grams of a single pair, and are computed row by row."""
    if method > 4:
        one = rowwise(lambda r, h: S.bleu([(r, h)], weights, method), "double", pa.float64())
        return pairs.select(key, one("refs", "hyp").alias("bleu"))
    x = counted(pairs, key, len(weights))
    each = [F.col("parts")[n - 1][c].alias(f"{c[0]}{n}") for n in range(1, len(weights) + 1) for c in ("matched", "total")]
    x = x.select(key, "h", "r", *each)
    if corpus:
        x = x.agg(*[F.sum(c).alias(c) for c in x.columns if c != key])
    m = lambda n: F.col(f"m{n}")
    zeros = lambda n: reduce(lambda a, b: a + b, [(m(k) == 0).cast("int") for k in range(1, n + 1)])
    logs = [w * F.log(_smoothed(F.lit(n), m(n), F.col(f"t{n}"), method, zeros(n), F.col("h"))) for n, w in enumerate(weights, 1)]
    score = F.when(m(1) == 0, 0.0).otherwise(brevity(F.col("r"), F.col("h")) * F.exp(reduce(lambda a, b: a + b, logs)))
    return x.select(score.alias("bleu")) if corpus else x.select(key, score.alias("bleu"))


def weighted_recall(pairs: DataFrame, keywords: dict[str, float], key: str = "pair_id", most: int = 4) -> DataFrame:
    """(key, n, matched, total) from the side of one reference per pair; single tokens by weight, 1 if they have none.

    Weights count only where there are as many of them as different tokens in the reference.
    """
    ref = _counted(pairs.select(key, F.col("refs")[0].alias("ref")), [key], F.col("ref"), most)
    own = _counted(pairs.select(key, "hyp"), [key], F.col("hyp"), most).withColumnRenamed("c", "h")
    kinds = ref.filter("n = 1").groupBy(key).agg(F.count("*").alias("kinds"))
    table = F.create_map(*[F.lit(x) for kv in keywords.items() for x in kv])
    weight = F.when((F.col("n") == 1) & (F.col("kinds") == len(keywords)), F.coalesce(F.try_element_at(table, F.col("gram")), F.lit(1.0))).otherwise(1.0)
    x = ref.join(own, [key, "n", "gram"], "left").join(kinds, key)
    part = x.groupBy(key, "n").agg(F.sum(weight * F.least("c", F.coalesce("h", F.lit(0)))).alias("matched"), F.sum(weight * F.col("c")).alias("total"))
    full = pairs.select(key, F.explode(F.sequence(F.lit(1), F.lit(most))).alias("n"))
    return full.join(part, [key, "n"], "left").select(key, "n", F.coalesce("matched", F.lit(0.0)).alias("matched"), F.greatest(F.coalesce("total", F.lit(0.0)), F.lit(1.0)).alias("total"))
