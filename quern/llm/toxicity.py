"""Toxicity: a chain of linear classifiers, each fed the earlier categories' probabilities, trained out of fold."""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import drop_kept, stash, table

#: The chain and the label of each: a text of low quality (quality is 0), told by its shape, then a toxic one, told by its
#: words and by how likely it is to be of low quality.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
#: Labelled rows used at most: the ones with the smallest hash of their id.
MAX_TRAIN = 20_000
FOLDS, STEPS, PENALTY, THRESHOLD = 3, 25, 0.1, 0.4
#: A fit ends when no weight moves by more; a Newton step is solved but for this share.
LEAST_STEP, CLOSE = 1e-3, 0.02
#: Evidence (nats) and ratio of odds that a feature needs to be in a model.
LEAST_EVIDENCE, LEAST_ODDS = 9.0, 3.0
#: Letters of a stem.
STEMS = (4, 5, 6, 7, 8)
MARKS, CAPITALS = re.compile(r"[\w\s]+"), re.compile(r"[A-Z]")
STRIP = ".,;:!?\"'()[]{}<>*#%&$_-–—…«»“”‘’/\\|"


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words, without punctuation around them."""
    out = set()
    for w in set((text or "").lower().split()):
        w = w.strip(STRIP)
        if w.isalnum():
            out.add(w)
        elif w:
            out.update(re.findall(r"[^\W_]+", w))
    return out


def shape(text: str | None) -> set[str]:
    """In twelfths: words that are distinct, words that repeat the one before, characters that are marks, and capitals."""
    text = text or ""
    words = text.split()
    if not words:
        return {"#empty"}
    share = {
        "distinct": len(set(words)) / len(words),
        "again": sum(map(operator.eq, words, words[1:])) / len(words),
        "marks": len(MARKS.sub("", text)) / len(text),
        "capitals": len(CAPITALS.findall(text)) / len(text),
    }
    return {f"#{name}{math.ceil(12 * x)}" for name, x in share.items()}


def features(text: str | None) -> set[str]:
    """Words, stems of longer words as ``stem*``, ``stem**`` for a stem of two or more distinct words, and the shape."""
    words = words_of(text)
    out = words | shape(text)
    for n in STEMS:
        for w in words:
            if len(w) > n:
                stem = w[:n] + "*"
                out.add(stem + "*" if stem in out else stem)
    return out


@dataclass
class Linear:
    """A logistic model of features and earlier probabilities; a constant if a class has no rows."""

    bias: float
    words: dict[str, float]
    earlier: list[float]

    def probability(self, found: set[str], earlier: list[float]) -> float:
        z = self.bias + sum(self.words[x] for x in found & self.words.keys()) + sum(a * b for a, b in zip(self.earlier, earlier))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Chain:
    """The models in their order. Only the features that one of them has are looked for in a text."""

    def __init__(self, models: list[Linear]):
        self.models = models
        names = {x for m in models for x in m.words}
        self.words = {x for x in names if x[-1] != "*"}
        self.stems = {x.rstrip("*") for x in names if x[-1] == "*"}
        self.sizes = sorted({len(x) for x in self.stems})
        self.starts = {x[: STEMS[0]] for x in self.stems}
        self.shaped = any(x[0] == "#" for x in names)

    def found(self, text: str | None) -> set[str]:
        words = words_of(text)
        out = words & self.words
        if self.shaped:
            out |= shape(text) & self.words
        for w in words:
            if w[: STEMS[0]] in self.starts:
                for n in self.sizes:
                    if len(w) > n and (stem := w[:n]) in self.stems:
                        out.add(stem + "**" if stem + "*" in out else stem + "*")
        return out

    def score(self, text: str | None) -> list[float]:
        """Probability of each category, in the order of the chain."""
        found, out = self.found(text), []
        for m in self.models:
            out.append(m.probability(found, out))
        return out


class Rows:
    """Labelled rows as a sparse matrix: the numbers of row and feature of each of its ones."""

    def __init__(self, names: list[str], cols: np.ndarray, counts: np.ndarray):
        """``cols`` are the features of all rows, one row after the other; ``counts`` how many each has."""
        self.names, self.cols, self.n = np.array(names, object), cols, len(counts)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), counts)

    def telling(self, y: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Numbers of the features that tell the classes apart among the rows in use, most evidence first.

        Of features that the same rows have one stays: a word before a stem, a longer stem before a shorter one.
        """
        base = y[use].mean() if use.any() else 0.0
        if not 0 < base < 1:
            return np.array([], np.int64)
        kept = use[self.row]
        both = np.bincount(self.cols[kept], minlength=len(self.names))
        pos = np.bincount(self.cols[kept], weights=y[self.row[kept]], minlength=len(self.names))
        gain, odds = evidence(pos, both, base)
        good = np.flatnonzero((gain >= LEAST_EVIDENCE) & (odds >= np.log(LEAST_ODDS)))
        general = [(-gain[k], self.names[k].endswith("*"), -len(self.names[k]), self.names[k]) for k in good]
        good = good[sorted(range(len(good)), key=general.__getitem__)]
        marks = np.random.default_rng(0).integers(1, 1 << 62, self.n)
        mark = np.zeros(len(self.names), np.int64)
        np.add.at(mark, self.cols[kept], marks[self.row[kept]])
        return good[np.sort(np.unique(mark[good], return_index=True)[1])]


def evidence(pos: np.ndarray, both: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Of features with so many rows of the class, and rows at all: log likelihood gained over the base rate, log ratio of odds."""
    p = (pos + base) / (both + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        q = pos / both
        gain = np.nan_to_num(pos * np.log(q / base)) + np.nan_to_num((both - pos) * np.log((1 - q) / (1 - base)))
    return gain, np.abs(np.log(p / (1 - p)) - np.log(base / (1 - base)))


def fit_linear(rows: Rows, y: np.ndarray, earlier: np.ndarray, use: np.ndarray, shapes: bool = False) -> tuple[Linear, np.ndarray]:
    """The model of words (or shapes) fitted to the rows in use, and its probabilities for all rows: ridge-penalised Newton steps, each solved
    by conjugate gradients, so that memory grows with the ones of the matrix and not with rows times features."""
    pos, of = y[use].sum(), use.sum()
    base = (pos + 0.5) / (of + 1) if 0 < pos < of else min(max(pos / (of + 1), 1e-9), 1 - 1e-9)  # nothing known: not toxic
    prior = float(np.log(base / (1 - base)))
    if not 0 < pos < of:
        return Linear(prior, {}, [0.0] * earlier.shape[1]), np.full(rows.n, base)
    cols = rows.telling(y, use)
    cols = cols[[(n[0] == "#") == shapes for n in rows.names[cols]]] if len(cols) else cols
    at = np.full(len(rows.names), -1)
    at[cols] = np.arange(len(cols))
    hit = at[rows.cols] >= 0
    r, c, k = rows.row[hit], at[rows.cols[hit]].astype(np.int32), len(cols)
    rest = np.column_stack([earlier, np.ones(rows.n)])
    by_col = np.argsort(c, kind="stable")
    along_row, along_col = _sums(r, rows.n), _sums(c[by_col], k)
    r_by_col = r[by_col]
    times = lambda v: along_row(v[c]) + rest @ v[k:]
    back = lambda u: np.append(along_col(u[r_by_col]), u @ rest)
    ridge = np.append(np.full(k + earlier.shape[1], PENALTY), 1e-6)
    w = np.append(np.zeros(k + earlier.shape[1]), prior)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        d = np.where(use, p * (1 - p), 0.0)
        diagonal = np.append(along_col(d[r_by_col]), d @ rest**2) + ridge
        step = conjugate_gradients(lambda v: back(d * times(v)) + ridge * v, back(np.where(use, y - p, 0.0)) - ridge * w, diagonal)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < LEAST_STEP:
            break
    probability = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
    return Linear(float(w[-1]), dict(zip(rows.names[cols].tolist(), w[:k].tolist())), w[k:-1].tolist()), probability


def _sums(group: np.ndarray, n: int):
    """A function that sums values by their groups, which come in order."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    which = group[starts]

    def run(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(starts):
            out[which] = np.add.reduceat(values, starts)
        return out

    return run


def conjugate_gradients(matrix, b: np.ndarray, diagonal: np.ndarray, most: int = 200) -> np.ndarray:
    """x where matrix(x) is b but for CLOSE of it, for a positive definite matrix; its diagonal scales the steps.

    The next Newton step corrects what is left.
    """
    x, left = np.zeros(len(b)), b.copy()
    z = left / diagonal
    way, now = z.copy(), left @ z
    for _ in range(most):
        if now <= CLOSE**2 * (b @ (b / diagonal)):
            break
        ahead = matrix(way)
        far = now / (way @ ahead)
        x, left = x + far * way, left - far * ahead
        z = left / diagonal
        now, before = left @ z, now
        way = z + now / before * way
    return x


def out_of_fold(rows: Rows, y: np.ndarray, earlier: np.ndarray, fold: np.ndarray, shapes: bool = False) -> np.ndarray:
    """For each row the probability from a model that saw no row of its fold: not to choose features, nor to fit."""
    out = np.zeros(rows.n)
    for f in np.unique(fold):
        out[fold == f] = fit_linear(rows, y, earlier, fold != f, shapes)[1][fold == f]
    return out


def fit_chain(rows: Rows, labels: np.ndarray, fold: np.ndarray) -> Chain:
    """One model per category, a column of ``labels``. A later one learns from the earlier ones' out-of-fold probabilities."""
    held, models = np.zeros((rows.n, 0)), []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        shapes = c + 1 < labels.shape[1]  # the last one is told by words
        models.append(fit_linear(rows, y, held, np.ones(rows.n, bool), shapes)[0])
        if shapes:
            held = np.column_stack([held, out_of_fold(rows, y, held, fold, shapes)])
    return Chain(models)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_kept()
    for b in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):  # a text has thousands of features
        yield pa.record_batch([b.column("id"), b.column("fold"), b.column("y"), pa.array([sorted(features(t)) for t in b.column("t").to_pylist()], pa.list_(pa.string()))], ["id", "fold", "y", "words"])


def _gain(pos: Column, both: Column, base: float) -> Column:
    other = both - pos
    return F.when(pos > 0, pos * F.log(pos / both / base)).otherwise(0.0) + F.when(other > 0, other * F.log(other / both / (1 - base))).otherwise(0.0)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Chain:
    """The chain for at most ``max_train`` labelled documents. Features are counted on the cluster, by fold and label; the
    driver gets, for each of these documents, which it has of the features that are evidence enough for one of the
    models. How many these are is bounded by the labelled rows: each needs several of them.

    Labels without an id or without one of the categories are left out; of several for an id the worst counts; a
    document without text has no words; without rows of both classes the chain gives every text the same low
    probability. Ties of evidence go to words before stems, longer ones first, then by name.
    """
    y = F.array(*[F.max(F.expr(e)).cast("int") for e in CATEGORIES.values()])
    lab = labels.filter("toxic is not null and quality is not null and doc_id is not null").groupBy("doc_id").agg(y.alias("y"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).withColumnRenamed("doc_id", "label_id")
    src = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).join(F.broadcast(lab), F.col("id") == F.col("label_id"))
    src = src.select("id", "t", "y", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"))
    rows = stash(src.mapInArrow(_words, "id long, fold int, y array<int>, words array<string>"))
    classes = range(len(CATEGORIES))
    of = rows.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(F.col("y")[c]).alias(f"p{c}") for c in classes]).collect()
    one = lambda of_fold, x: F.sum(F.when(F.col("fold") != of_fold, x).otherwise(0))
    uses = [-1, *range(FOLDS)]  # all rows, and all but a fold
    counts = rows.select("fold", "y", F.explode("words").alias("word")).groupBy("word").agg(
        *[one(f, F.lit(1)).alias(f"n_{k}") for k, f in enumerate(uses)], *[one(f, F.col("y")[c]).alias(f"p{c}_{k}") for k, f in enumerate(uses) for c in classes]
    )
    enough = F.lit(False)
    for k, f in enumerate(uses):
        n = sum(r["n"] for r in of if r["fold"] != f)
        for c in classes:
            pos = sum(r[f"p{c}"] for r in of if r["fold"] != f)
            if 0 < pos < n:
                mine = F.col("word").startswith("#") == F.lit(c + 1 < len(CATEGORIES))
                enough |= F.coalesce(mine & (F.col(f"n_{k}") > 0) & (_gain(F.col(f"p{c}_{k}"), F.col(f"n_{k}"), pos / n) >= LEAST_EVIDENCE - 1e-6), F.lit(False))
    names = sorted(r["word"] for r in counts.filter(enough).select("word").toLocalIterator())
    known = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(names)})

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for b in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
            yield pa.record_batch([b.column("id"), b.column("fold"), b.column("y"), pa.array([[k for w in ws if (k := get(w)) is not None] for ws in b.column("words").to_pylist()], pa.list_(pa.int32()))], ["id", "fold", "y", "cols"])

    got = rows.mapInArrow(some, "id long, fold int, y array<int>, cols array<int>").toArrow().sort_by("id").combine_chunks()
    of_row = lambda name: pa.chunked_array(got.column(name).chunks, got.column(name).type).combine_chunks()
    y, cols = of_row("y").flatten().to_numpy().reshape(-1, len(CATEGORIES)), of_row("cols")
    return fit_chain(Rows(names, cols.flatten().to_numpy(), cols.value_lengths().to_numpy()), y, got.column("fold").to_numpy())


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a probability p_<category> for each category, and rejected (toxic at THRESHOLD or more), for each row.

    One pass over whole texts without a shuffle; a very long text is one set of words. Null and empty texts have no
    words; null ids and repeated rows are passed through; other columns are ignored; without labelled rows of both
    classes all texts get the same score. A probability of THRESHOLD itself is rejected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for b in batches:
            p = np.array([chain.score(t.as_py()) for t in b.column("t")]).reshape(-1, len(CATEGORIES))
            yield pa.record_batch([b.column("id"), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= THRESHOLD)], ["id", *(f"p_{c}" for c in CATEGORIES), "rejected"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return src.mapInArrow(run, "id long, " + "".join(f"p_{c} double, " for c in CATEGORIES) + "rejected boolean").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the chain doesn't reject, all columns; each row is judged where it is, without a join.

    Repeated rows and null ids are judged alike; null and empty texts have no words; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for b in batches:
            yield b.filter(pa.array([chain.score(t.as_py())[-1] < THRESHOLD for t in b.column(text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
