"""Benchmark decontamination: rare n-gram seeds join documents to test items, Smith-Waterman alignment scores the copies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import BROADCAST_IDS, drop_kept, rows_with, stash, table

#: Words of a seed. A seed that at least 1/COMMON of all candidates have is common; there are at most COMMON such seeds a candidate word.
SEED, COMMON = 3, 1000
#: Bits of the filter of seeds: FILTER for each seed, within these bounds; a gram is looked up at PROBES places.
FILTER, LEAST_BITS, MOST_BITS, PROBES = 64, 1 << 16, 1 << 28, 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: A document is contaminated if so much of an item's words are matched, and of the aligned columns are matches.
COVERAGE, IDENTITY = 0.6, 0.6
#: Words that must be matched at least; an item of fewer words must be matched whole.
LEAST = 4
#: Cells of an alignment that a task holds; a larger one is done in a band of BAND words at both sides of a seed's diagonal.
CELLS, BAND = 4_000_000, 512
WORD = re.compile(r"[^\W_]+")
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[str]:
    """Lower-case words; all that is no letter or digit separates them."""
    return WORD.findall((text or "").lower())


def word_numbers(text: str | None) -> np.ndarray:
    """A number of 63 bits for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words_of(text)), np.uint64) >> np.uint64(1)


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """A number of 63 bits for each run of n words; runs of other words could have it too: they are refused by alignment."""
    h = np.full(max(0, len(w) - n + 1), n, np.uint64)
    for k in range(n):
        h = (h ^ w[k : len(w) - n + 1 + k]) * np.uint64(MIX[0])
        h ^= h >> np.uint64(29)
    return h >> np.uint64(1)


def seeds_of(w: np.ndarray) -> np.ndarray:
    """The seeds of an item: all its runs of SEED words, or the whole of a shorter one."""
    return grams(w, min(SEED, len(w)))


class Filter:
    """Which grams can be seeds: a bitmap that all seeds are in, and few others."""

    def __init__(self, seeds: int):
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(1, FILTER * seeds - 1).bit_length()))
        self.shift, self.bits = np.uint64(64 - bits.bit_length() + 1), np.zeros(bits // 8, np.uint8)

    def _places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        for m in MIX[:PROBES]:
            yield (h * np.uint64(m)) >> self.shift

    def add(self, h: np.ndarray) -> None:
        for at in self._places(h):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.arange(len(h))
        for at in self._places(h):
            at = at[found] if len(found) < len(h) else at
            found = found[(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        return found


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        w = [word_numbers(t.as_py()) for t in b.column("t")]
        longs = lambda xs: pa.array([x.view(np.int64) for x in xs], pa.list_(pa.int64()))
        yield pa.record_batch([b.column("item_id"), b.column("item"), longs(w), longs([seeds_of(x) if len(x) else x for x in w])], ["item_id", "item", "item_words", "seeds"])


def _passages(seeds, lengths: list[int], reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of words around grams that can be seeds; stretches that touch are one."""
        drop_kept()
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            row, start, words, hits = [], [], [], []
            for r, t in enumerate(b.column("t")):
                w = word_numbers(t.as_py())
                found = [(g[at], at) for n in lengths if len(at := seeds.value.has(g := grams(w, n)))]
                if not found:
                    continue
                h, at = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(at, kind="stable")
                h, at = h[order], at[order]
                cut = np.flatnonzero(np.diff(at) > 2 * reach) + 1
                for h_, at_ in zip(np.split(h, cut), np.split(at, cut)):
                    lo, hi = max(0, int(at_[0]) - reach), min(len(w), int(at_[-1]) + SEED + reach)
                    row.append(r)
                    start.append(lo)
                    words.append(w[lo:hi].view(np.int64))
                    hits.append([{"h": x, "at": p} for x, p in zip(h_.view(np.int64).tolist(), (at_ - lo).tolist())])
            if row:
                take = pa.array(row)
                kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())]))
                yield pa.record_batch([b.column("id").take(take), b.column("row").take(take), pa.array(start, pa.int32()), pa.array(words, pa.list_(pa.int64())), pa.array(hits, kind)], ["id", "row", "start", "words", "hits"])

    return run


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int, int, int]:
    """Smith-Waterman: (score, matched words, aligned columns, first and end of the span in ``window``)."""
    return banded(item, window, -len(item), len(window))


def banded(item: np.ndarray, window: np.ndarray, low: int, high: int) -> tuple[int, int, int, int, int]:
    """Smith-Waterman where word i of the item stands at words i + low to i + high - 1 of the window, if at all.

    One row of scores is held at a time, and two bits of each cell (in a byte): where its best alignment comes from.
    """
    n, m = len(item), len(window)
    low, high = max(low, -n), min(high, m)
    width = high - low + 1
    before, best = np.zeros(width + 1, np.int32), (0, 0, 0)
    came, step = np.zeros((n, width), np.uint8), np.arange(width, dtype=np.int32) * GAP
    padded = np.zeros(n + width, item.dtype)
    inside = np.zeros(n + width, bool)
    a, b = max(0, low), min(m, low + n + width)
    padded[a - low : b - low], inside[a - low : b - low] = window[a:b], True
    for i in range(n):
        same = (padded[i : i + width] == item[i]) & inside[i : i + width]
        across, down = before[:width] + np.where(same, MATCH, MISMATCH), before[1:] + GAP
        row = np.where(inside[i : i + width], np.maximum(np.maximum(across, down), 0), 0).astype(np.int32)
        along = np.maximum.accumulate(row - step) + step  # gaps along the row
        along = np.where(inside[i : i + width], along, 0)
        came[i] = np.where(along == 0, 0, np.where(along == across, 1, np.where(along == down, 2, 3)))
        top = int(along.argmax())
        if along[top] > best[0]:
            best = int(along[top]), i, top
        before[:width], before[width] = along, 0
    score, i, d = best
    if not score:
        return 0, 0, 0, 0, 0
    end, matched, columns = i + d + low + 1, 0, 0
    first = end
    while i >= 0 and 0 <= d < width and came[i, d]:
        way = came[i, d]
        columns += 1
        first = i + d + low if way != 2 else first
        if way == 1:
            matched += int(padded[i + d] == item[i])
            i -= 1
        elif way == 2:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return score, matched, columns, first, end


def copies(item: np.ndarray, window: np.ndarray, diagonals: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """The alignments that make a copy, best first: after each one what stands before and after it is aligned again.

    ``diagonals`` are the differences of place of the seeds that both have: a stretch without one is not looked at.
    """
    n, kinds = len(item), np.unique(item, return_counts=True)
    todo = [(0, len(window))]
    while todo:
        lo, hi = todo.pop()
        part, mine = window[lo:hi], diagonals[(diagonals >= lo - n) & (diagonals < hi)]
        if not len(mine) or shared(kinds, part) < COVERAGE * n:
            continue
        if n * len(part) <= CELLS:
            got = align(item, part)
        else:
            got = max(banded(item, part, d - BAND - lo, d + BAND - lo) for d in _spread(mine))
        score, matched, columns, a, b = got
        if not score:
            continue
        if matched >= max(COVERAGE * n, min(n, LEAST)) and matched >= IDENTITY * columns:
            yield score, matched, columns, lo + a, lo + b
            todo += [(lo, lo + a), (lo + b, hi)]
        elif (lo, hi) != (lo + a, lo + b):  # the best is no copy, another one could be
            todo += [x for x in ((lo, lo + a), (lo + b, hi)) if x[1] - x[0] >= COVERAGE * n]


def _spread(diagonals: np.ndarray) -> list[int]:
    """Diagonals of which each given one is within BAND / 2 of one."""
    out: list[int] = []
    for d in np.unique(diagonals).tolist():
        if not out or d - out[-1] > BAND // 2:
            out.append(d)
    return out


def shared(kinds: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> int:
    """The most words that any alignment can match: those of both, as often as both have them."""
    values, counts = kinds
    at = np.minimum(np.searchsorted(values, words), len(values) - 1)
    return int(np.minimum(np.bincount(at[values[at] == words], minlength=len(values)), counts).sum())


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage of a document that copies an item: id, item_id, score, matched, coverage, identity, start, end.

    start and end are word numbers in the document. Documents are read once: grams that a bitmap of all seeds has (of
    bounded size, broadcast) go on with the words around them, and are joined to the items by seed. Common seeds,
    which many candidates have, are joined by broadcast apart from the rare ones, so that no task gets all rows of one.
    A passage and an item that share a seed are aligned if they share enough words for a copy, in whatever order.
    A passage that holds several copies has a row for each, which don't overlap; of alignments with equal scores the
    one that ends first counts.

    Null and empty texts and items match nothing; items shorter than LEAST words must be matched whole; an item whose
    alignment with a passage has over CELLS cells is aligned in bands around its seeds, so that memory grows with its
    length only; null ids and repeated rows have rows of their own; other columns are ignored; an empty table on either
    side gives no rows.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.monotonically_increasing_id().alias("row"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("t"), F.monotonically_increasing_id().alias("item"))
    items = stash(items.mapInArrow(_words, "item_id long, item long, item_words array<long>, seeds array<long>").filter("size(item_words) > 0"))
    seeds = stash(items.select("item", F.posexplode("seeds").alias("place", "h")))
    n_items, n_seeds = items.count(), seeds.count()
    longest, lengths = items.agg(F.max(F.size("item_words")), F.collect_set(F.least(F.size("item_words"), F.lit(SEED)))).head()
    bitmap = Filter(n_seeds)
    block: list[int] = []
    for r in seeds.select("h").distinct().toLocalIterator():
        block.append(r["h"])
        if len(block) == 100_000:
            bitmap.add(np.array(block, np.uint64))
            block.clear()
    bitmap.add(np.array(block, np.uint64))
    longest = longest or 1
    found = _passages(spark.sparkContext.broadcast(bitmap), sorted(lengths or []), longest + max(8, longest // 2))
    passages = stash(src.mapInArrow(found, "id long, row long, start int, words array<long>, hits array<struct<h:long,at:int>>"))
    hits = passages.select("row", "start", F.explode("hits").alias("x")).select("row", "start", "x.h", "x.at")
    if n_seeds <= BROADCAST_IDS:
        both = hits.join(F.broadcast(seeds), "h")
    else:
        total = hits.count()
        common = F.broadcast(stash(hits.groupBy("h").count().filter(F.col("count") >= max(2, total // COMMON)).select("h")))
        apart = seeds.join(common, "h", "left_semi")
        apart = F.broadcast(apart) if apart.count() <= BROADCAST_IDS else apart
        both = hits.join(common, "h", "left_semi").join(apart, "h").unionByName(hits.join(common, "h", "left_anti").join(seeds, "h"))
    pairs = both.groupBy("row", "start", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("diagonals"))
    words = items.select("item", "item_id", "item_words")
    few = n_items <= BROADCAST_IDS and n_seeds <= 4 * BROADCAST_IDS  # 8 bytes a word
    pairs = pairs.join(F.broadcast(words) if few else words, "item").join(passages.drop("hits"), ["row", "start"])
    out = "id long, item_id long, score int, matched int, coverage double, identity double, start int, end int"
    return pairs.select("id", "item_id", "start", "words", "item_words", "diagonals").mapInArrow(_score, out).withColumnRenamed("id", id_col)


@cache
def _remembered() -> dict:
    return {}


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _remembered()  # passages that many documents have
    known.clear()
    for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
        out = []
        for r in range(b.num_rows):
            start = b.column("start")[r].as_py()
            item, window, diagonals = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("item_words", "words", "diagonals"))
            key = (xxhash.xxh3_128_digest(item.tobytes()), xxhash.xxh3_128_digest(window.tobytes()))
            if key not in known:
                if len(known) > 20_000:
                    known.clear()
                known[key] = list(copies(item, window, diagonals))
            i = b.column("item_id")[r].as_py()
            out += [(r, i, score, matched, matched / len(item), matched / columns, start + lo, start + hi) for score, matched, columns, lo, hi in known[key]]
        if out:
            row, *cols = zip(*out)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32())
            yield pa.record_batch([b.column("id").take(pa.array(row)), *(pa.array(c, t) for c, t in zip(cols, types))], ["id", "item_id", "score", "matched", "coverage", "identity", "start", "end"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that copy no item, all columns.

    A row without an id is kept, whatever it holds; repeated rows share their id's fate; null and empty texts are kept;
    no rows give no rows, and a benchmark without items keeps all.
    """
    found = stash(contaminated(docs.select(id_col, text_col), benchmark, id_col, text_col).filter(F.col(id_col).isNotNull()).select(id_col).distinct())
    return rows_with(docs, id_col, found, found.count(), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
