"""Packing: deficit round-robin over source queues in closed form, so that deficits carry across windows and partitions."""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm._common import drop_kept, stash, table

WINDOW, QUANTUM = 1024, 128
#: A run of so much white space in a text of so many code points could exhaust the stack of tiktoken's pattern.
LONG, SPACES = 500_000, re.compile(r"\s{100000}")
#: Mixture weights are scaled to this whole number, so that schedules are exact in 64-bit integers.
SCALE = 1 << 20
#: Up to so many places (partitions times sources) are broadcast, some 50 bytes each; more are joined by shuffle.
BROADCAST_PLACES = 1_000_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: itself where it is printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return {b: chr(b if b in shown else next(free)) for b in range(256)}


class Ids:
    """16-bit ids of whole texts by a byte-level BPE vocabulary file of the tokenizers library.

    Where merges make ids in rising order, the file is the same as a table of ranks, which tiktoken works through in a
    third of the time; a test holds the two against each other. Other files, and texts with a run of white space that is
    too long for tiktoken's pattern, go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if max([-1, *file["model"]["vocab"].values(), *(t["id"] for t in file.get("added_tokens") or [])]) >= 1 << 16:
            raise ValueError("ids are kept in 16 bits; this vocabulary has greater ones")
        self.ranked = self._ranked(file)

    @cached_property
    def tok(self):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(self.path)
        tok.encode_special_tokens = True
        return tok

    @staticmethod
    def _ranked(file: dict):
        import public_tokenizers
        import tiktoken

        vocab, pre = file["model"]["vocab"], file["pre_tokenizer"] or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"].get("merges") or []]
        made = [vocab[a + b] for a, b in merges]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not file["normalizer"]
        if not plain or made != sorted(set(made)) or len(made) + 256 != len(vocab) or made and max(vocab.values()) != made[-1]:
            return None
        byte = {letter: b for b, letter in _byte_letters().items()}
        ranks = {bytes(byte[c] for c in word): i for word, i in vocab.items()}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if self.ranked is None or len(text) >= LONG and SPACES.search(text):
            return array("H", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        return array("H", self.ranked(text)).tobytes()


@cache
def _tokenizer(path: str) -> Ids:
    return Ids(path)


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, ends = TaskContext.get().partitionId(), {}
        tok = _tokenizer(path)
        drop_kept()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids = [tok.encode(t.as_py()) + b"\0\0" for t in b.column("t")]
                before = []
                for s, x in zip(b.column("source").to_pylist(), ids):
                    before.append(ends.get(s, 0))
                    ends[s] = before[-1] + len(x) // 2
                yield pa.record_batch(
                    [b.column("id"), b.column("source"), pa.array([part] * b.num_rows, pa.int32()), pa.array(before, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["id", "source", "part", "before", "n", "ids"],
                )

    return run


class Schedule:
    """Which place in the order of all quanta the j-th quantum of a source has.

    Deficit round-robin: as a clock runs, the deficit of each source that has tokens left grows by its weight; a source
    whose deficit reaches half a quantum puts a quantum in the window and pays one. Deficits carry on from window to
    window, and a source that runs dry leaves its share to the others. So the j-th quantum of a source with weight w
    is due at (j + 1/2) / w, and its place is the number of quanta due before it, each source counting no more than it
    has: a sum over sources, with no state to hand on from window to window or partition to partition. A test holds it
    against the counters. Whole-number arithmetic; ties go to the earlier source. Sources of weight 0 come when all
    others are dry, by their shares of the tokens.
    """

    def __init__(self, tokens: list[int], weights: list[float], quantum: int = QUANTUM, window: int = WINDOW):
        if len(weights) != len(tokens) or not all(0 <= w < math.inf for w in weights):
            raise ValueError("targets are finite and not negative")
        self.tokens, self.idle = np.array(tokens, np.int64), np.array([w == 0 for w in weights], bool)
        rest = sum(n for n, w in zip(tokens, weights) if w == 0)
        shares = [w / sum(weights) if w else n / max(1, rest) for n, w in zip(tokens, weights)]
        self.w = np.array([max(1, round(SCALE * x)) for x in shares], np.int64)
        self.n, self.quantum, self.per = -(-self.tokens // quantum), quantum, window // quantum
        last = self.n - 1
        short = self.n * quantum - self.tokens
        has = np.flatnonzero(short > 0)
        places = np.array([self.place(int(s), last[s : s + 1])[0] for s in has], np.int64)
        order = np.argsort(places)
        self.short_at, self.short = places[order], np.concatenate(([0], np.cumsum(short[has][order])))

    def place(self, s: int, j: np.ndarray) -> np.ndarray:
        """Places of the quanta ``j`` of source number ``s``."""
        out = np.zeros(len(j), np.int64)
        for r in range(len(self.n)):
            if self.idle[r] != self.idle[s]:
                out += self.n[r] if self.idle[s] else 0
                continue
            due = (2 * j + 1) * self.w[r]
            before = (due + self.w[s] - (0 if r < s else 1)) // (2 * self.w[s])
            out += j if r == s else np.clip(before, 0, self.n[r])
        return out

    def offset(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window number, and tokens of it before the quantum at this place; a source's last quantum may be short."""
        window = place // self.per
        gap = self.short[np.searchsorted(self.short_at, place)] - self.short[np.searchsorted(self.short_at, window * self.per)]
        return window, place % self.per * self.quantum - gap


def _cut(schedule: Schedule, names: list):
    index = {s: k for k, s in enumerate(names)}
    q = schedule.quantum

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                yield _pieces(whole.slice(at, 2048))

    def _pieces(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.column("n").to_numpy()
        start = b.column("before").to_numpy() + b.column("offset").to_numpy()
        src = np.fromiter((index[s] for s in b.column("source").to_pylist()), np.int64, b.num_rows)
        first, count = start // q, (start + n - 1) // q - start // q + 1
        row = np.repeat(np.arange(b.num_rows), count)
        j = np.repeat(first, count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        lo = np.maximum(j * q, start[row])
        hi = np.minimum((j + 1) * q, (start + n)[row])
        place = np.empty(len(row), np.int64)
        for s in np.unique(src):
            mine = src[row] == s
            place[mine] = schedule.place(int(s), j[mine])
        window, offset = schedule.offset(place)
        offset += lo - j * q
        # neighbours of one document that stand next to each other in a window are one piece
        joined = np.zeros(len(row), bool)
        joined[1:] = (row[1:] == row[:-1]) & (window[1:] == window[:-1]) & (offset[1:] == (offset + hi - lo)[:-1])
        head = np.flatnonzero(~joined)
        tail = np.append(head[1:], len(row)) - 1
        row, lo, hi, window, offset = row[head], lo[head], hi[tail], window[head], offset[head]
        at = lo - start[row]
        _, ends, data = b.column("ids").buffers()
        base = np.frombuffer(ends, np.int32)[b.column("ids").offset :][: b.num_rows + 1].astype(np.int64) // 2
        ids = memoryview(np.frombuffer(data, np.uint16)[base[0] : base[-1]].astype("<u4").tobytes())
        begin = 4 * (base[row] - base[0] + at)
        crc = np.array([zlib.crc32(ids[x:y]) for x, y in zip(begin.tolist(), (begin + 4 * (hi - lo)).tolist())], np.int64)
        cols = [b.column("id").take(pa.array(row)), pa.array(at), pa.array(hi - lo), pa.array(crc), pa.array(n[row]), pa.array(window), pa.array(offset), b.column("source").take(pa.array(row))]
        return pa.record_batch(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    return run


def mixture_packed(docs: DataFrame, targets: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocab: str | None = None) -> DataFrame:
    """Pieces of token windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    Each document is its ids and one id 0. The queue of a source is its documents in the order of the scan. Windows of
    WINDOW tokens are filled by quanta of QUANTUM tokens from the queues, so that tokens follow ``targets``; see
    Schedule. Targets are weights by source; one that isn't named has its share of all tokens, and one of 0 comes after
    all others. Without targets (or with zeros only) each source's target is its share of all tokens: the only ones that
    every window can meet to the end, as every token is packed. Every token is in one piece, and only a source's last
    quantum can be short: all windows but the last few are full.

    Ids are computed once, and written with each document's place in its queue within the partition; the places of
    partitions are prefix sums per source. The driver gets one row of counts per source (a mixture has as many weights);
    the cost of a place grows with the number of sources.

    Null texts and ids: an empty document (a single id 0), a null id in the result. A very long text is one row of 2
    bytes a token, cut like others. Null sources are a source of their own. Repeated rows are packed each. Sources that
    tie come in the order of their names, null first. Negative or infinite targets are refused. Other columns are
    ignored. An empty table gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    coded = stash(src.mapInArrow(_tokenize(vocab or vocabulary()), "id long, source string, part int, before long, n long, ids binary"))
    totals = stash(coded.groupBy("part", "source").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = stash(totals.select("part", F.col("source").alias("s"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset")).withColumnRenamed("part", "p"))
    sums = sorted(((r["source"], r["n"]) for r in totals.groupBy("source").agg(F.sum("n").alias("n")).collect()), key=lambda x: (x[0] is not None, x[0] or ""))
    names, tokens = [s for s, _ in sums], [n for _, n in sums]
    weights = [(targets or {}).get(s, n / sum(tokens)) for s, n in sums]
    if not any(weights):
        weights = tokens
    few = F.broadcast(places) if totals.count() <= BROADCAST_PLACES else places
    placed = coded.join(few, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select("id", "source", "before", "n", "ids", "offset")
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    return placed.mapInArrow(_cut(Schedule(tokens, weights), names), out)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_packed(table(spark, sf_dir, "documents"))
