"""SimHash near-dedup: Golay-code fuzzy keys of fingerprint segments find the links, components group them.

Where a similarity of shingle sets is asked for instead, the links are found through prefixes of the sets, without loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm._common import BROADCAST_IDS, connected_components, drop_kept, lookup, rows_with, stash, table

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: The 64 bits in three segments, each decoded as a 23-bit word of the Golay code, padded with zeros.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key that a single task compares; larger buckets are cut into blocks, compared two by two.
BLOCK = 2048
#: Rows of sorted keys that a task holds at a time, besides a bucket that is larger.
HELD = 250_000
#: About so many texts are read for shingles that many texts share; one in at least HOT of them is a hot one.
SAMPLE, HOT = 5_000, 3
#: Cells to which the rows of a hot shingle are dealt.
CELLS = 64
#: Bits of a set's parity.
PARITY = 1024
#: Guards products of a similarity and a count against rounding.
EPS = 1e-9
GENERATOR = 0b101011100011


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; ASCII letters lower-cased, words split at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-k] + 1)).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64)


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is set if it is in over half of the shingle hashes; 0 without words."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


@cache
def golay_table() -> np.ndarray:
    """Index of the one codeword within 3 errors, for each of the 2**23 words: the (23, 12) code is perfect."""
    code = np.zeros(4096, np.int64)
    for bit in range(12):
        code ^= np.where(np.arange(4096) >> bit & 1, GENERATOR << bit, 0)
    b = [1 << i for i in range(23)]
    errors = [0, *b, *(x ^ y for i, x in enumerate(b) for y in b[:i]), *(x ^ y ^ z for i, x in enumerate(b) for j, y in enumerate(b[:i]) for z in b[:j])]
    out = np.empty(1 << 23, np.int16)
    for e in errors:
        out[code ^ e] = np.arange(4096)
    return out


def segment_keys(seg: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of all words within one error of each segment, at most six, and which of the six are used.

    Two words at two errors or fewer have a word within one error of both, hence share an index.
    """
    t = golay_table()
    near = np.sort(np.stack([t[seg], *(t[seg ^ (1 << i)] for i in range(bits))], axis=1), axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    order = np.argsort(~new, axis=1, kind="stable")[:, :6]
    return np.take_along_axis(near, order, 1).astype(np.int64), np.take_along_axis(new, order, 1)


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each fingerprint: of at most four errors in three segments, two segments have at most two each."""
    segs = [segment_keys(((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64), n) for at, n in SEGMENTS]
    rows, keys = [], []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        both = segs[a][1][:, :, None] & segs[b][1][:, None, :]
        key = (pair << 24) | (segs[a][0][:, :, None] << 12) | segs[b][0][:, None, :]
        r, i, j = np.nonzero(both)
        rows.append(r)
        keys.append(key[r, i, j])
    return np.concatenate(rows), np.concatenate(keys)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_kept()
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column("t")), np.uint64, b.num_rows)
        yield pa.record_batch([b.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_kept()
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 4096):
            part = fp[at : at + 4096]
            r, k = fuzzy_keys(part)
            yield pa.record_batch([pa.array(k), pa.array(part[r].view(np.int64))], ["key", "fp"])


def bucket_links(key: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all fingerprints of equal key at MAX_BITS or fewer; a spanning forest, not all pairs.

    ``key`` is sorted. Every pair of a bucket is compared, but a link between fingerprints that are connected already
    is left out, so that the output is at most one row per fingerprint.
    """
    nodes, local = np.unique(fp, return_inverse=True)
    root = np.arange(len(nodes))
    last = np.repeat(np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)), np.diff(np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))))
    at, d, out = np.arange(len(key)), 0, []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    while True:
        d += 1
        at = at[at + d < last[at]]
        if not len(at):
            return out
        a, b = local[at], local[at + d]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
        near = np.bitwise_count(nodes[a] ^ nodes[b]) <= MAX_BITS
        for x, y in set(zip(a[near].tolist(), b[near].tolist())):
            rx, ry = find(x), find(y)
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
                out.append((int(nodes[x]), int(nodes[y])))
        if near.any():
            while True:  # roots of all, at once
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, cell); whole buckets are taken together from about HELD rows at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def done(parts: list, final: bool) -> tuple[list, pa.RecordBatch | None]:
        key = np.concatenate([p[0] for p in parts])
        fp = np.concatenate([p[1] for p in parts])
        end = len(key) if final else int(np.searchsorted(key, key[-1]))
        links = np.array(bucket_links(key[:end], fp[:end]) if end else [], np.uint64).reshape(-1, 2).view(np.int64)
        return [(key[end:], fp[end:])], pa.record_batch([pa.array(links[:, 0]), pa.array(links[:, 1])], ["src", "dst"])

    n = 0
    for b in batches:
        key, cell, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "cell", "fp"))
        held.append(((key << 32) | cell, fp.view(np.uint64)))
        n += len(key)
        if n >= HELD:
            held, out = done(held, False)
            n = len(held[0][0])
            yield out
    if n:
        yield done(held, True)[1]


def links(fps: DataFrame) -> DataFrame:
    """Rows (src, dst) that connect all fingerprints (distinct, column fp) at four or fewer differing bits.

    Every fingerprint is dealt to all its keys. A key of over BLOCK fingerprints is cut into blocks by a hash, and each
    two blocks meet in a task of their own: exact for any size. The table of such keys is broadcast: with BLOCK raised
    to a 100,000th of the rows, they are at most 100,000.
    """
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(stash(fps.mapInArrow(_keys, "key long, fp long")))
    return dealt.repartition(parts, "key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_links, "src long, dst long")


def _dealt(keys: DataFrame) -> DataFrame:
    """``keys`` (a stashed table of key, fp and more) with column cell: rows of large keys go to the cells of their blocks."""
    block = max(BLOCK, keys.count() // 100_000)
    large = keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("nb"))
    dealt = keys.join(F.broadcast(large), "key", "left").withColumn("b", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    others = F.expr("filter(sequence(0, nb - 1), x -> x <> b)")
    cells = F.when(F.col("nb").isNull() | (F.col("nb") < 2), F.array(F.lit(0))).otherwise(F.transform(others, lambda x: (F.least(x, F.col("b")) * F.col("nb") + F.greatest(x, F.col("b"))).cast("int")))
    return dealt.select(*keys.columns, F.explode(cells).alias("cell")).withColumn("cell", F.col("cell").cast("long"))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, k))


def set_node(s: np.ndarray) -> int:
    """A number of 64 bits that equal sets share; 0 for the empty one."""
    return xxhash.xxh64_intdigest(s.astype("<u8").tobytes(), SEED) if len(s) else 0


def prefix(s: np.ndarray, similarity: float, hot: np.ndarray) -> tuple[np.ndarray, int]:
    """The first elements of a set in the order of all sets, hot ones last: as many as two sets of that Jaccard share one of.

    And how many of these are not hot.
    """
    n = len(s) - int(np.ceil(similarity * len(s) - EPS)) + 1 if len(s) else 0
    common = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(len(s), bool)
    return s[np.argsort(common, kind="stable")[:n]], min(n, int(len(s) - common.sum()))


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    """Bits, in bytes, each whether an odd number of elements falls on it: two sets differ in at least as many elements as bits."""
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little")


def wide_parity(s: np.ndarray) -> bytes | None:
    """The parity of a large set, with four to eight bits an element; None where PARITY bits are as many."""
    bits = 1 << max(4 * len(s) - 1, 1).bit_length()
    return parity(s, bits).tobytes() if bits > PARITY else None


def fold(odd: np.ndarray, size: int) -> np.ndarray:
    """The parity that half as many bits would have, and so on until there are ``size`` bytes."""
    while len(odd) > size:
        odd = odd[: len(odd) // 2] ^ odd[len(odd) // 2 :]
    return odd


def _shingles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                sets = [shingle_set(t.as_py(), k) for t in b.column("t")[at : at + 256]]
                yield pa.record_batch([pa.array(np.concatenate(sets).view(np.int64))], ["key"])

    return run


def _prefixes(k: int, similarity: float, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                node, size, keys, cold, odd, wide = [], [], [], [], [], []
                for t in b.column("t")[at : at + 256]:
                    s = shingle_set(t.as_py(), k)
                    node.append(set_node(s))
                    size.append(len(s))
                    first, n = prefix(s, similarity, hot.value)
                    keys.append(first.view(np.int64))
                    cold.append(n)
                    odd.append(parity(s, PARITY).tobytes())
                    wide.append(wide_parity(s))
                yield pa.record_batch([b.column("id")[at : at + 256], pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(cold, pa.int32()), pa.array(odd, pa.binary()), pa.array(wide, pa.binary()), b.column("row")[at : at + 256]], ["id", "fp", "size", "keys", "cold", "odd", "wide", "row"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                sets = [shingle_set(t.as_py(), k) for t in b.column("t")[at : at + 256]]
                yield pa.record_batch([pa.array(np.array([set_node(s) for s in sets], np.uint64).view(np.int64)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["fp", "elements"])

    return run


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def cross_pairs(key: np.ndarray, fp: np.ndarray, size: np.ndarray, rank: np.ndarray, comp: np.ndarray, odd: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """Pairs (greater, smaller) of nodes of equal key (sorted) and different components that sizes, places of the key and
    parities do not rule out. Rows of a bucket's largest component are compared with the others only."""
    order = np.lexsort((comp, key))
    key, fp, size, rank, comp, odd = (x[order] for x in (key, fp, size, rank, comp, odd))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (comp[1:] != comp[:-1])
    run = np.cumsum(new) - 1
    count = np.bincount(run)
    most = np.lexsort((-count, key[new]))
    first = np.ones(len(most), bool)
    first[1:] = key[new][most][1:] != key[new][most][:-1]
    largest = np.zeros(len(count), bool)
    largest[most[first]] = True
    order = np.lexsort((largest[run], key))  # of each bucket the largest component last
    key, fp, size, rank, comp, odd = (x[order] for x in (key, fp, size, rank, comp, odd))
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    last = np.repeat(ends, np.diff(ends, prepend=0))
    at, d, held, n = np.flatnonzero(~largest[run][order]), 0, [], 0
    while True:
        d += 1
        at = at[at + d < last[at]]
        for lo in range(0, len(at), 100_000):
            a = at[lo : lo + 100_000]
            b = a + d
            least = np.ceil(similarity / (1 + similarity) * (size[a] + size[b]) - EPS)
            ok = (comp[a] != comp[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - EPS) & (np.minimum(size[a] - rank[a], size[b] - rank[b]) >= least)
            a, b = a[ok], b[ok]
            ok = _differing(odd[a], odd[b]) <= (1 - similarity) / (1 + similarity) * (size[a] + size[b]) + EPS
            a, b = fp[a[ok]], fp[b[ok]]
            held.append(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1))
            n += len(a)
        if n > 250_000 or not len(at):
            if n:
                yield np.unique(np.concatenate(held), axis=0)
            held, n = [], 0
        if not len(at):
            return


def _cross(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (key, cell), as in _links."""
        drop_kept()
        held: list[list[np.ndarray]] = []

        def done(final: bool) -> Iterator[pa.RecordBatch]:
            key, cell, *rest = (np.concatenate(x) for x in zip(*held))
            new = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))))
            end = len(key) if final else int(np.searchsorted(new, new[-1]))
            held[:] = [[x[end:] for x in (key, cell, *rest)]]
            for p in cross_pairs(new[:end], *(x[:end] for x in rest), similarity) if end else ():
                yield pa.record_batch([pa.array(p[:, 0]), pa.array(p[:, 1])], ["src", "dst"])

        n = 0
        for b in batches:
            odd = np.frombuffer(b"".join(b.column("odd").to_pylist()), np.uint64).reshape(b.num_rows, -1)
            held.append([*(b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "cell", "fp", "size", "rank", "c")), odd])
            n += b.num_rows
            if n >= HELD:
                yield from done(False)
                n = len(held[0][0])
        if n:
            yield from done(True)

    return run


def _possible(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint64).reshape(b.num_rows, -1) for x in ("odd_a", "odd_b"))
            most = (1 - similarity) / (1 + similarity) * (b.column("size_a").to_numpy().astype(np.int64) + b.column("size_b").to_numpy()) + EPS
            ok = _differing(a, c) <= most
            for k in np.flatnonzero(ok).tolist():
                x, y = b.column("wide_a")[k], b.column("wide_b")[k]
                if x.is_valid and y.is_valid:
                    x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                    least = min(len(x), len(y))
                    ok[k] = np.bitwise_count(fold(x, least) ^ fold(y, least)).sum(dtype=np.int64) <= most[k]
            yield b.select(["src", "dst"]).filter(pa.array(ok))

    return run


def _ends(pairs: DataFrame) -> tuple[DataFrame, int]:
    """Each node of the pairs with n, how many ends of pairs it is; how many ends there are."""
    return stash(pairs.select(F.explode(F.array("src", "dst")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n"))), 2 * pairs.count()


def _buckets(base: DataFrame) -> DataFrame:
    """Rows (key, cell, fp, size, rank, center) of the prefix elements (keys) that two or more nodes have.

    Rows are dealt once, by key. A key that many texts have, as found in the sample, is dealt to CELLS cells, so that no
    task gets all its rows. center is a node of the cell, the one whose number is least when mixed with the key: cells
    of the same nodes have different ones.
    """
    rows = base.select("fp", "size", "cold", F.posexplode("keys").alias("rank", "key"))
    rows = rows.withColumn("cell", F.when(F.col("rank") < F.col("cold"), 0).otherwise(F.pmod(F.xxhash64("fp"), F.lit(CELLS)).cast("int") + 1)).drop("cold")
    mixed, cell = F.col("fp").bitwiseXOR(F.col("key")), Window.partitionBy("key", "cell")
    rows = rows.withColumn("lo", F.min(mixed).over(cell)).withColumn("hi", F.max(mixed).over(cell))
    return rows.filter("lo <> hi or cell > 0").select("key", "cell", "fp", "size", "rank", F.col("lo").bitwiseXOR(F.col("key")).alias("center"))


def _stars(buckets: DataFrame) -> DataFrame:
    """Pairs (src, dst): each node with the center of its cell, and centers of cells of a key with one of them."""
    of_key = Window.partitionBy("key")  # at most CELLS rows each
    centers = buckets.filter("cell > 0").select("key", "cell", "center").distinct().withColumn("first", F.min(F.col("center").bitwiseXOR(F.col("key"))).over(of_key).bitwiseXOR(F.col("key")))
    both = buckets.select("fp", "center").unionByName(centers.select(F.col("center").alias("fp"), F.col("first").alias("center")))
    return both.filter("fp <> center").select(F.greatest("fp", "center").alias("src"), F.least("fp", "center").alias("dst")).distinct()


def similar_links(base: DataFrame, fps: DataFrame, src: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links (src, dst) that connect all nodes whose shingle sets have that Jaccard similarity or more, and no others.

    ``base`` has id, node (fp), size and prefix of each row of ``src``, fps one row of it for each node. Two such sets
    share an element of their prefixes. First each node is paired with the centers of its cells, as many pairs as rows;
    of those that parities allow, two for each node are verified, which gives components. A key whose nodes are all in
    one component is done, and of keys with the same nodes one is enough. In the others, nodes of different components
    are compared, and those that sizes, places and parities allow are verified. So no link between components is lost, and a group of copies makes no pairs of all
    its members.
    """
    parts = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if fps.count() < base.count():
        base = base.join(fps.select("row"), "row", "left_semi")
    buckets = stash(_buckets(base))
    sketch = stash(base.select("id", "fp", "size", "odd", "wide").join(buckets.select("fp").distinct(), "fp", "left_semi"))

    def possible(pairs: DataFrame) -> DataFrame:
        ends, total = _ends(pairs)
        odd = stash(sketch.select("fp", "size", "odd", "wide").join(ends, "fp"))
        for end, x in (("src", "a"), ("dst", "b")):
            pairs = lookup(pairs, odd.withColumnsRenamed({"fp": end} | {c: f"{c}_{x}" for c in ("size", "odd", "wide")}), end, "inner", "n", total, salt="dst" if end == "src" else "src").drop("n")
        return stash(pairs.mapInArrow(_possible(similarity), "src long, dst long"))

    def verified(pairs: DataFrame) -> DataFrame:
        ends, total = _ends(pairs)
        ids = stash(sketch.join(ends, "fp").select("id").distinct())
        n = ids.count()
        sets = rows_with(src, "id", ids, n).mapInArrow(_sets(k), "fp long, elements array<long>")
        if not src.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "id", "left_semi").groupBy("id").count().filter("count > 1").isEmpty():
            sets = sets.groupBy("fp").agg(F.first("elements").alias("elements"))
        sets = stash(sets.join(ends, "fp").select("fp", "elements", "n"))
        one = lookup(pairs, sets.withColumnsRenamed({"fp": "src", "elements": "a"}), "src", "inner", "n", total, salt="dst").drop("n")
        two = lookup(one, sets.withColumnsRenamed({"fp": "dst", "elements": "b"}), "dst", "inner", "n", total, salt="src").drop("n")
        both = F.size(F.array_intersect("a", "b"))
        return stash(two.filter(both >= similarity * (F.size("a") + F.size("b") - both) - EPS).select("src", "dst"))

    stars = possible(stash(_stars(buckets)))
    other = F.struct(F.xxhash64("src", "dst").alias("h"), "src", "dst")
    picked = stars.select(F.explode(F.array("src", "dst")).alias("fp"), other.alias("p")).groupBy("fp").agg(F.min("p").alias("p"), F.max("p").alias("q"))
    near = verified(stash(picked.select(F.explode(F.array("p", "q")).alias("p")).select("p.src", "p.dst").distinct()))
    comp = stash(connected_components(near).withColumnRenamed("component", "c"))
    links = comp.select(F.col("node").alias("src"), F.col("c").alias("dst")).filter("src <> dst")
    joined = stash(buckets.join(_few(comp), F.col("fp") == F.col("node"), "left").select("key", "cell", "fp", "size", "rank", F.coalesce("c", "fp").alias("c")))
    marks = [F.bit_xor(F.xxhash64("fp", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    groups = joined.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"), *marks, F.max("cell").alias("cell")).filter("lo <> hi")
    # of keys with the same nodes the first in the order of all sets: two nodes that have one have all
    order = F.struct(F.col("cell") > 0, F.col("key").bitwiseXOR(F.lit(-(1 << 63)).cast("long")), "key")
    open_ = stash(groups.groupBy("n", "lo", "hi", "x1", "x2").agg(F.min(order).alias("first")).select("first.key", "n"))
    if open_.isEmpty():
        return links
    rows = joined.drop("cell").join(_few(open_.select("key")), "key") if open_.count() <= BROADCAST_IDS else lookup(joined.drop("cell"), open_, "key", "inner", "n", joined.count()).drop("n")
    rows = stash(rows.join(sketch.select("fp", "odd"), "fp").select("key", "fp", "size", "rank", "c", "odd"))
    cross = _dealt(rows).repartition(parts, "key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_cross(similarity), "src long, dst long")
    return links.unionByName(verified(possible(stash(cross.distinct()))))


def _few(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has few enough rows of a few numbers."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    Two rows are linked if their fingerprints differ in four bits or fewer; component_id is the smallest id that links
    reach. Ids are longs, or cast to them. Rows of equal fingerprint are one node, so copies make no pairs. A very long
    text is fingerprinted whole, 65,536 shingles at a time. Null and empty texts have fingerprint zero
    and are linked like others; a null id never is a component's id unless all its ids are null; repeated rows are
    returned each; other columns are ignored; an empty table gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = stash(src.mapInArrow(_fingerprints, "id long, fp long"))
    fps = stash(base.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    out = _components(base, fps, links(fps.select("fp")))
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def similar_groups(docs: DataFrame, shingle: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, component_id; rows are linked by the Jaccard similarity of their word shingles.

    Shingles are sets of ``shingle`` words each, or the whole of a shorter text. Texts without words are linked to each
    other only. Ids, repeated rows and empty tables are treated as in near_groups.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    share = min(1.0, SAMPLE / max(1, src.count()))
    some = src.filter(F.pmod(F.xxhash64("t", F.lit(SEED)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("t")
    # at most a HOT-th of the sampled shingles
    hot = some.mapInArrow(_shingles(shingle), "key long").groupBy("key").count().filter(F.col("count") >= HOT).select("key").collect()
    hot = spark.sparkContext.broadcast(np.array(sorted(r["key"] for r in hot), np.int64).view(np.uint64))
    numbered = src.withColumn("row", F.monotonically_increasing_id())
    base = stash(numbered.mapInArrow(_prefixes(shingle, similarity, hot), "id long, fp long, size int, keys array<long>, cold int, odd binary, wide binary, row long"))
    fps = stash(base.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.min("row").alias("row")))
    out = _components(base.select("id", "fp"), fps.drop("row"), similar_links(base, fps, src, shingle, similarity))
    return out.select(F.col("id").alias(id_col), "component_id")


def _components(base: DataFrame, fps: DataFrame, linked: DataFrame) -> DataFrame:
    """``base`` (id, fp) with component_id, the smallest id that links between fingerprints reach; fps has least id and count of each."""
    comp = connected_components(linked)
    of_fp = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = of_fp.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    of_fp, ids = stash(of_fp), stash(ids)
    named = stash(lookup(of_fp, ids, "component", "inner", "size", fps.count()).select("fp", "n", "component_id"))
    return lookup(base, named, "fp", "inner", "n", base.count())


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose id is their component's, all columns: one document of each group.

    Groups are those of near_groups, or with a ``similarity`` those of similar_groups.

    Rows that share an id share its fate: all stay if one of them is its group's document; so repeated rows stay
    together, and rows with a null id go unless their whole group has none. No rows give no rows.
    """
    docs_ = docs.select(id_col, text_col)
    groups = stash(near_groups(docs_, id_col, text_col) if similarity is None else similar_groups(docs_, shingle, similarity, id_col, text_col))
    mine = F.col(id_col).eqNullSafe(F.col("component_id"))
    gone = stash(groups.groupBy(id_col).agg(F.max(mine).alias("stays")).filter("not stays").select(id_col))
    return rows_with(docs, id_col, gone, gone.count(), "left_anti")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
