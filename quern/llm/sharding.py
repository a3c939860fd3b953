"""Sharding by histogram sort: probe, count exact bytes, refine, then exchange once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import stash, table

#: Bits of the key that one round of probes resolves: 2**BITS candidate boundaries inside each open interval.
BITS = 12
#: Rows that one task of the exchange should sort, and the fewest tasks.
ROWS_PER_TASK, LEAST_TASKS = 2_000_000, 32
PLACES = ("_size", "_shard", "_slot")


def histogram_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.0, columns: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``docs`` with _size (UTF-8 bytes of the text and 1), _shard and _slot (place in the shard, from 0).

    Rows are ordered by (60 bits of the text's MD5, id, row), so copies of a text are neighbours and only a group on a
    boundary is cut. The n_shards - 1 splitters stand where the bytes before them reach k/n of the total, within
    ``tolerance`` times a shard's bytes (0: to the row). Each round counts bytes between candidate boundaries over all
    partitions; the driver gets at most (number of splitters) * 2**BITS counts, however many rows there are. Rows then
    move once, to ranges of the same order, where they are sorted and written with their place; a group of equal texts
    has as many ranges as its rows need. Slots are those places and counted prefixes: one row of counts for each range
    and shard, which the driver adds up, so it gets as many as there are tasks, and n_shards.

    ``columns`` are the output columns as expressions over ``docs`` (default: all its own columns). A null text has
    size 1 and is ordered as the empty text, a very long one is read for its size and hash only; a null id comes first
    among equal texts, any other long may be an id; repeated rows are placed each, in the order of the scan. Other
    columns are kept whatever their names, but _size, _shard and _slot are replaced; an empty table gives no rows.
    """
    t, i = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    out = {c: e for c, e in (columns or {c: F.col(f"`{c}`") for c in docs.columns}).items() if c not in PLACES}
    unsigned = i.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))  # its bits are in the order of ids
    base = stash(
        docs.select(
            *[e.alias(f"o{k}") for k, e in enumerate(out.values())],
            (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
            F.conv(F.substring(F.md5(F.coalesce(t, F.lit(""))), 1, 15), 16, 10).cast("long").alias("k0"),
            F.coalesce(F.shiftrightunsigned(unsigned, 32) + 1, F.lit(0)).cast("long").alias("k1"),
            F.coalesce(unsigned.bitwiseAND((1 << 32) - 1), F.lit(0)).cast("long").alias("k2"),
            F.monotonically_increasing_id().alias("k3"),
        )
    )
    seen = base.agg(F.count("*"), F.sum("size"), F.max("k1"), F.max("k2"), F.max("k3")).head()
    rows, total, *most = (x or 0 for x in seen)
    digits = _digits([("k0", 60), *((f"k{k}", x.bit_length()) for k, x in enumerate(most, 1))])
    splitters = _splitters(base, digits, [total * k // n_shards for k in range(1, n_shards)], tolerance * total / n_shards)
    shard = reduce(lambda a, b: a + b, [_at_or_after(s).cast("int") for s in splitters], F.lit(0))
    ranges = base.repartitionByRange(max(LEAST_TASKS, -(-rows // ROWS_PER_TASK)), "k0", "k1", "k2", "k3").sortWithinPartitions("k0", "k1", "k2", "k3")
    # the number of a row in its task is in the lower bits
    placed = stash(ranges.select(*[f"o{k}" for k in range(len(out))], "size", shard.alias("shard"), F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth")))
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n"), F.min("nth").alias("first")).orderBy("shard", "range").collect()
    before, offsets = {}, []
    for r in counts:
        offsets.append((r["shard"], r["range"], before.get(r["shard"], 0) - r["first"]))
        before[r["shard"]] = before.get(r["shard"], 0) + r["n"]
    offsets = docs.sparkSession.createDataFrame(offsets, "shard int, range int, offset long")
    return placed.join(F.broadcast(offsets), ["shard", "range"]).select(
        *[F.col(f"o{k}").alias(name) for k, name in enumerate(out)], F.col("size").alias("_size"), F.col("shard").alias("_shard"), (F.col("nth") + F.col("offset")).alias("_slot")
    )


def _digits(keys: list[tuple[str, int]]) -> list[tuple[str, int, int]]:
    """(column, shift, width) of each round, high bits first."""
    out = []
    for name, bits in keys:
        while bits > 0:
            width = min(BITS, bits)
            out.append((name, bits - width, width))
            bits -= width
    return out


def _splitters(base: DataFrame, digits: list, targets: list[int], slack: float) -> list[dict[str, int]]:
    """For each target the first key (per column its value) with at least that many bytes before it."""
    open_ = {(): (0, list(range(len(targets))))}  # prefix of digits -> bytes before it, targets inside it
    found: dict[int, dict[str, int]] = {}
    for depth, (name, shift, width) in enumerate(digits):
        if not open_:
            break
        digit = F.shiftrightunsigned(F.col(name), shift).bitwiseAND((1 << width) - 1)
        names = list(dict.fromkeys(d[0] for d in digits[:depth]))
        rows = base
        if depth:  # only rows that share a prefix with an open interval
            rows = rows.filter(reduce(lambda a, b: a | b, [_has_prefix(p, digits) for p in open_]))
        prefix = [F.shiftrightunsigned(F.col(c), min(d[1] for d in digits[:depth] if d[0] == c)).alias(f"p_{c}") for c in names]
        got: dict[tuple, dict[int, tuple[int, int]]] = {}
        for r in rows.groupBy(*prefix, digit.alias("d")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
            got.setdefault(tuple(r[f"p_{c}"] for c in names), {})[int(r["d"])] = (r["b"], r["n"])
        nxt: dict[tuple, tuple[int, list[int]]] = {}
        for p, (before, inside) in open_.items():
            bins = got.get(tuple(_value(p, digits, c) >> min(d[1] for d in digits[:depth] if d[0] == c) for c in names), {})
            for k in inside:
                at = before
                for d in sorted(bins):
                    b, n = bins[d]
                    if targets[k] <= at + slack:
                        found[k] = _bound((*p, d), digits)
                        break
                    if targets[k] < at + b:  # the boundary falls inside this interval
                        if n == 1 or depth + 1 == len(digits):  # a single row: it goes before the splitter
                            found[k] = _bound((*p, d), digits, after=True)
                        else:
                            nxt.setdefault((*p, d), (at, []))[1].append(k)
                        break
                    at += b
                else:
                    found[k] = _bound((*p, max(bins, default=0)), digits, after=True)
        open_ = nxt
    return [found[k] for k in range(len(targets)) if k in found]


def _value(prefix: tuple, digits: list, name: str) -> int:
    return sum(d << s for d, (c, s, _) in zip(prefix, digits) if c == name)


def _has_prefix(prefix: tuple, digits: list) -> Column:
    tests = []
    for c in dict.fromkeys(d[0] for d in digits[: len(prefix)]):
        shift = min(d[1] for d in digits[: len(prefix)] if d[0] == c)
        tests.append(F.shiftrightunsigned(F.col(c), shift) == (_value(prefix, digits, c) >> shift))
    return reduce(lambda a, b: a & b, tests)


def _bound(prefix: tuple, digits: list, after: bool = False) -> dict[str, int]:
    """The least key with this prefix, or the least one after all keys with it."""
    low = {c: _value(prefix, digits, c) for c, _, _ in digits}
    if after:
        name, shift, _ = digits[len(prefix) - 1]
        low[name] += 1 << shift
    return low


def _at_or_after(s: dict[str, int]) -> Column:
    test = F.lit(True)
    for c, v in reversed(s.items()):
        test = (F.col(c) > v) | ((F.col(c) == v) & test)
    return test


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    out = histogram_shards(table(spark, sf_dir, "documents"), columns={"doc_id": F.col("doc_id"), "text_crc32": crc})
    return out.select("doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


ORACLE = """
WITH RECURSIVE bits AS (
  SELECT n, n::BIGINT AS c, 0 AS k FROM range(256) t(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY n) AS tab FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS k0 FROM documents),
c AS (SELECT *, (sum(size) OVER (ORDER BY k0, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before, (sum(size) OVER ())::BIGINT AS total FROM d),
s AS (SELECT *, len(list_filter(range(1, 8), lambda k: before >= total * k // 8))::INT AS shard FROM c)
SELECT doc_id, size::BIGINT AS size,
  xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k0, doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM s, crc"""
