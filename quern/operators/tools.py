"""The simulated tools' queries over tables: files, accounts, messages, posts, tickets, travel, cars, memories.

The tools with state are in quern.functions.backends; here every row is an entity, and there may be any number.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import backends as B
from quern.functions.journeys import CLASSES, DISTANCES, LITRES_PER_GALLON, RATES, ZIPS

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


# --- files: text columns


def lines_of(text: Column) -> Column:
    """The lines; a line feed at the end opens no line, and an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1))


def find(files: DataFrame, path: str, folder: str, name: str | None = None) -> DataFrame:
    """Files below a folder, those whose name holds ``name``."""
    x = files.filter(F.col(path).startswith(folder.rstrip("/") + "/"))
    return x if name is None else x.filter(F.substring_index(path, "/", -1).contains(name))


def grep(text: Column, pattern: str) -> Column:
    return F.filter(lines_of(text), lambda x: x.contains(pattern))


def word_count(text: Column) -> Column:
    """struct(lines, words, chars)."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.struct(F.size(lines_of(text)).alias("lines"), F.size(words).alias("words"), F.length(text).alias("chars"))


def sorted_lines(text: Column) -> Column:
    return F.array_join(F.array_sort(lines_of(text)), "\n")


def tail(text: Column, n: int) -> Column:
    lines = lines_of(text)
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n)), "\n")


def diff(a: Column, b: Column) -> Column:
    """Lines that differ, place by place, up to the end of the shorter text."""
    pairs = F.zip_with(lines_of(a), lines_of(b), lambda x, y: F.when(x != y, F.concat(F.lit("- "), x, F.lit("\n+ "), y)))
    return F.array_join(pairs, "\n")


def human_size(size: Column) -> Column:
    step = F.least(F.floor(F.log(1024.0, F.greatest(size, F.lit(1)).cast("double")) + 1e-12), F.lit(len(UNITS) - 1)).cast("int")
    return F.format_string("%.2f %s", size / F.pow(F.lit(1024.0), step), F.element_at(F.array(*map(F.lit, UNITS)), step + 1))


def disk_usage(files: DataFrame, folder: str, text: str) -> DataFrame:
    used = files.groupBy(folder).agg(F.sum(F.octet_length(text)).cast("long").alias("bytes"))
    return used.withColumn("shown", human_size(F.col("bytes")))


# --- accounts


def in_dates(df: DataFrame, at: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from the start of the first day to the start of the last one, both included; an end may be open."""
    c = F.col(at)
    x = df if start is None else df.filter(c >= F.lit(start).cast("timestamp_ntz"))
    return x if end is None else x.filter(c <= F.lit(end).cast("timestamp_ntz"))


def priced(df: DataFrame, price: str, low: float, high: float) -> DataFrame:
    return df.filter(F.coalesce(price, F.lit(0)).between(low, high))


def moved(df: DataFrame, change: str, threshold: float) -> DataFrame:
    return df.filter(F.abs(change) >= threshold)


def sector_stocks(sectors: DataFrame) -> DataFrame:
    """(sector, symbols) for asked sectors; unknown ones have none."""
    table = F.create_map(*[x for s, v in B.Trading.SECTORS.items() for x in (F.lit(s), F.array(*map(F.lit, v)))])
    return sectors.select("sector", F.coalesce(F.try_element_at(table, F.col("sector")), F.array().cast("array<string>")).alias("symbols"))


# --- messages, posts, tickets


def holds(text: Column, keyword: str) -> Column:
    return F.lower(text).contains(keyword.lower())


def message_stats(df: DataFrame, receiver: str) -> DataFrame:
    return df.agg(F.count("*").alias("received_count"), F.count_distinct(receiver).alias("total_contacts"))


def posts_about(df: DataFrame, text: str, tags: str, keyword: str) -> DataFrame:
    """Posts whose text holds the keyword, or which have it as a tag; in any case."""
    return df.filter(holds(F.col(text), keyword) | F.exists(tags, lambda t: F.lower(t) == keyword.lower()))


def post_stats(posts: DataFrame, follows: DataFrame, reposts: DataFrame) -> DataFrame:
    """(user, tweet_count, following_count, retweet_count) from three tables with a column user; each is counted first."""
    count = lambda df, name: df.groupBy("user").agg(F.count("*").alias(name))
    x = count(posts, "tweet_count").join(count(follows, "following_count"), "user", "full").join(count(reposts, "retweet_count"), "user", "full")
    return x.select("user", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tweet_count", "following_count", "retweet_count")])


def tickets_of(df: DataFrame, user: str, status: str | None = None) -> DataFrame:
    x = df.filter(F.col("created_by") == user)
    return x if status is None else x.filter(F.lower("status") == status.lower())


# --- travel and cars

def flight_cost(base: Column, travel_class: Column, date: Column) -> Column:
    """Base price by class, doubled on dates whose digits sum up to an even number; null for an unknown class."""
    digits = F.split(F.regexp_replace(date, r"\D", ""), "")
    total = F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda a, d: a + d.cast("int"))
    factor = F.try_element_at(F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv]), travel_class)
    return (base * factor * F.when(total % 2 == 0, 2).otherwise(1)).cast("double")


def exchanged(source: Column, target: Column, value: Column) -> Column:
    """Value in another currency; one of the two is USD. Towards USD it is rounded to cents; null for unknown pairs."""
    rates = F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv])
    return F.when(source == "USD", value * F.try_element_at(rates, target)).when(target == "USD", F.round(value / F.try_element_at(rates, source), 2))


def zip_of(city: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ZIPS.items() for x in kv]), city), F.lit("00000"))


def distance(a: Column, b: Column) -> Column:
    """Distance of two places in either order, null if it isn't known."""
    table = F.create_map(*[x for p, q, d in DISTANCES for x in (F.lit("|".join(sorted((p, q)))), F.lit(d))])
    return F.try_element_at(table, F.concat_ws("|", F.least(a, b), F.greatest(a, b)))


def healthy_pressure(*tires: Column) -> Column:
    return (sum(tires[1:], tires[0]) / len(tires)).between(30, 35)


# --- memories

#: One row per operation: entity, seq, op (a method of the tool), args (JSON).
MEMORY_SCHEMA = "entity {kind}, state string, refused long"


def replay_memory(ops: DataFrame, tool: str, snapshot: DataFrame | None = None) -> DataFrame:
    """(entity, state, refused): the state (JSON) of each entity's memory after its operations in order, and how many were refused.

    Rows are dealt by entity, sorted there and consumed one by one: a task holds one memory at a time, whose size is
    capped. ``snapshot`` (entity, state) gives where memories start; without it they start empty.
    """
    kind = dict(ops.dtypes)["entity"]
    x = ops.select("entity", "seq", "op", "args")
    if snapshot is not None:
        first = snapshot.select("entity", F.lit(None).cast(dict(ops.dtypes)["seq"]).alias("seq"), F.lit("").alias("op"), F.col("state").alias("args"))
        x = first.unionByName(x)

    def done(entity, memory: B.Tool, refused: int) -> pd.DataFrame:
        return pd.DataFrame([(entity, json.dumps(memory.state, sort_keys=True), refused)], columns=["entity", "state", "refused"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, memory, refused = None, None, 0
        for pdf in batches:
            for entity, _, op, args in pdf.itertuples(index=False):
                if memory is None or entity != now:
                    if memory is not None:
                        yield done(now, memory, refused)
                    now, memory, refused = entity, B.TOOLS[tool](), 0
                if not op:
                    memory.state = memory.state | json.loads(args)
                    continue
                try:
                    getattr(memory, op)(**json.loads(args))
                except B.Refused:
                    refused += 1
        if memory is not None:
            yield done(now, memory, refused)

    return x.repartition("entity").sortWithinPartitions("entity", F.asc_nulls_first("seq")).mapInPandas(run, MEMORY_SCHEMA.format(kind=kind))


def snake_case(key: Column) -> Column:
    return key.rlike(B.KeyValueMemory.KEY.pattern)


def tree_lines(files: DataFrame, path: str, root: str) -> DataFrame:
    """(at, line): a folder's tree, folders as ``+ name/`` and files as ``- name``, four spaces a level, in order of ``at``."""
    rel = F.substr(path, F.lit(len(root.rstrip("/")) + 2))
    parts = F.split(rel, "/")
    x = files.filter(F.col(path).startswith(root.rstrip("/") + "/")).select(parts.alias("p"))
    pad = lambda n: F.repeat(F.lit("    "), n)
    name = lambda p: F.element_at(p, -1)
    file = x.select(F.array_join("p", "/").alias("at"), F.concat(pad(F.size("p") - 1), F.lit("    - "), name(F.col("p"))).alias("line"))
    folder = x.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda n: F.slice("p", 1, n))).alias("d"), F.size("p").alias("n")).filter("n > 1")
    folder = folder.select("d").distinct().select(F.concat(F.array_join("d", "/"), F.lit("/")).alias("at"), F.concat(pad(F.size("d")), F.lit("+ "), name(F.col("d")), F.lit("/")).alias("line"))
    return folder.unionByName(file)


def exceeds(files: DataFrame, size: str, megabytes: int = 200) -> bool:
    return (files.agg(F.sum(size)).head()[0] or 0) >= megabytes * 1024 * 1024


def valid_name(name: Column) -> Column:
    return ~name.rlike("[" + re.escape("|/\\?%*:\"><") + "]")
