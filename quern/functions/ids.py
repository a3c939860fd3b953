"""Test categories and entry ids: predicates, groups, parts, sort keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def has(c: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


#: Substring tests on a category; "relevance" is part of "irrelevance" as well, and that is kept.
PREDICATES = {
    "is_format_sensitivity": lambda c: has(c, "format_sensitivity"),
    "is_web_search": lambda c: has(c, "web_search"),
    "is_memory": lambda c: has(c, "memory"),
    "is_memory_prereq": lambda c: has(c, "prereq"),
    "is_first_memory_prereq": lambda c: has(c, "prereq") & c.endswith("-0"),
    "is_agentic": lambda c: has(c, "web_search", "memory"),
    "is_multi_turn": lambda c: has(c, "multi_turn"),
    "is_live": lambda c: has(c, "live"),
    "is_non_live": lambda c: ~has(c, "format_sensitivity", "live", "multi_turn", "web_search", "memory"),
    "is_multi_turn_irrelevance": lambda c: has(c, "miss_func", "miss_param"),
    "is_executable": lambda c: has(c, "exec", "rest"),
    "is_rest": lambda c: has(c, "rest"),
    "is_relevance": lambda c: has(c, "relevance"),
    "is_chatable": lambda c: has(c, "chatable"),
    "is_java": lambda c: has(c, "java") & ~has(c, "javascript"),
    "is_js": lambda c: has(c, "javascript"),
    "is_sql": lambda c: has(c, "sql"),
    "is_interactive": lambda c: has(c, "multi_turn", "web_search", "memory"),
}


def group_of(c: Column) -> Column:
    """One of five groups; the order of the tests matters."""
    p = PREDICATES
    return (
        F.when(p["is_format_sensitivity"](c), "format_sensitivity").when(p["is_non_live"](c), "non_live").when(p["is_live"](c), "live")
        .when(p["is_multi_turn"](c), "multi_turn").when(p["is_agentic"](c), "agentic")
    )


def category_of(entry_id: Column, drop_prereq: bool = False) -> Column:
    """What stands before the last underscore of the part before the first colon."""
    x = F.replace(entry_id, F.lit("_prereq"), F.lit("")) if drop_prereq else entry_id
    return F.regexp_extract(F.substring_index(x, ":", 1), r"^(.*)_[^_]*$", 1)


def config_of(entry_id: Column, default: str) -> Column:
    """The middle one of three colon-separated parts, or the default."""
    return F.when(entry_id.contains(":"), F.split_part(entry_id, F.lit(":"), F.lit(2))).otherwise(default)


def index_of(entry_id: Column) -> Column:
    """The number after the last underscore, before a dash."""
    return F.regexp_extract(F.substring_index(entry_id, ":", 1), r"_(\d+)(?:-\d+-\d+)?$", 1).cast("int")


def sort_priority(category: Column) -> Column:
    p = PREDICATES
    return F.when(p["is_memory_prereq"](category), 0).when(p["is_web_search"](category), 1).when(~p["is_interactive"](category), 2).when(p["is_multi_turn"](category), 3).otherwise(4)


def file_category(name: Column, prefix: str) -> Column:
    """The category in a result or score file's name."""
    return F.nullif(F.regexp_extract(name, rf".*{prefix}_(\w+?)(?:_score|_result)?\.json", 1), F.lit(""))
