"""Accuracy, weighted means with missing categories, cost and latency, leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the overall score, and price of an hour of the serving machine over the requests it takes at once.
OVERALL_WEIGHTS = {"non_live": 10, "live": 10, "irrelevance": 10, "multi_turn": 30, "agentic": 40}
GPU_HOUR, GPU_REQUESTS = 23.92, 100


def accuracy(results: DataFrame, *keys: str) -> DataFrame:
    """accuracy, correct_count and total_count per key; partial sums before the shuffle."""
    return results.groupBy(*keys).agg(F.avg(F.col("valid").cast("int")).alias("accuracy"), F.sum(F.col("valid").cast("int")).alias("correct_count"), F.count("*").alias("total_count"))


def with_missing(scores: DataFrame, models: DataFrame, categories: DataFrame) -> DataFrame:
    """A row for each model and category: accuracy 0 and is_na where it has none. ``categories`` is a small fixed list."""
    full = models.select("model").distinct().crossJoin(F.broadcast(categories.select("category", "size")))
    got = full.join(scores, ["model", "category"], "left")
    return got.select("model", "category", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), F.coalesce("total_count", "size").alias("total_count"), F.col("accuracy").isNull().alias("is_na"))


def weighted(scores: DataFrame, *keys: str) -> DataFrame:
    return scores.groupBy(*keys).agg(F.try_divide(F.sum(F.col("accuracy") * F.col("total_count")), F.sum("total_count")).alias("accuracy"), F.sum("total_count").alias("total_count"), F.bool_or("is_na").alias("is_na"))


def unweighted(scores: DataFrame, *keys: str) -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg("accuracy").alias("accuracy"), F.sum("total_count").alias("total_count"), F.bool_or("is_na").alias("is_na"))


def percent_weighted(scores: DataFrame, weights: dict[str, float], key: str, *keys: str) -> DataFrame:
    """Mean of ``accuracy`` with fixed weights by the value of ``key``, normalised to one."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return scores.groupBy(*keys).agg((F.sum(F.col("accuracy") * F.try_element_at(w, F.col(key))) / float(sum(weights.values()))).alias("accuracy"), F.sum("total_count").alias("total_count"), F.bool_or("is_na").alias("is_na"))


def display(value: Column, is_na: Column) -> Column:
    return F.when(is_na, "N/A").otherwise(F.format_string("%.2f%%", value * 100))


def latency_stats(results: DataFrame, col: str, *keys: str) -> DataFrame:
    """mean, sample deviation and 95th percentile of the values in a nested array column, without zeros and nulls."""
    x = F.filter(F.flatten(col), lambda v: v != 0)
    return results.select(*keys, F.explode(x).alias("v")).groupBy(*keys).agg(F.round(F.avg("v"), 2).alias("mean"), F.round(F.stddev_samp("v"), 2).alias("std"), F.round(F.percentile("v", 0.95), 2).alias("p95"))


def api_cost(results: DataFrame, prices: DataFrame) -> DataFrame:
    """USD per model from token sums and prices per million; ``prices`` is a registry of models."""
    s = results.groupBy("model").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    return s.join(F.broadcast(prices), "model").select("model", F.round(F.col("i") * F.col("input_price") / 1e6 + F.col("o") * F.col("output_price") / 1e6, 6).alias("cost"))


def gpu_cost(results: DataFrame) -> DataFrame:
    return results.groupBy("model").agg(F.round(F.sum("latency") / 3600 * GPU_HOUR / GPU_REQUESTS, 4).alias("cost"))


def config_spread(results: DataFrame) -> DataFrame:
    """Spread of the accuracies of prompt configurations per model, in percent; 0 with a single configuration."""
    per = results.groupBy("model", "config").agg(F.avg(F.col("valid").cast("int")).alias("a"))
    one = lambda c: F.when(F.count("a") > 1, c * 100).otherwise(0.0)
    return per.groupBy("model").agg(F.avg("a").alias("accuracy"), one(F.max("a") - F.min("a")).alias("max_delta"), one(F.var_samp("a")).alias("variance"), one(F.stddev_samp("a")).alias("std"))


def ranked(scores: DataFrame, by: str, name: str) -> DataFrame:
    """rank by ``by`` descending, nulls last. A leaderboard has a row per model, so one task ranks it."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(by), name)))
