"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm._common import drop_stash, release, stash, stashed_now, table
from quern.llm.decontaminate import drop_contaminated
from quern.llm.exact_dedup import drop_copies
from quern.llm.packing import mixture_packed
from quern.llm.simhash import drop_near_copies
from quern.llm.toxicity import keep_clean, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest id stays."""
    return drop_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, by a Jaccard similarity of five-word shingles of 0.8, one document of each group stays."""
    return drop_near_copies(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, in windows of mixed sources."""
    return mixture_packed(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination), ("packing", packing)]
#: SQL cannot express the classifiers, the fingerprints and the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows of ``documents``.

    Each stage's result is written, and what it wrote on the way is deleted then. Null and empty texts pass all filters
    but that of copies, which keeps one of them; so do null ids, but where a copy has an id. Repeated rows are copies.
    Without documents there are no pieces; without labels no document is rejected, without items none is contaminated.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        mark = stashed_now()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs)
            drop_stash(mark, docs)
            if before is not None:
                release(before)
            before = docs
    return docs
