"""The pipeline's stages in order, each by brute force on what it was given; the ten queries on the smallest tables."""

import pytest
from oracle_compare import both

import corpus_pipeline
from quern.llm import decontaminate, exact_dedup, packing, toxicity
from quern.llm._common import table
from quern.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    _, got, want = both(spark, QUERIES[name], ORACLE_SQL[name], SF)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_whole_table(spark, name):
    got = QUERIES[name](spark, SF)
    if name in ("op1_html_extract", "op4_toxicity", "op8_simhash", "op9_pii"):
        source = "pages" if name == "op1_html_extract" else "documents"
        assert got.count() == table(spark, SF, source).count()


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "decontamination", "packing"]
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], SF).cache())
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    assert all(s.columns == columns for s in steps[:-1])
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    chain = toxicity.train(docs, table(spark, SF, "labels"))
    clean = {i for i in ids[0] if chain.score(text[i])[-1] < toxicity.THRESHOLD}
    assert ids[1] == clean
    least = {}
    for i in sorted(clean):
        least.setdefault(_norm(text[i]), i)
    assert ids[2] == set(least.values())
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := _low(text[i]).split()) else set() for i in ids[2]}
    assert ids[3] == set(_components(sets, lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9).values())
    items = [decontaminate.word_numbers(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    bad = {i for i in ids[3] if any(_copied(w, decontaminate.word_numbers(text[i])) for w in items if len(w))}
    assert bad and ids[4] == ids[3] - bad and ids[5] == ids[4]
    assert corpus_pipeline.run(spark, SF).count() == steps[-1].count() == packing.mixture_packed(steps[4]).count()


def _copied(item, words):
    """Whether the best alignment of the item with the whole document is a copy: by Smith-Waterman without seeds."""
    if not len(words):
        return False
    _, matched, columns, _, _ = decontaminate.align(item, words)
    return matched >= max(0.6 * len(item), min(4, len(item))) and matched >= 0.6 * columns


def _norm(t):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def _low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in _norm(t))


def _components(fps, linked):
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if linked(fps[a], fps[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def test_exact_dedup_column_names(spark):
    docs = table(spark, SF, "documents").withColumn("_rows_with_id", exact_dedup.F.lit(1))
    assert exact_dedup.drop_copies(docs).columns == docs.columns
