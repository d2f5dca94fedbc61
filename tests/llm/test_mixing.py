from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from llm_cases import edge_docs, edge_rows, no_docs  # noqa: F401
from lastmile.llm.mixing import mix, take


def by_rounds(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """The shares by their definition: cap, share the excess anew, until none is above."""
    target, free, left = {}, dict(sizes), share * sum(sizes.values())
    weight = {s: weights[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    while free:
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if part[s] > most * sizes[s]]
        if not above:
            return target | part
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
            del free[s]
    return target


def test_targets_and_taken_words(spark, edge_docs):
    more = spark.range(3000).select(
        (F.col("id") + 100).alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 50).cast("int")).alias("text"),
        F.concat(F.lit("src"), (F.col("id") % 7).cast("string")).alias("source"))
    docs = edge_docs.select("doc_id", "text", "source").unionByName(more)
    rows = mix(docs, ranges=16).select("doc_id", "source", "_mix.*").collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = by_rounds(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 0.5
    again = mix(docs.repartition(5), ranges=16).select("doc_id", "source", "_mix.*").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_rows_of_the_mix(edge_docs, no_docs):
    rows = take(edge_docs)
    assert rows.columns == edge_docs.columns
    words = rows.select(F.sum(F.size(F.expr("filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x != '')")))).first()[0]
    assert words == mix(edge_docs).agg(F.sum("_mix.taken")).first()[0]
    assert take(no_docs).count() == 0
