from collections import Counter, defaultdict

from pyspark.sql import functions as F

from llm_cases import edge_docs, edge_rows, no_docs  # noqa: F401
from lastmile.llm.sharding import jump_shard, number_slots, op2_sharding, place


def test_a_new_shard_takes_rows_only_into_itself(spark):
    keys = spark.range(20_000)
    rows = keys.select("id", *[jump_shard(F.col("id"), n).alias(f"n{n}") for n in (1, 2, 9, 10, 11)]).collect()
    for r in rows:
        assert r["n1"] == 0 and 0 <= r["n9"] < 9
        assert r["n2"] in (0, 1)
        assert r["n10"] in (r["n9"], 9)
        assert r["n11"] in (r["n10"], 10)
    held = Counter(r["n10"] for r in rows)
    assert max(held.values()) < 1.15 * min(held.values())


def test_slots_are_gapless(spark):
    df = spark.range(5000).select((F.col("id") % 3).cast("int").alias("shard"), F.col("id").alias("doc_id"))
    slots = defaultdict(list)
    for r in number_slots(df, "shard", ["doc_id"], "slot", 8).collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_edge_cases(spark, edge_docs, no_docs, tmp_path):
    assert place(no_docs).count() == 0
    edge_docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op2_sharding(spark, str(tmp_path)).collect()
    assert len(rows) == edge_docs.count()
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 0} == {(8, 0)}
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
