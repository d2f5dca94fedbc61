from pyspark.sql import functions as F

from lastmile.llm import id_filter as I


def test_only_and_without_are_joins(spark):
    rows = spark.createDataFrame([(k if k % 11 else None, f"t{k}", k) for k in range(3000)] + [(5, "again", 7)], "doc_id int, place string, x_id long")
    for ids in (spark.range(0, 3000, 7).select((F.col("id") - 700).alias("n")), spark.range(0), spark.createDataFrame([(None,), (5,), (5,)], "a long")):
        listed = {r[0] for r in ids.collect()} - {None}
        got, rest = I.only(rows, ids, "doc_id"), I.without(rows, ids, "doc_id")
        assert got.columns == rest.columns == rows.columns
        every = list(map(tuple, rows.collect()))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for r in every if r[0] in listed)
        assert sorted(map(str, map(tuple, rest.collect()))) == sorted(str(r) for r in every if r[0] not in listed)


def test_unmarked_rows_are_told_apart_before_the_join(spark):
    rows = spark.range(100_000).withColumnRenamed("id", "doc_id")
    marked = I.marked(rows, spark.range(0, 1000), "doc_id", "maybe").where("maybe")
    assert 1000 <= marked.count() < 1100
