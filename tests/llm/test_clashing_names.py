"""User columns pass through unchanged, also those named like an operator's temporaries."""

import random

from pyspark.sql import functions as F

from llm_cases import sentence
from lastmile.llm.mixing import mix, take
from lastmile.llm.quality import judge
from lastmile.llm.sharding import number_slots
from lastmile.llm.substring_dedup import remove_repeats

NAMES = (
    "_words _lines _word_chars _rest _counts _line _short _times _shares _by_class _by_word _base _repeats _hashes _windows _placed _starts "
    "_src _size _crc _key _range _run _start _source_size _target _id _spans _bucket _within _n a.b"
).split()


def rows(spark):
    rnd = random.Random(8)
    common = sentence(rnd, 60)
    texts = [sentence(rnd, 80) + (" " + common if k % 2 else "") for k in range(8)] + [None, ""]
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 2}") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    return docs.select("*", *[F.concat(F.lit(f"{name} "), F.col("doc_id")).alias(name) for name in NAMES])


def unchanged(got, docs):
    assert got.columns[: len(docs.columns)] == docs.columns
    found = got.collect()
    assert found and all(r[name] == f"{name} {r['doc_id']}" for r in found for name in NAMES)
    return found


def test_user_columns_pass_through(spark):
    docs = rows(spark)
    plain = docs.select("doc_id", "text", "lang", "source")
    same = lambda a, b, *cols: sorted(map(str, a)) == sorted(map(str, b.select(*cols).collect()))
    assert same([r["_quality"] for r in unchanged(judge(docs), docs)], judge(plain), "_quality.*")
    assert same([r["_mix"] for r in unchanged(mix(docs), docs)], mix(plain), "_mix.*")
    assert len(unchanged(take(docs), docs)) == take(plain).count()
    left = {r["doc_id"]: r["text"] for r in unchanged(remove_repeats(docs), docs)}
    assert left == {r["doc_id"]: r["text"] for r in remove_repeats(plain).collect()}
    assert len(left[1].split()) == 80
    slots = {r["doc_id"]: r["slot"] for r in unchanged(number_slots(docs, "source", ["doc_id"], "slot", 4), docs)}
    assert sorted(slots[k] for k in range(0, 10, 2)) == sorted(slots[k] for k in range(1, 10, 2)) == [0, 1, 2, 3, 4]


def test_a_column_named_like_the_result_is_replaced(spark):
    docs = rows(spark).select("doc_id", "text", "lang", "source", F.lit(1).alias("_quality"), F.lit(1).alias("_mix"))
    assert judge(docs).columns == ["doc_id", "text", "lang", "source", "_mix", "_quality"]
    assert mix(docs).columns == ["doc_id", "text", "lang", "source", "_quality", "_mix"]
    assert take(docs).columns == docs.columns
