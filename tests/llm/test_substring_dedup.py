import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from llm_cases import edge_docs, edge_rows, no_docs  # noqa: F401
from lastmile.llm import substring_dedup as S
from lastmile.llm import fm_index
from lastmile.llm.common import AT_ONCE, BATCH_ROWS, mapped
from lastmile.llm.fm_index import FMIndex, Wavelet, matched, suffix_order


def brute(texts, window):
    split = [t.encode().split() if t else [] for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def test_wavelet_rank_counts_symbols():
    rng = np.random.default_rng(1)
    text = rng.zipf(1.5, 3000) % 50
    tree = Wavelet(text, 50)
    symbol, place = rng.integers(0, 50, 400), rng.integers(0, 3001, (2, 400))
    symbol = np.where(np.isin(symbol, text), symbol, text[0])
    want = [[int((text[:p] == s).sum()) for s, p in zip(symbol, row, strict=True)] for row in place]
    assert tree.rank(symbol, place).tolist() == want


def test_suffixes_sort_alike_with_very_many_symbols(monkeypatch):
    text = np.random.default_rng(4).integers(0, 40, 2000).astype(np.int32)
    order = suffix_order(text, 48)
    monkeypatch.setattr(fm_index, "MOST_TRIPLED", 1)
    assert suffix_order(text, 48).tolist() == order.tolist()
    many = np.random.default_rng(5).permutation(1 << 21).astype(np.int32)
    assert (many[suffix_order(many, 48)] == np.arange(1 << 21)).all()


@pytest.mark.parametrize("piece", [1, 7, 96])
def test_matches_are_those_that_occur_often_enough(monkeypatch, piece):
    monkeypatch.setattr(fm_index, "PIECE_WINDOWS", piece)
    rng = np.random.default_rng(2)
    parts = [rng.integers(1, 4, rng.integers(1, 60)) for _ in range(30)]
    text = np.concatenate([np.append(p, 0) for p in parts])
    end = np.cumsum([len(p) + 1 for p in parts]) - 1
    start = end - [len(p) for p in parts]
    least = 9
    seen = Counter(tuple(p[k : k + least]) for p in parts for k in range(len(p) - least + 1))
    want = np.zeros(len(text), bool)
    for a, p in zip(start, parts, strict=True):
        for k in range(len(p) - least + 1):
            if seen[tuple(p[k : k + least])] > 1:
                want[a + k : a + k + least] = True
    index = FMIndex(text.astype(np.int32), 4, np.ones(len(text), np.int64))
    got = matched(index, text.astype(np.int32), start, end, np.full(len(parts), 2), least)
    assert got.tolist() == want.tolist()


@pytest.mark.parametrize(("vocabulary", "window", "block"), [(2, 12, 3), (30, 35, 20_000)])
def test_same_words_go_as_by_brute_force(spark, monkeypatch, vocabulary, window, block):
    rnd = random.Random(vocabulary)
    word = lambda: str(rnd.randrange(vocabulary))
    base = [[word() for _ in range(rnd.randrange(120))] for _ in range(20)]
    texts = [" ".join([*rnd.choice(base)[rnd.randrange(40) :][: rnd.randrange(1, 100)], word(), *rnd.choice(base)]) for _ in range(50)]
    texts += ["", None, " a", "x " * 200, "x " * 200, "y " * 90]
    monkeypatch.setattr(S, "SHARD_WORDS", 500)
    repeats = S.repeats
    monkeypatch.setattr(S, "repeats", lambda docs, key, text, w: repeats(docs, key, text, w, block))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in S.digests(docs, window=window).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, window)


def test_edge_cases(edge_docs, edge_rows, no_docs):
    want = Counter((r[0], *x) for r, x in zip(edge_rows, brute([r[1] for r in edge_rows], S.WINDOW), strict=True))
    assert Counter(map(tuple, S.digests(edge_docs).collect())) == want
    assert S.digests(no_docs).count() == 0
    shorter = S.remove_repeats(edge_docs)
    assert shorter.columns == edge_docs.columns
    kept = Counter((r["doc_id"], hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest()) for r in shorter.collect())
    assert kept == Counter((k[0], k[3]) for k in want.elements())


def test_python_tasks_get_few_texts_at_once(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    rows = spark.range(0, 3 * AT_ONCE + 1, numPartitions=1)
    before = spark.conf.get(BATCH_ROWS, None)
    try:
        for held in (None, str(10 * AT_ONCE)):
            spark.conf.unset(BATCH_ROWS) if held is None else spark.conf.set(BATCH_ROWS, held)
            assert [r["n"] for r in mapped(rows, sizes, "n long").collect()] == [AT_ONCE] * 3 + [1]
            assert spark.conf.get(BATCH_ROWS, None) == (held or str(AT_ONCE))
    finally:
        spark.conf.unset(BATCH_ROWS) if before is None else spark.conf.set(BATCH_ROWS, before)


def exchanges(node):
    """The shuffles of an executed plan."""
    name = node.nodeName()
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else []
    found = [node] if name == "Exchange" else []
    below = node.children()
    for x in [*inner, *[below.apply(k) for k in range(below.size())]]:
        found += exchanges(x)
    return found


def test_texts_without_a_repeat_are_not_shuffled(spark):
    own = lambda k: " ".join(f"d{k}w{n}" for n in range(60))
    both = " ".join(f"w{n}" for n in range(50))
    texts = {k: own(k) for k in range(200)} | {200: f"{own(200)} {both}", 201: f"{both} {own(201)}", 202: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for done, want in ((S.remove_repeats(docs), {**texts, 200: own(200), 201: own(201)}), (S.digests(docs), None)):
            got = {r[0]: r[1] for r in done.collect()}
            assert len(got) == len(texts) and (want is None or got == want)
            moved = [x.metrics().apply("shuffleRecordsWritten").value() for x in exchanges(done._jdf.queryExecution().executedPlan()) if "text#" in x.output().toString()]
            assert moved and max(moved) <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
