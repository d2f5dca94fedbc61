import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from llm_cases import edge_docs, edge_rows, no_docs  # noqa: F401
from pyspark.sql import functions as F

from lastmile.llm import periodic_runs as R
from lastmile.llm.suffix_tree import CommonExtensions, SuffixTree
from lastmile.llm.word_hashes import WordHashes

SMOKE = "/root/testdata/sf0.001"


def brute(words, least=6, times=4):
    """Every period in rising order; a stretch found with a smaller one is not a run of a larger one."""
    out, seen = [], set()
    for q in range(1, len(words) // times + 1):
        at = 0
        while at + q < len(words):
            start = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            length = at + q - start
            if at > start and length >= max(least, times * q) and (start, length) not in seen:
                seen.add((start, length))
                out.append((start, length, q))
            at += at == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitious(rnd, n):
    letters, out = "abcdefgh"[: rnd.randrange(1, 6)], []
    while len(out) < n:
        part = [rnd.choice(letters) for _ in range(rnd.randrange(1, 9))]
        out += (part * 9)[: rnd.randrange(1, 40)] if rnd.random() < 0.5 else part
    return out[:n]


def test_suffix_tree_orders_suffixes_and_extends():
    rnd = random.Random(2)
    for _ in range(200):
        text = np.array([rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 60))])
        whole = [*text.tolist(), 0]
        leaves, _ = SuffixTree(text).walk()
        assert leaves.tolist() == sorted(range(len(whole)), key=lambda k: whole[k:])
        if len(text) > 1:
            a, b = np.array([rnd.sample(range(len(text)), 2) for _ in range(40)]).T
            want = [next(k for k in range(99) if whole[x + k : x + k + 1] != whole[y + k : y + k + 1]) for x, y in zip(a, b)]
            assert CommonExtensions(text).of(a, b).tolist() == want


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (5, 3)])
def test_runs_are_those_by_brute_force(least, times):
    rnd, hashes = random.Random(5), WordHashes()
    texts = [repetitious(rnd, rnd.randrange(0, 80)) for _ in range(1500)]
    found = R.find_runs([" ".join(t) for t in texts], hashes, least, times)
    for text, (words, spans) in zip(texts, found, strict=True):
        assert [w.decode() for w in words] == text
        assert [tuple(x) for x in spans.tolist()] == brute(text, least, times)


def test_slices_change_nothing(monkeypatch):
    rnd = random.Random(6)
    texts = [" ".join(repetitious(rnd, rnd.randrange(0, 50))) for _ in range(60)]
    want = [spans.tolist() for _, spans in R.find_runs(texts, WordHashes())]
    monkeypatch.setattr(R, "SLICE", 7)
    assert [spans.tolist() for _, spans in R.find_runs(texts, WordHashes())] == want


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    milli = 1000 * longest[1] // longest[2] if runs else None
    return (doc_id, len(runs), *longest, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_is_brute_force(spark, monkeypatch):
    rows = duckdb.sql(f"select doc_id, text from '{SMOKE}/documents.parquet'").fetchall()
    got = Counter(map(tuple, R.op13_periodic_runs(spark, SMOKE).collect()))
    assert got == Counter(expected(*r) for r in rows)
    assert any(r[1] for r in got)


def test_edges(spark, edge_docs, edge_rows, no_docs, monkeypatch):
    monkeypatch.setattr(R, "table", lambda *_: edge_docs)
    assert Counter(map(tuple, R.op13_periodic_runs(spark, "").collect())) == Counter(expected(r[0], r[1]) for r in edge_rows)
    monkeypatch.setattr(R, "table", lambda *_: no_docs)
    assert R.op13_periodic_runs(spark, "").count() == 0


def test_collapse_keeps_columns_and_other_texts(spark):
    rows = [(1, "a b  a b a b a b\tc", "x"), (2, "  plain   text ", "y"), (3, None, "z"), (4, "w " * 20_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    out = {r["doc_id"]: (r["text"], r["found"]) for r in R.collapse_runs(docs).collect()}
    assert R.collapse_runs(docs).columns == docs.columns
    assert out == {1: ("a b c", "x"), 2: ("  plain   text ", "y"), 3: (None, "z"), 4: ("w", "q")}
    spans = docs.where("doc_id = 1").select(R.periodic_runs(F.col("text")).alias("r")).first()["r"]["runs"]
    assert [tuple(x) for x in spans] == [(0, 8, 2)]
