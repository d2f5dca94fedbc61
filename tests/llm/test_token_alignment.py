import hashlib
import random
from collections import Counter

import duckdb
import pytest
from llm_cases import edge_docs, edge_rows, no_docs  # noqa: F401

from lastmile.llm import token_alignment as A

SMOKE = "/root/testdata/sf0.001"
HARD = ["a", "  x", "x ", "<|endoftext|> <s> </s>", "odd ▁ mark", "漢字 čaj 😀 ok", "\x00z", "x" * 700, "tab\t\n\r  \x0b a", " " * 300 + "q", "a \tb", "a\t b", "a\xa0 b", "a \xa0b", "\n \n", "don't we'll 12345 ...!!"]


@pytest.fixture(scope="module")
def aligner():
    return A.Aligner(*A.all_paths(None))


def tokens(aligner, text):
    """Ids of both sides by the libraries themselves, on the whole text."""
    whole = " " + text
    ids = aligner.a.full.encode(whole, add_special_tokens=False).ids, aligner.b.model.encode(text)
    sides = [[(k, x.bytes[k]) for k in found] for x, found in zip((aligner.a, aligner.b), ids, strict=True)]
    return sides if all(b"".join(raw for _, raw in side) == whole.encode() for side in sides) else [[], []]


def ends(side):
    at = 0
    for k, raw in side:
        yield k, at, at + len(raw)
        at += len(raw)


def brute(aligner, text):
    """Groups and links by comparing every token's byte range."""
    a, b = (list(ends(side)) for side in tokens(aligner, text)) if text else ([], [])
    shared = sorted({x[2] for x in a} & {x[2] for x in b})
    groups = []
    for low, high in zip([0, *shared], shared):
        groups.append("|".join(",".join(str(k) for k, start, end in side if low <= start and end <= high) for side in (a, b)))
    links = Counter((x, y) for x, s, e in a for y, t, f in b if s < f and t < e)
    return len(a), len(b), len(groups), links, ";".join(groups)


def expected(aligner, rows):
    found = [(doc_id, *brute(aligner, text)) for doc_id, text in rows]
    total = sum((x[4] for x in found), Counter())
    best = {}
    for (_, b), n in total.items():
        best[b] = max(best.get(b, 0), n)
    out = Counter()
    for doc_id, n_a, n_b, n_groups, links, text in found:
        n_best = sum(n for (a, b), n in links.items() if total[a, b] == best[b])
        digest = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
        out[doc_id, n_a, n_b, n_groups, sum(links.values()), n_best, sum(total[x] * n for x, n in links.items()), digest] += 1
    return out


def test_align_on_random_ends():
    rnd = random.Random(1)
    for _ in range(3000):
        last = rnd.randrange(1, 60)
        a, b = (sorted({*rnd.sample(range(1, last + 1), rnd.randrange(last + 1)), last}) for _ in range(2))
        stretches, loose = A.align(a, b)
        one = [(i + k, j + k) for i, j, n in zip(*stretches, strict=True) for k in range(n)]
        assert [a[i] for i, _ in one] == [b[j] for _, j in one] == sorted(set(a) & set(b))
        every = sorted(set(a) | set(b))
        want = [(next(i for i, x in enumerate(a) if x >= e), next(j for j, x in enumerate(b) if x >= e)) for e in every]
        assert sorted([*one, *zip(*loose, strict=True)]) == want


def test_words_encoded_one_by_one_give_the_ids_of_the_whole(aligner):
    rnd = random.Random(7)
    odd = "a b\t\n\x0b\xa0é▁<|>'1.,-😀漢 　"
    texts = HARD + ["".join(rnd.choice(odd) for _ in range(rnd.randrange(1, 30))) for _ in range(600)]
    texts += [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' limit 300").fetchall()]
    for text, found in zip(texts, aligner.of(texts), strict=True):
        a, b = tokens(aligner, text)
        assert found.ids_a.tolist() == [k for k, _ in a], repr(text)
        assert found.ids_b.tolist() == [k for k, _ in b], repr(text)


@pytest.mark.parametrize("links", [A.CHUNK_LINKS, 500])
def test_documents_by_brute_force(spark, aligner, edge_docs, edge_rows, no_docs, monkeypatch, links):
    monkeypatch.setattr(A, "CHUNK_LINKS", links)
    more = [(1000 + k, t) for k, t in enumerate(HARD)]
    docs = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r[0], r[1]) for r in edge_rows if len(r[1] or "") < 5000]
    short = docs.where("text is null or length(text) < 5000")
    assert Counter(map(tuple, A.align_documents(short).collect())) == expected(aligner, rows + more)
    assert A.align_documents(no_docs).count() == 0


def test_link_table_and_groups(spark, aligner, edge_docs):
    docs = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, None)], "doc_id long, text string")
    total = brute(aligner, "a b")[3] + brute(aligner, "a  b")[3]
    assert {(r["a"], r["b"]): r["links"] for r in A.link_table(docs).collect()} == dict(total)
    rows = {r["doc_id"]: r for r in A.alignments(docs).collect()}
    assert len(rows[1]["last_a"]) == brute(aligner, "a b")[2] and rows[3]["ids_a"] == []


def test_a_very_long_text(aligner):
    text = " ".join(f"word{k % 977}" for k in range(200_000))
    found = next(iter(aligner.of([text])))
    assert len(found.link_a) == len(found.ids_a) + len(found.ids_b) - len(found.last_a)
    assert int(aligner.a.sizes[found.ids_a].sum()) == int(aligner.b.sizes[found.ids_b].sum()) == len(text) + 1
