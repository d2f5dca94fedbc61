import random

from llm_cases import edge_docs, edge_rows, no_docs  # noqa: F401
from lastmile.llm import token_counts as T


def greedy(word, vocabulary):
    n = at = 0
    while at < len(word):
        at += max(k for k in range(1, len(word) - at + 1) if word[at : at + k] in vocabulary)
        n += 1
    return n


def test_automaton_counts_greedy_pieces():
    rnd = random.Random(1)
    vocabulary = {bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(2, 7))) for _ in range(60)}
    automaton = T.Automaton(vocabulary)
    known = vocabulary | {bytes([b]) for b in range(256)}
    for _ in range(2000):
        word = bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(0, 30)))
        assert automaton.count(word) == greedy(word, known)


def test_whole_texts(edge_docs, edge_rows, no_docs):
    known = set(T.load_pieces(T.default_path())) | {bytes([b]) for b in range(256)}
    want = sorted(str((r[0], len((r[1] or "").encode().split()), sum(greedy(T.START + w, known) for w in (r[1] or "").encode().split()))) for r in edge_rows)
    assert sorted(str(tuple(r)) for r in T.count_pieces(edge_docs).collect()) == want
    assert T.count_pieces(no_docs).count() == 0


def test_remembered_words_are_bounded():
    counts = T.Remembered(T.Automaton([b"ab"]), most=10)
    assert [counts[b"ab" * k] for k in range(1, 40)] == [greedy(T.START + b"ab" * k, {b"ab"} | {bytes([b]) for b in range(256)}) for k in range(1, 40)]
    assert len(counts) <= 10
