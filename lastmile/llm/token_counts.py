"""Greedy word-piece counts by a longest-match automaton, in one pass over a word's bytes.

The vocabulary is held as a trie over UTF-8 bytes. Each node knows the node to go on from when no edge fits
(its failure link) and how many pieces are settled by going there (its pops); both are worked out
once, breadth first. A word then costs one step per byte plus its pops, and no piece is ever cut out.

A word is matched with the word-start mark in front. All 256 single bytes are pieces, as in the byte
fallback of the vocabulary, so every word can be matched.

Defined cases: null, empty and blank texts have no words and no pieces; repeated rows are counted each;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastmile.llm.common import table

START = "▁".encode()
REMEMBERED = 500_000  # words whose count a task remembers at once


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[bytes]:
    """The text pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [model.id_to_piece(i).encode() for i in plain]


class Automaton:
    """Counts the pieces of greedy longest match from the left."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.edges: dict[int, int] = {}  # (node << 8 | byte) -> node; node 0 is the root
        ends, parents = [False], [(0, 0)]
        for piece in [*(bytes([b]) for b in range(256)), *vocabulary]:
            node = 0
            for byte in piece:
                after = self.edges.get(node << 8 | byte)
                if after is None:
                    after = self.edges[node << 8 | byte] = len(ends)
                    ends.append(False)
                    parents.append((node, byte))
                node = after
            ends[node] = node != 0
        self.link, self.pops = [0] * len(ends), [0] * len(ends)
        depth = [0] * len(ends)
        for node in range(1, len(ends)):
            depth[node] = depth[parents[node][0]] + 1
        for node in sorted(range(1, len(ends)), key=depth.__getitem__):
            if ends[node]:
                self.pops[node] = 1  # the whole string is a piece; nothing is left over
                continue
            up, byte = parents[node]
            at, pops = self.link[up], self.pops[up]
            while (after := self.edges.get(at << 8 | byte)) is None:
                pops += self.pops[at]
                at = self.link[at]
            self.link[node], self.pops[node] = after, pops

    def count(self, word: bytes) -> int:
        edges, link, pops = self.edges, self.link, self.pops
        node = total = 0
        for byte in word:
            while (after := edges.get(node << 8 | byte)) is None:
                total += pops[node]
                node = link[node]
            node = after
        while node:
            total += pops[node]
            node = link[node]
        return total


class Remembered(dict):
    """Counts by word, forgotten when there are too many."""

    def __init__(self, automaton: Automaton, most: int = REMEMBERED):
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = self.automaton.count(START + word)
        return found


def count_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_words, n_pieces) of every row."""
    path = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Remembered(Automaton(load_pieces(path)))
        for batch in batches:
            found = [body.encode().split() if body else [] for body in batch.column(1).to_pylist()]
            n_words = pa.array([len(x) for x in found], pa.int64())
            n_pieces = pa.array([sum(map(counts.__getitem__, x)) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_words, n_pieces], names=["doc_id", "n_words", "n_pieces"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_words long, n_pieces long").withColumnRenamed("doc_id", key)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_pieces(table(spark, sf_dir, "documents"))
