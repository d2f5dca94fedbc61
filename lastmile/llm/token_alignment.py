"""Alignment of two tokenizations of one text, and how often their tokens are linked over all documents.

Both tokenizers cut the same bytes, so a tokenization is the rising array of its tokens' end places. Where a token
of each ends at the same byte a group closes. Two token occurrences are linked where their bytes overlap.

Diagonal run skipping: while tokens go one to one, both arrays are equal at one shift between their indexes.
Blocks of doubling size are compared there until one differs, and the last is halved down to the
first difference; such a stretch takes a number of steps that grows with the log of its length. The irregular
group after it is resolved by moving on whichever token ends first, until both end together; that gives the new shift.

How often two ids are linked in the whole corpus is worked out in three steps. None of them sends a row per link:

1. Documents are tokenized and aligned once. The links of some millions are one chunk: its different id pairs, how
   often each occurs, and the links as places in that list, packed. A chunk is a row of a checkpointed table.
2. The chunks' pairs are summed over the corpus, partly before the shuffle; the best count of every B id follows.
   A pair stands once in a chunk, so the most frequent pair has no more rows than there are chunks.
3. Every chunk gets the counts of its own pairs and sums them over the links of its documents.

Defined cases: null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens:
zeros, and an empty digest; repeated rows are counted each; of several best A ids of one B id all are best; a
long text is one document whatever its length; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastmile.llm.common import cut, table
from lastmile.llm.tokenizing import OTHER, Encoder, default_paths

CHUNK_LINKS = 4_000_000
CHUNK_DOCUMENTS = 50_000
REMEMBERED = 200_000  # words whose ids a task remembers at once
SLICE = 1_000_000  # characters of the documents whose words are looked up together
#: Spaces beside which the words of a text cannot be encoded one by one.
SPACES = re.compile(r"\A | \s| \Z")

DOCUMENTS = "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>"
CHUNKS = f"chunk long, {DOCUMENTS}, links binary, pair array<long>, times array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PlainEncoder(Encoder):
    """Ids of a text in which the strings of special tokens are ordinary text."""

    def __init__(self, json_path: str, ranks_path: str):
        super().__init__(json_path, ranks_path)
        self.full.encode_special_tokens = True
        self.bytes = self.token_bytes()
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id. A byte that is no printable character stands as one from U+0100 on, in order."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
        names = self.full.get_vocab(with_added_tokens=True)
        out = [b""] * (max(names.values()) + 1)
        for name, k in names.items():
            out[k] = bytes(byte[c] for c in name)
        return out

    def exact(self, text: str, raw: bytes) -> np.ndarray | None:
        """Ids of a text; None where they do not give its bytes back."""
        if OTHER.search(text):
            ids = self.full.encode(text, add_special_tokens=False).ids
            same = b"".join(map(self.bytes.__getitem__, ids)) == raw
        else:
            ids = self.fast.encode_ordinary(text)
            same = self.fast.decode_bytes(ids) == raw
        return np.array(ids, np.int64) if same else None


class PieceEncoder:
    """Ids of texts with a space in front, as the model adds it.

    Words are encoded one by one and remembered where a text has no other white space beside its spaces: no piece
    goes on over a space, so the ids are those of the whole text. What is not known yet is encoded in one call.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(k) for k in range(self.model.get_piece_size())]
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.by_word = not any(b" " in piece.lstrip(b" ") for piece in self.bytes)
        self.known: dict[str, bytes | None] = {}

    def _bytes(self, k: int) -> bytes:
        """The bytes of an id; none for those that stand for no text."""
        if self.model.is_byte(k):
            return bytes([int(self.model.id_to_piece(k)[3:-1], 16)])
        if self.model.is_control(k) or self.model.is_unknown(k):
            return b""
        return self.model.id_to_piece(k).replace("▁", " ").encode()

    def _exact(self, texts: list[str]) -> list[bytes | None]:
        """Ids of each text, 32 bits each; None where they do not give its bytes back."""
        found = self.model.encode(texts, num_threads=1)
        raw = map(str.encode, texts)
        return [array("i", ids).tobytes() if b"".join(map(self.bytes.__getitem__, ids)) == b" " + x else None for x, ids in zip(raw, found, strict=True)]

    def exact(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        """Ids of each text; None where they do not give its bytes back."""
        parts = [x.split(" ") if self.by_word and len(x) <= SLICE and not SPACES.search(x) else [] for x in texts]
        words = set().union(*parts)
        fresh = words.difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = words
        fresh = sorted(fresh)  # words with one beginning follow each other, which the encoder is faster at
        self.known.update(zip(fresh, self._exact(fresh), strict=True))
        for text, part in zip(texts, parts, strict=True):
            found = list(map(self.known.__getitem__, part)) if part else self._exact([text])
            yield None if None in found else np.frombuffer(b"".join(found), np.int32).astype(np.int64)


def align(ends_a: list[int], ends_b: list[int]) -> tuple[list[list[int]], list[list[int]]]:
    """One-to-one stretches (first in a, first in b, length) and the other links (in a, in b).

    Both arrays rise and end with the same value. Every element of a stretch closes a group.
    """
    size = len(ends_a)
    ends_a, ends_b = [*ends_a, -1], [*ends_b, -2]  # two ends that differ close both
    first_a, first_b, lengths, loose_a, loose_b = [], [], [], [], []
    i = j = 0
    while i < size:
        if ends_a[i] == ends_b[j]:
            first, shift = i, j - i
            step = 1
            while ends_a[i : i + step] == ends_b[i + shift : i + shift + step]:
                i += step
                step += step
            while step > 1:
                step >>= 1
                if ends_a[i : i + step] == ends_b[i + shift : i + shift + step]:
                    i += step
            first_a.append(first)
            first_b.append(j)
            lengths.append(i - first)
            if i == size:
                break
            j = i + shift
        a, b = ends_a[i], ends_b[j]
        while a != b:
            loose_a.append(i)
            loose_b.append(j)
            if a < b:
                i += 1
                a = ends_a[i]
            else:
                j += 1
                b = ends_b[j]
    return [first_a, first_b, lengths], [loose_a, loose_b]


@dataclass
class Alignment:
    """Ids of both tokenizations, the places of the last A and B token of each group, and the links as places."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


NOTHING = Alignment(*[np.empty(0, np.int64)] * 6)


class Aligner:
    def __init__(self, json_path: str, ranks_path: str, piece_path: str):
        self.a, self.b = PlainEncoder(json_path, ranks_path), PieceEncoder(piece_path)
        # a token as it stands in the text of the groups: followed by a comma, or by what closes its side of a group
        sides = ((self.a.sizes, b"|"), (self.b.sizes, b";"))
        self.written = [b"%d%s" % (k, end) for of, close in sides for k in range(len(of)) for end in (b",", close)]

    def of(self, texts: Iterable[str | None]) -> Iterator[Alignment]:
        """The alignment of each text; the texts are taken some at a time."""
        held: list[str | None] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= SLICE:
                yield from self._of_some(held)
                held, size = [], 0
        yield from self._of_some(held)

    def _of_some(self, texts: list[str | None]) -> Iterator[Alignment]:
        pieces = self.b.exact([text for text in texts if text])
        for text in texts:
            if not text:
                yield NOTHING
                continue
            whole, ids_b = " " + text, next(pieces)
            ids_a = None if ids_b is None else self.a.exact(whole, whole.encode())
            yield NOTHING if ids_a is None else self.aligned(ids_a, ids_b)

    def aligned(self, ids_a: np.ndarray, ids_b: np.ndarray) -> Alignment:
        stretches, loose = align(np.cumsum(self.a.sizes[ids_a]).tolist(), np.cumsum(self.b.sizes[ids_b]).tolist())
        first_a, first_b, length = (np.array(x, np.int64) for x in stretches)
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        last_a, last_b = np.repeat(first_a, length) + inside, np.repeat(first_b, length) + inside
        link_a, link_b = (np.concatenate((last, np.array(x, np.int64))) for last, x in zip((last_a, last_b), loose, strict=True))
        return Alignment(ids_a, ids_b, last_a, last_b, link_a, link_b)

    def groups_text(self, found: Alignment) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        n_a, n_b = len(found.ids_a), len(found.ids_b)
        if not n_a:
            return b""
        closes_a, closes_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        closes_a[found.last_a] = 1
        closes_b[found.last_b] = 1
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        out = np.empty(n_a + n_b, np.int64)
        out[np.arange(n_a) + np.concatenate(([0], found.last_b + 1))[group_a]] = 2 * found.ids_a + closes_a
        out[np.arange(n_b) + (found.last_a + 1)[group_b]] = 2 * (len(self.a.sizes) + found.ids_b) + closes_b
        return b"".join(map(self.written.__getitem__, out.tolist()))[:-1]


@dataclass
class Chunk:
    """Documents and their links, until they are a row."""

    columns: list[list] = field(default_factory=lambda: [[] for _ in range(6)])
    links: list[np.ndarray] = field(default_factory=list)
    n_links: int = 0

    def add(self, doc_id: int | None, found: Alignment, pairs: np.ndarray, digest: str) -> None:
        row = (doc_id, len(found.ids_a), len(found.ids_b), len(found.last_a), len(pairs), digest)
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)
        self.links.append(pairs)
        self.n_links += len(pairs)

    def full(self) -> bool:
        return self.n_links >= CHUNK_LINKS or len(self.links) >= CHUNK_DOCUMENTS

    def batch(self, number: int) -> pa.RecordBatch:
        inverse, pair = pd.factorize(np.concatenate(self.links))
        times = np.bincount(inverse, minlength=len(pair))
        order = np.lexsort((pair, -times))  # frequent pairs first: small numbers, which pack well
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        columns = [pa.array([x], pa.list_(pa.int64() if k < 5 else pa.string())) for k, x in enumerate(self.columns)]
        counts = [pa.array([x[order]], pa.list_(pa.int64())) for x in (pair, times)]
        columns = [pa.array([number], pa.int64()), *columns, pa.array([packed(place[inverse])], pa.binary()), *counts]
        names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pair", "times"]
        return pa.RecordBatch.from_arrays(columns, names=names)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, first bytes first, compressed: the higher bytes are mostly zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def all_paths(paths: tuple[str, str, str] | None) -> tuple[str, str, str]:
    return paths or (*default_paths(), default_piece_path())


def alignments(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str, str] | None = None) -> DataFrame:
    """(doc_id, ids_a, ids_b, last_a, last_b): ids of both sides and the places of the last tokens of each group."""
    paths = all_paths(paths)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*paths)
        for batch in batches:
            found = list(aligner.of(batch.column(1).to_pylist()))
            columns = [pa.array([getattr(x, c) for x in found], pa.list_(pa.int64())) for c in ("ids_a", "ids_b", "last_a", "last_b")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "ids_a", "ids_b", "last_a", "last_b"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(find, "doc_id long, ids_a array<long>, ids_b array<long>, last_a array<long>, last_b array<long>")


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str, str] | None = None) -> DataFrame:
    """One row per chunk: its documents, its different id pairs with their counts, and its links."""
    paths = all_paths(paths)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number, chunk = Aligner(*paths), TaskContext.get().partitionId() << 32, Chunk()
        width = len(aligner.b.sizes)
        for batch in batches:
            texts = (x.as_py() for x in batch.column(1))
            for doc_id, found in zip(batch.column(0).to_pylist(), aligner.of(texts), strict=True):
                pairs = found.ids_a[found.link_a] * width + found.ids_b[found.link_b]
                digest = hashlib.sha256(aligner.groups_text(found)).hexdigest() if len(pairs) else ""
                chunk.add(doc_id, found, pairs, digest)
                if chunk.full():
                    yield chunk.batch(number)
                    number, chunk = number + 1, Chunk()
        if chunk.links:
            yield chunk.batch(number)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(gather, CHUNKS)


def pair_counts(gathered: DataFrame, width: int) -> DataFrame:
    """(pair, links, best): how often each id pair is linked, and whether no A id is linked more often with its B id."""
    pairs = gathered.select(F.explode(F.arrays_zip("pair", "times")).alias("x")).select("x.*")
    counts = pairs.groupBy("pair").agg(F.sum("times").alias("links")).withColumn("b", F.col("pair") % width)
    highest = counts.groupBy("b").agg(F.max("links").alias("highest"))
    return counts.join(highest, "b").select("pair", "links", (F.col("links") == F.col("highest")).alias("best"))


def link_table(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str, str] | None = None) -> DataFrame:
    """(a, b, links, best) for every pair of ids that is linked anywhere."""
    paths = all_paths(paths)
    width = len(PieceEncoder(paths[2]).sizes)
    a, b = F.floor(F.col("pair") / width).alias("a"), (F.col("pair") % width).alias("b")
    return pair_counts(cut(chunks(docs, key, text, paths)), width).select(a, b, "links", "best")


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the documents of each chunk, with the sums over their links."""
    for batch in batches:
        for k in range(len(batch)):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            values = {name: row[name].values for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            sizes = values["n_links"].to_numpy()
            ends = np.cumsum(sizes)
            n_best = count_sum = np.zeros(len(sizes), np.int64)
            if row["counts"].is_valid:
                known = row["counts"].values
                place, links, best = (known.field(name).to_numpy(zero_copy_only=False) for name in ("place", "links", "best"))
                of_place = np.zeros((2, len(place)), np.int64)
                of_place[0, place], of_place[1, place] = links, best
                each = unpacked(row["links"].as_py())
                running = np.zeros((2, len(each) + 1), np.int64)
                np.cumsum(of_place[0][each], out=running[0, 1:])
                np.cumsum(of_place[1][each], out=running[1, 1:])
                count_sum, n_best = running[:, ends] - running[:, ends - sizes]
            columns = [values[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            columns += [pa.array(n_best), pa.array(count_sum), values["groups_sha256"]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str, str] | None = None) -> DataFrame:
    """Counts of tokens, groups and links of every row, its best links, the corpus counts over its links, its groups' digest."""
    paths = all_paths(paths)
    width = len(PieceEncoder(paths[2]).sizes)
    gathered = cut(chunks(docs, key, text, paths))
    listed = gathered.select("chunk", F.posexplode("pair").alias("place", "pair")).join(pair_counts(gathered, width), "pair")
    counts = listed.groupBy("chunk").agg(F.collect_list(F.struct("place", "links", "best")).alias("counts"))
    return gathered.drop("pair", "times").join(counts, "chunk", "left").mapInArrow(summed, RESULT)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))
