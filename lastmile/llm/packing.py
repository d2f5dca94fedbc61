"""Best-fit packing of tokenized documents into sequences of bounded length.

Hierarchical residual packing. Items are dealt at random into groups of bounded size; each group packs its
items best-fit in decreasing size. Sequences with hardly any room left are done. The others, kept whole,
are the items of the next round, dealt into fewer groups, until one group is left or a round
joins next to nothing. A sequence holds at most ``LENGTH`` tokens and so at most as many items;
a group holds about ``GROUP`` items. No task or driver sees more.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed each for itself;
a document longer than a sequence is cut from its end, so only its first piece may be short; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastmile.llm.common import cut, table
from lastmile.llm.tokenizing import END, Encoder, default_paths

LENGTH = 2048
GROUP = 20_000  # items packed together
ROOM = 4  # a sequence with no more free tokens is done
LEAST_JOINED = 0.02  # a round that joins a smaller part of its items is the last

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
BINS = "items array<long>, sizes array<int>, offsets array<long>, size int"


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece of a document: where it starts among its ids, its length and the CRC of its ids."""
    paths = paths or default_paths()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*paths)
        for batch in batches:
            rows = []
            for row, body in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encoder.ids(body or ""), np.array([END], "<u4")).astype("<u4")
                first = len(ids) % length or length
                starts = [0, *range(first, len(ids), length)]
                ends = [*starts[1:], len(ids)]
                rows += [(row, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]
            row, piece, start, size, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.empty(0, np.int64)] * 5
            columns = [batch.column(0).take(pa.array(row)), piece.astype(np.int32), start, size, crc]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=NAMES)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, PIECES)


def best_fit(rows: Iterator[tuple], length: int) -> list[tuple[list, list, int]]:
    """Pack (items, sizes, size) rows, given in decreasing size, each into the fullest sequence with room for it."""
    open_by_room: list[list] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r is set while a sequence with r free tokens is open
    for items, sizes, size in rows:
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            held = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
            held[0].extend(items)
            held[1].extend(sizes)
            held[2] += size
        else:
            held = [list(items), list(sizes), size]
        open_by_room[length - held[2]].append(held)
        rooms |= 1 << (length - held[2])
    return [tuple(held) for same in open_by_room for held in same]


def pack_round(items: DataFrame, groups: int, turn: int, length: int) -> DataFrame:
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "first"], ascending=[False, True])
        packed = best_fit(zip(group["items"], group["sizes"], group["size"], strict=True), length)
        out = pd.DataFrame(packed, columns=["items", "sizes", "size"])
        out.insert(2, "offsets", [np.cumsum([0, *sizes[:-1]]) for sizes in out["sizes"]])
        return out

    first = F.element_at("items", 1)
    dealt = items.withColumn("first", first).withColumn("group", F.pmod(F.xxhash64(F.lit(turn), "first"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(pack, BINS)


def pack(sized: DataFrame, length: int = LENGTH, group: int = GROUP, room: int = ROOM) -> DataFrame:
    """(item long, length) rows to (item, sequence_id, offset): sequences without gaps, at most ``length`` long."""
    items = sized.select(
        F.array("item").alias("items"), F.array(F.col("length").cast("int")).alias("sizes"), F.col("length").cast("int").alias("size")
    )
    done, waiting, turn = None, items, 0
    count = waiting.count()
    while True:
        groups = -(-count // group) or 1
        packed = cut(pack_round(waiting, groups, turn, length), 2 * groups, 1)
        full = packed.where(F.col("size") >= length - room)
        waiting = packed.where(F.col("size") < length - room)
        done = full if done is None else done.unionByName(full)
        left, made = waiting.count(), packed.count()
        if groups == 1 or not left or count - made < LEAST_JOINED * count:
            break
        count, turn = left, turn + 1
    sequences = done.unionByName(waiting)
    placed = sequences.select(F.element_at("items", 1).alias("sequence_id"), F.explode(F.arrays_zip("items", "offsets")).alias("x"))
    return placed.select(F.col("x.items").alias("item"), "sequence_id", F.col("x.offsets").alias("offset"))


def pack_documents(docs: DataFrame, length: int = LENGTH, **names) -> DataFrame:
    """Pieces of documents with the sequence and the place in it that each got."""
    sized = cut(pieces(docs, length=length, **names).withColumn("item", F.monotonically_increasing_id()))
    return sized.join(pack(sized.select("item", "length"), length), "item").drop("item")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
