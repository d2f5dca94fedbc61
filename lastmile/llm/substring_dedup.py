"""Substring deduplication: FM-indexes over shards of the corpus, and documents streamed against them.

A window is a number of consecutive words of a document. A word goes if a window over it also starts elsewhere.

Shards are cut by content, so that every occurrence of a window lies in the same shard and a document is
streamed against its own shards only, not against all. The anchor of a window is the least hash among
its runs of eight words; equal windows have equal anchors. Neighbouring windows with one anchor are a segment.

1. Segments of all documents are found (a few numbers each). Anchors that occur once settle their windows:
   they start nowhere else. The other segments go on.
2. Equal segments become one with a weight. Their words are taken from one document each and dealt to shards.
3. Each shard builds a compressed FM-index over its segments and streams the segments against it by
   backward search; matches of window length that occur twice or more, by weight, are reported.
4. The reported spans go back to all documents that hold the segment, and their words are removed.

Texts are large: in 2 and 4 only those that hold a wanted segment or have a span are shuffled, told by a bitmap of
their hashes; the others never leave their task.

An anchor with very many different segments (a very frequent run of eight words) is split into blocks; every
block is indexed and streamed against every other, so no shard grows with one anchor and no occurrence is missed.

Defined cases: null, empty and blank texts have no words; fewer words than a window are never removed;
rows with equal text are copies of each other and lose all their windows, whatever their ids; an empty table
gives no rows; further columns pass through ``remove_repeats``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lastmile.llm import id_filter
from lastmile.llm.common import cut, given_back, held, held_name, mapped, table
from lastmile.llm.fm_index import FMIndex, matched
from lastmile.llm.word_hashes import WordHashes, runs

WINDOW = 35
ANCHOR = 8
SHARD_WORDS = 500_000  # a task that indexes and searches them holds some 100 MB
BLOCK_SEGMENTS = 20_000  # different segments of one anchor that are indexed together
NO_ID = -(2**63)

SEGMENTS = "id long, crc long, anchor long, content long, start int, windows int, copies int"
SPANS = "anchor long, content long, low int, high int"
#: A word with the space before it.
WORD = re.compile(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows known by id and a hash of the text, so that rows that repeat an id are told apart."""
    return docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("crc"), F.col(text).alias("text")
    )


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    done, low = 1, values
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    return low


def places(values: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Where a value is the least of some window, given the windows' least values."""
    side = np.zeros(width - 1, values.dtype)
    most = ~least_of(~np.concatenate((side, low, side)), width)
    return np.flatnonzero(values == most)


def segments(rows: DataFrame, window: int) -> DataFrame:
    """One row per segment; ``copies`` is 2 where its anchor stands at two places of the document or more, else 1."""
    anchor = min(ANCHOR, window)
    width = window - anchor + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for row, body in enumerate(batch.column(2).to_pylist()):
                words = body.encode().split() if body else []
                if len(words) < window:
                    continue
                of = hashes.of(words)
                values = runs(of, anchor)
                low = least_of(values, width)
                first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
                many = np.diff(np.append(first, len(low)))
                raw = memoryview(of).cast("B")
                content = [xxhash.xxh3_64_intdigest(raw[8 * a : 8 * (a + n + window - 1)]) for a, n in zip(first.tolist(), many.tolist(), strict=True)]
                anchors, times = np.unique(values[places(values, low, width)], return_counts=True)
                copies = np.minimum(times[np.searchsorted(anchors, low[first])], 2)
                columns = (np.full(len(first), row), low[first].view(np.int64), np.array(content, np.uint64).view(np.int64), first, many, copies)
                for column, part in zip(out, columns, strict=True):
                    column.append(part)
            row, low, content, first, many, copies = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
            row = pa.array(row)
            small = [pa.array(x.astype(np.int32)) for x in (first, many, copies)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(low), pa.array(content), *small],
                names=["id", "crc", "anchor", "content", "start", "windows", "copies"],
            )

    return mapped(rows.select("id", "crc", "text"), find, SEGMENTS)


def segment_words(rows: DataFrame, window: int) -> DataFrame:
    """(anchor, content, weight, blocks, words) of the segments listed in ``parts`` of each row."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for body, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = body.encode().split()
                for p in parts:
                    at = p["start"]
                    found.append((p["anchor"], p["content"], p["weight"], p["blocks"], b" ".join(words[at : at + p["windows"] + window - 1])))
                    if len(found) == 20_000:
                        yield batch_of(found)
                        found = []
            yield batch_of(found)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        columns = zip(*found, strict=True) if found else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["anchor", "content", "weight", "blocks", "words"])

    return mapped(rows.select("text", "parts"), cut_out, "anchor long, content long, weight long, blocks int, words binary")


def search(group: pd.DataFrame, window: int) -> pd.DataFrame:
    """Spans of the asked segments of one shard that occur elsewhere, from an index of its held segments."""
    group = group.sort_values("held", ascending=False, kind="stable")
    held, asked = group["held"].to_numpy(bool), group["asked"].to_numpy(bool)
    numbers: dict[bytes, int] = {}
    stream, ends = [], []
    for words, is_held in zip(group["words"], held.tolist(), strict=True):
        if is_held:
            stream += [numbers.setdefault(w, len(numbers) + 1) for w in words.split()]
        else:
            stream += [numbers.get(w, -1) for w in words.split()]
        stream.append(0)
        ends.append(len(stream) - 1)
    stream, end = np.array(stream, np.int32), np.array(ends, np.int64)
    start = np.concatenate(([0], end[:-1] + 1))
    many = int(held.sum())
    if not many or not asked.any():
        return pd.DataFrame({"anchor": [], "content": [], "low": [], "high": []})
    sizes = (end - start + 1)[:many]
    index = FMIndex(stream[: sizes.sum()], len(numbers) + 1, np.repeat(group["weight"].to_numpy(np.int64)[:many], sizes))
    hit = matched(index, stream, start[asked], end[asked], np.where(held[asked], 2, 1), window)
    # segments are parted by a symbol of their own, so no run of hits crosses from one into the next
    low = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
    high = np.flatnonzero(hit & ~np.append(hit[1:], False)) + 1
    of_segment = np.searchsorted(end, low, "right")
    return pd.DataFrame(
        {
            "anchor": group["anchor"].to_numpy()[of_segment],
            "content": group["content"].to_numpy()[of_segment],
            "low": low - start[of_segment],
            "high": high - start[of_segment],
        }
    )


def dealt(pieces: DataFrame, shards: int) -> DataFrame:
    """Shards of a segment: one; or, of an anchor in blocks, a shard for each pair of blocks with its own."""
    own = F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)

    def place(i: Column, j: Column) -> Column:
        return F.struct(
            F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(F.xxhash64("anchor", i, j)).alias("shard"),
            (i == own).alias("held"),
            (j == own).alias("asked"),
        )

    places = F.array_distinct(F.concat(F.transform(every, lambda j: place(own, j)), F.transform(every, lambda i: place(i, own))))
    return pieces.withColumn("place", F.explode(places)).select("anchor", "content", "weight", "words", "place.*")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK_SEGMENTS) -> DataFrame:
    """(id, crc, spans): per row of ``keyed`` with a repeat the spans of its words that go."""
    rows = keyed(docs, key, text)
    found = cut(segments(rows, window))
    often = found.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1")
    again = cut(found.drop("copies").join(often, "anchor"), found.count())
    words = again.agg(F.sum(F.col("windows") + F.lit(window - 1))).first()[0] or 0
    shards = -(-words // SHARD_WORDS) or 1

    unique = again.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("weight"), F.max("n").alias("n"), *[F.first(c).alias(c) for c in ("id", "crc", "start", "windows")]
    )
    unique = cut(unique, again.count())
    many = unique.where(F.col("n") > block).groupBy("anchor").agg(F.count(F.lit(1)).alias("segments")).where(F.col("segments") > block)
    blocks = F.coalesce(F.ceil(F.col("segments") / block), F.lit(1)).cast("int")
    part = F.struct("anchor", "content", "weight", "blocks", "start", "windows")
    parts = unique.join(many, "anchor", "left").withColumn("blocks", blocks).groupBy("id", "crc").agg(F.collect_list(part).alias("parts"))
    name = f"x{uuid.uuid4().hex}"
    wanted = id_filter.marked(rows, unique.select("crc"), "crc", name).where(name).drop(name)
    pieces = dealt(segment_words(wanted.join(parts, ["id", "crc"]), window), shards)
    spans = pieces.groupBy("shard").applyInPandas(lambda group: search(group, window), SPANS)
    span = F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    return cut(again.join(spans, ["anchor", "content"]).groupBy("id", "crc").agg(F.collect_set(span).alias("spans")), again.count())


def with_spans(rows: DataFrame, spans: DataFrame, key: str, crc: str) -> DataFrame:
    """``rows`` with the columns of ``spans`` (of ``repeats``, its first two named as ``key`` and ``crc``), null where there are none."""
    name = f"x{uuid.uuid4().hex}"
    all_rows = id_filter.marked(rows, spans.select(crc), crc, name)
    maybe = all_rows.where(name).drop(name).join(spans, [key, crc], "left")
    rest = all_rows.where(~F.col(name)).drop(name)
    more = [F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in spans.columns if c not in (key, crc)]
    return rest.select("*", *more).unionByName(maybe)


def gone(spans: list[dict] | None, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for span in () if spans is None else spans:
        out[span["low"] : span["high"]] = True
    return out


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest = [], [], []
            for body, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = body.encode().split() if body else []
                away = gone(spans, len(words))
                n_words.append(len(words))
                n_removed.append(int(away.sum()))
                kept = words if not spans else [w for w, x in zip(words, away.tolist(), strict=True) if not x]
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())],
                names=["id", "n_words", "n_removed", "kept_sha256"],
            )

    joined = with_spans(keyed(docs, key, text), repeats(docs, key, text, window), "id", "crc")
    done = mapped(joined.select("id", "text", "spans"), digest, "id long, n_words long, n_removed long, kept_sha256 string")
    return done.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words taken out of the text; a kept word keeps the space before it."""

    @F.pandas_udf("string")
    def shorter(bodies: pd.Series, all_spans: pd.Series) -> pd.Series:
        out = []
        for body, spans in zip(bodies, all_spans, strict=True):
            words = WORD.findall(body.encode()) if body is not None else []
            away = gone(spans, len(words)).tolist()
            out.append(b"".join(w for w, x in zip(words, away, strict=True) if not x).strip().decode())
        return pd.Series(out, dtype=object)

    spans = repeats(docs, key, text, window).select(F.col("id").alias("_id"), F.col("crc").alias("_crc"), F.col("spans").alias("_spans"))
    names, key, text = docs.columns, held_name(key), held_name(text)
    of_row = held(docs).withColumn("_id", F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))).withColumn("_crc", F.coalesce(F.xxhash64(text), F.lit(0)))
    joined = with_spans(of_row, spans, "_id", "_crc")
    left = F.when(F.col("_spans").isNotNull(), shorter(F.when(F.col("_spans").isNotNull(), F.col(text)), "_spans")).otherwise(F.col(text))
    return given_back(joined.withColumn(text, left), names)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
