"""Near-duplicate groups by b-bit MinHash.

1. Every document is signed: 512 minima over its distinct five-word shingles. The first 128, four at a time, make
   32 bands; of each minimum only the lowest four bits are kept, packed into longs. Two documents at the
   threshold share none of the bands once in 200,000 times, more similar ones yet more rarely.
2. Documents with equal shingle sets (by 128-bit digest) are one class, its smallest id stands for it.
3. Candidates are classes in one bucket (equal band). Their similarity is estimated from the count of equal
   low bits, corrected for those equal by chance; far below the threshold the pair is dropped (four and a half
   standard deviations). What is left is confirmed on the full shingle sets of the texts.
4. A bucket is not paired out. First each class is tried against the smallest member of all its buckets (one
   pair per class), and the confirmed links are joined into components. A bucket whose members lie in one
   component has nothing more to give. In the others each member is tried against the bucket's smallest, and
   in those still divided, members of different components are compared by their packed bits and, above the
   cut, by their sets, in blocks of bounded size. So no link between different
   components of a bucket is left out, whatever its size.

Defined cases: a null or blank text has an empty set and is linked with nothing; fewer than five words
make one shingle; rows of one id are one document; rows without an id link like others, one document for each text, and are
always kept: their component is null where no document with an id is in it; ids are below 2**62; ties go to the
smallest id; an empty table gives no rows; further
columns pass through ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lastmile.llm import id_filter
from lastmile.llm.common import AT_ONCE, FEW, cut, if_few, mapped, of_size, stored, table
from lastmile.llm.components import components
from lastmile.llm.word_hashes import WordHashes, runs, scrambled

SHINGLE = 5
PERCENT = 75
MINIMA = 512
BANDS = 32
ROWS = 4
BITS = 4
MARGIN = 0.09  # an estimate this far below the threshold is four and a half standard deviations off
BLOCK = 512  # members of a bucket compared at once
BLOCK_OF_SHINGLES = 256

SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>"


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(runs(hashes.of(words), min(SHINGLE, len(words))))


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    drawn = scrambled(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    drawn = (drawn >> np.uint64(32)).astype(np.uint32)
    return drawn[:MINIMA, None] | np.uint32(1), drawn[MINIMA:, None]


def minima(found: np.ndarray, by: np.ndarray, plus: np.ndarray) -> np.ndarray:
    short = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(short), BLOCK_OF_SHINGLES):
        np.minimum(low, (by * short[k : k + BLOCK_OF_SHINGLES] + plus).min(axis=1), out=low)
    return low


def sign(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        by, plus = multipliers()
        place = (np.uint64(BITS) * np.arange(64 // BITS, dtype=np.uint64))[None, :]
        for batch in batches:
            size, digest, band, bits = [], [], [], []
            for body in batch.column(1).to_pylist():
                found = shingles(body, hashes)
                size.append(len(found))
                if not len(found):
                    digest.append(None)
                    band.append(None)
                    bits.append(None)
                    continue
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                low = minima(found, by, plus).astype(np.uint64)
                grouped = low[: BANDS * ROWS].reshape(BANDS, ROWS)
                mixed = np.arange(1, BANDS + 1, dtype=np.uint64)
                for k in range(ROWS):
                    mixed = scrambled(mixed * np.uint64(0x9E3779B97F4A7C15) + grouped[:, k])
                band.append(mixed.view(np.int64))
                kept = (low & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
                bits.append(np.bitwise_or.reduce(kept << place, axis=1).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size, pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.array(band, pa.list_(pa.int64())),
                    pa.array(bits, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "digest", "bands", "bits"],
            )

    return mapped(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), signed, SIGNED)


def estimate(a: Column, b: Column) -> Column:
    """Similarity by the share of equal low bits, less what chance makes equal."""
    ones = F.lit(int("0001" * 16, 2)).cast("long")

    def different(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        return F.bit_count(z.bitwiseAND(ones))

    equal = F.lit(1.0) - F.aggregate(F.zip_with(a, b, different), F.lit(0), lambda s, x: s + x) / F.lit(float(MINIMA))
    chance = 0.5**BITS
    return (equal - chance) / (1 - chance)


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose full shingle sets are similar enough."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last, known = None, None  # pairs with one b mostly come in a row
        for batch in batches:
            kept = []
            ids, left, right = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for row, (b, x, y) in enumerate(zip(ids, left, right, strict=True)):
                if b != last:
                    last, known = b, shingles(y, hashes)
                found = shingles(x, hashes)
                both = len(np.intersect1d(found, known, assume_unique=True))
                if 100 * both >= PERCENT * (len(found) + len(known) - both):
                    kept.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1)], names=["a", "b"])

    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    held = id_filter.only(texts, wanted, "id")
    joined = if_few(pairs).join(held.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(
        held.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return mapped(joined.select("a", "b", "text_a", "text_b"), similar, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``confirm``, checkpointed, in tasks that have a batch of pairs each."""
    return cut(confirm(pairs, texts), pairs.count(), AT_ONCE)


def near(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs whose packed bits let them be similar enough."""
    lent = F.broadcast if pairs.count() <= FEW else lambda df: df
    of_a, of_b = (bits.select(F.col("id").alias(name), F.col("bits").alias(f"bits_{name}")) for name in "ab")
    both = lent(lent(pairs).join(of_a, "a")).join(of_b, "b")
    return both.where(estimate(F.col("bits_a"), F.col("bits_b")) >= PERCENT / 100 - MARGIN).select("a", "b")


def open_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the buckets that lie in more than one component, with their own and their first's component."""
    labelled = members.join(if_few(found).select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "id").alias("of_first"))
    return labelled.join(mixed.where(F.col("low") != F.col("high")).select("bucket", "of_first"), "bucket")


def sets_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, digest, shingles) of the texts of the given ids."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(body, hashes).view(np.int64) for body in batch.column(1).to_pylist()]
            digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["id", "digest", "shingles"])

    return mapped(id_filter.only(texts, ids, "id").select("id", "text"), cut_up, "id long, digest binary, shingles array<long>")


def across(members: DataFrame, bits: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of one bucket and different components that are similar enough.

    A bucket's members are dealt into blocks, and each pair of blocks is joined on its own, so no task holds more
    than two blocks of a bucket, and a member goes once to each pair that its block is in. Pairs are compared by
    packed bits first, by their full sets where those allow it, all inside the join: only links come out of it,
    not the pairs of a large group. Bits and sets go by (id, digest), so each text of an id is compared with its own.
    """
    whole = members.select("bucket", "id", "component").distinct()
    blocks = whole.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = (
        whole.join(blocks, "bucket")
        .join(bits, "id")
        .join(sets.dropDuplicates(["id", "digest"]), ["id", "digest"])
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    )

    def side(name: str, own: str, other: str, others: Column) -> DataFrame:
        kept = [F.col(c).alias(f"{c}_{name}") for c in ("component", "bits", "shingles")]
        return placed.select("bucket", F.col("block").alias(own), F.explode(others).alias(other), F.col("id").alias(name), *kept)

    left = side("a", "i", "j", F.sequence("block", F.col("blocks") - 1))
    right = side("b", "j", "i", F.sequence(F.lit(0), F.col("block")))
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    similar = both * (100 + PERCENT) >= (F.size("shingles_a") + F.size("shingles_b")) * PERCENT
    apart = F.col("component_a") != F.col("component_b")
    once = (F.col("i") < F.col("j")) | (F.col("component_a") > F.col("component_b"))
    close = estimate(F.col("bits_a"), F.col("bits_b")) >= PERCENT / 100 - MARGIN
    pairs = left.join(right, ["bucket", "i", "j"]).where(apart & once & close & similar)
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def without(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs that were not tried in either order."""
    tried = if_few(tried)
    for a, b in (("a", "b"), ("b", "a")):
        pairs = pairs.join(tried.select(F.col(a).alias("a"), F.col(b).alias("b")), ["a", "b"], "left_anti")
    return pairs


NO_ID = 1 << 62  # nodes from here on stand for texts of rows without an id: greater than any id, so never a group's smallest


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    nameless = F.xxhash64(text).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID)
    docs = docs.select(F.coalesce(F.col(key).cast("long"), nameless).alias("node"), F.col(text).alias("text"))
    key = "node"
    signed = cut(sign(docs, key, "text"))
    n_rows = signed.count()
    classes = cut(signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("rep")), n_rows)
    n_classes = classes.count()
    reps = classes.select("digest", F.col("rep").alias("doc_id"))
    heads = cut(signed.join(reps, ["digest", "doc_id"]).select(F.col("doc_id").alias("id"), "digest", "bands", "bits").dropDuplicates(["id", "digest"]), n_classes, 10 * AT_ONCE)
    bits = heads.select("id", "digest", "bits")
    texts = docs.select(F.col(key).alias("id"), "text")

    members = heads.select("id", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = cut(members.join(buckets.where(F.col("first") != F.col("last")), "bucket").select("bucket", "id", "first", "n"), BANDS * n_classes)
    n_shared = shared.count()

    # 1: each member against the smallest of all first members of its buckets
    tried = cut(shared.where(F.col("id") != F.col("first")).groupBy(F.col("id").alias("a")).agg(F.min("first").alias("b")), min(n_classes, n_shared))
    links = confirmed(cut(near(tried, bits), tried.count()), texts)
    found = components(links, links.count())

    # 2: where a bucket is still divided, its members against its first
    divided = cut(open_buckets(shared, found), n_shared)
    n_divided = divided.count()
    more = divided.where(F.col("component") != F.col("of_first")).select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    more = cut(without(more, tried), n_divided)
    more = cut(near(more, bits), more.count())
    if not more.isEmpty():
        links = links.unionByName(confirmed(more, texts))
        found = components(links, links.count())

    # 3: where it still is, members of different components against each other
    divided = cut(open_buckets(divided.where(F.col("n") > 2).select("bucket", "id", "first", "n"), found), n_divided)
    asked = cut(divided.select("id").distinct(), divided.count())
    more = cut(across(divided, bits, cut(sets_of(asked, texts), asked.count(), AT_ONCE)))
    if not more.isEmpty():
        links = links.unionByName(confirmed(more, texts))
        found = components(links, links.count())

    rows = signed.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    rows = rows.join(if_few(found).select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    named = F.col("doc_id") < NO_ID
    rows = rows.select(
        F.when(named, F.col("doc_id")).alias("doc_id"),
        "n_shingles",
        F.when(component < NO_ID, component).alias("component_id"),
        F.when(named, F.col("doc_id") == component).otherwise(F.lit(True)).alias("kept"),
    )
    return of_size(rows, n_rows)


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id."""
    dropped = cut(link(docs, key, text).where(~F.col("kept")).select("doc_id"))
    return id_filter.without(docs, dropped, key)


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the smallest id, rows without an id last.

    Every row is a document of its own, whatever its id, so rows that repeat an id and rows without one are
    linked like others. The rows are stored with their number: it has to be the same in all joins.
    """
    row = f"x{uuid.uuid4().hex}"  # no column of ``docs``
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = cut(link(rows, row, text).select(F.col("doc_id").alias("row"), "component_id"))
    n_rows = groups.count()
    place = F.struct(F.col(key).isNull().alias("no_id"), F.col(key).cast("long").alias("id"), F.col(row).alias("row"))
    placed = rows.select(place.alias("place")).join(groups, F.col("place.row") == F.col("row"))
    first = placed.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.row").alias("row"))
    dropped = cut(groups.select("row").join(first, "row", "left_anti"), n_rows)
    return id_filter.without(rows, dropped, row).select(*docs.columns)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
