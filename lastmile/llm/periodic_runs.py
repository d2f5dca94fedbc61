"""Periodic runs: stretches of words that repeat the same few words over and over, found whole and exactly.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that is long enough,
``max(least, times * q)`` words or more, and that no neighbouring word extends.

Every run contains a Lyndon root: a factor of q words that is smaller than all its proper suffixes, in the order
of the words or in the reverse one. The longest Lyndon factor from a place ends before the next smaller suffix,
so there are two candidates a place. Each is extended to the right by the longest common extension of its two
ends, and to the left by that of the reversed text; both come from suffix trees (``suffix_tree.py``).

Before that, words that can be in no run are set aside. All groups of ``GRAM`` words of a run occur in it twice or
more, so a document is cut at the words that no such group covers, and its parts again in the same way while
that still takes much away. The trees are built over the remaining parts, with a symbol of its own between
any two; no run crosses such a symbol. Prose is gone after this step. It changes nothing in the result.

One document is one row: nothing is shuffled, and a lost executor repeats the batches it was at.

Defined cases: null, empty and blank texts have no words and no runs; their collapsed text is empty; repeated rows
are each for themselves; ties in the length go to the smallest start, then the smallest period; an empty table
gives no rows; further columns pass through ``collapse_runs``, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lastmile.llm.common import table, words
from lastmile.llm.suffix_tree import CommonExtensions
from lastmile.llm.word_hashes import WordHashes, runs as gram_hashes, scrambled

LEAST = 6  # words of a run
TIMES = 4  # periods of a run
GRAM = 4
SLICE = 300_000  # words of the documents that are looked at together
STILL_WORTH = 0.9  # parts are cut again while that leaves at most this share

RUN = T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")])
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("runs", T.ArrayType(RUN, False), False),
        T.StructField("collapsed", T.StringType(), False),
    ]
)


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next place with a smaller value, or the length."""
    values = rank.tolist()
    out = [len(values)] * len(values)
    waiting: list[int] = []
    for place, value in enumerate(values):
        while waiting and values[waiting[-1]] > value:
            out[waiting.pop()] = place
        waiting.append(place)
    return np.array(out, np.int64)


def runs_of(text: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of all runs of a text of positive numbers, by start and period."""
    size = len(text)
    if size < least:
        return np.empty((0, 3), np.int64)
    ahead = CommonExtensions(text)
    rank = ahead.rank[:size]
    place = np.arange(size)
    first = np.concatenate((place, place))
    after = np.concatenate((next_smaller(rank), next_smaller(-rank)))
    period = after - first
    inside = (after < size) & (times * period <= size)
    first, after, period = first[inside], after[inside], period[inside]
    right = after + ahead.of(first, after)
    # a run has its first root within its first period, so the rest of it lies to the right
    long = right - first > (times - 1) * period
    first, after, period, right = first[long], after[long], period[long], right[long]
    if not len(first):
        return np.empty((0, 3), np.int64)
    left = first.copy()
    has_left = np.flatnonzero(first > 0)
    if len(has_left):
        back = CommonExtensions(text[::-1])
        left[has_left] -= back.of(size - first[has_left], size - after[has_left])
    length = right - left
    enough = length >= np.maximum(least, times * period)
    # of one stretch the smallest period is the run's own
    order = np.lexsort((period[enough], length[enough], left[enough]))
    left, length, period = left[enough][order], length[enough][order], period[enough][order]
    own = np.ones(len(left), bool)
    own[1:] = (left[1:] != left[:-1]) | (length[1:] != length[:-1])
    found = np.column_stack((left[own], length[own], period[own]))
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def gram_of(least: int, times: int) -> int:
    """Words of a group that occurs at least twice in every run; 0 where no group of two words or more does."""
    return next((k for k in range(GRAM, 1, -1) if all((max(least, times * q) - k + 1) // q >= 2 for q in range(1, least + k))), 0)


def repetitive(hashes: np.ndarray, part: np.ndarray, gram: int, least: int) -> np.ndarray:
    """Which words can be in a run: those that groups of words cover that occur twice or more in their part.

    ``part`` numbers the parts (documents, at first) and does not fall.
    """
    place = np.arange(len(hashes))
    while len(place) >= least:
        grams = gram_hashes(hashes[place], gram)
        many = len(grams)
        whole = part[:many] == part[gram - 1 :]
        keys = scrambled(grams + part[:many].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        often = np.zeros(many, bool)
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
        change = np.zeros(len(place) + 1, np.int64)
        from_here = np.flatnonzero(often & whole)
        np.add.at(change, from_here, 1)
        np.add.at(change, from_here + gram, -1)
        covered = np.cumsum(change[:-1]) > 0
        cut = np.concatenate(([True], (part[1:] != part[:-1]) | ~covered[:-1]))
        number = np.cumsum(cut)[covered]
        kept = place[covered]
        if len(kept):
            sizes = np.bincount(number)
            big = sizes[number] >= least
            kept, number = kept[big], number[big]
        done = len(kept) > STILL_WORTH * len(place)
        place, part = kept, number
        if done:
            break
    out = np.zeros(len(hashes), bool)
    if len(place) >= least:
        out[place] = True
    return out


def runs_within(hashes: np.ndarray, keep: np.ndarray, least: int, times: int) -> np.ndarray:
    """Runs of one document whose words outside ``keep`` are in no run."""
    place = np.flatnonzero(keep)
    if len(place) < least:
        return np.empty((0, 3), np.int64)
    # the places of the text: kept words, with a symbol of its own in every gap
    gap = np.flatnonzero(np.diff(place) > 1) + 1
    named, number = np.unique(hashes[place], return_inverse=True)
    text = np.insert(number.astype(np.int64) + 1, gap, len(named) + 1 + np.arange(len(gap)))
    origin = np.insert(place, gap, -1)
    found = runs_of(text, least, times)
    found[:, 0] = origin[found[:, 0]]
    return found


def find_runs(bodies: Iterable[str | None], hashes: WordHashes, least: int = LEAST, times: int = TIMES) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and runs of each text; the texts are taken some at a time."""
    held: list[list[bytes]] = []
    size = 0
    for body in bodies:
        held.append(body.encode().split() if body else [])
        size += len(held[-1])
        if size >= SLICE:
            yield from runs_of_some(held, hashes, least, times)
            held, size = [], 0
    yield from runs_of_some(held, hashes, least, times)


def runs_of_some(cut_up: list[list[bytes]], hashes: WordHashes, least: int, times: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    sizes = np.array([len(x) for x in cut_up], np.int64)
    bound = np.concatenate(([0], np.cumsum(sizes)))
    of = np.concatenate([hashes.of(x) for x in cut_up]) if cut_up else np.empty(0, np.uint64)
    gram = gram_of(least, times)
    keep = repetitive(of, np.repeat(np.arange(len(sizes)), sizes), gram, least) if gram and len(of) else np.ones(len(of), bool)
    for k, found in enumerate(cut_up):
        here = slice(bound[k], bound[k + 1])
        yield found, runs_within(of[here], keep[here], least, times) if keep[here].any() else np.empty((0, 3), np.int64)


def collapsed(found: list[bytes], spans: np.ndarray) -> str:
    """The words but those that a run contains after its first period, joined by one space."""
    if not len(spans):
        return b" ".join(found).decode()
    change = np.zeros(len(found) + 1, np.int64)
    np.add.at(change, spans[:, 0] + spans[:, 2], 1)
    np.add.at(change, spans[:, 0] + spans[:, 1], -1)
    kept = (np.cumsum(change[:-1]) == 0).tolist()
    return b" ".join(w for w, x in zip(found, kept, strict=True) if x).decode()


def periodic_runs(text: Column, least: int = LEAST, times: int = TIMES) -> Column:
    """Struct of n_words, runs (by start, then period) and the collapsed text."""

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for batch in batches:
            n_words, texts, spans = [], [], []
            for found, part in find_runs((x.as_py() for x in batch), hashes, least, times):
                n_words.append(len(found))
                texts.append(collapsed(found, part))
                spans.append(part)
            flat = np.concatenate(spans) if spans else np.empty((0, 3), np.int64)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in spans]))).astype(np.int32))
            names = [field.name for field in RUN]
            run = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=[pa.field(n, pa.int64(), False) for n in names])
            columns = [pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(offsets, run), pa.array(texts, pa.string())]
            yield pa.StructArray.from_arrays(columns, names=["n_words", "runs", "collapsed"])

    return F.arrow_udf(find, FOUND)(text)


def free_name(docs: DataFrame, wanted: str) -> str:
    """A column name that ``docs`` does not have."""
    return wanted if wanted.lower() not in {c.lower() for c in docs.columns} else f"{wanted}_{uuid.uuid4().hex}"


def collapse_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with every run cut down to its first period. Texts without a run stay as they are, to the byte."""
    found = free_name(docs, "found")
    seen = docs.withColumn(found, periodic_runs(F.col(text), least, times))
    return seen.withColumn(text, F.when(F.size(f"{found}.runs") > 0, F.col(f"{found}.collapsed")).otherwise(F.col(text))).drop(found)


def planted(key: str = "doc_id", text: str = "text") -> Column:
    """The text in which every tenth id's words repeat from some place on; rows without an id stay as they are."""
    hashed = F.crc32(F.col(key).cast("string").cast("binary"))
    found = words(F.col(text))
    some = F.floor(hashed / 10).cast("long")
    n = F.size(found).cast("long")
    a = some % n
    p = F.lit(1).cast("long") + F.floor((n - a) / (3 + some % 8)).cast("long")
    again = F.flatten(F.array_repeat(F.slice(found, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    repeated = F.array_join(F.slice(F.concat(F.slice(found, F.lit(1), a.cast("int")), again), F.lit(1), n.cast("int")), " ")
    return F.when((hashed % 10 == 0) & (n > 0), repeated).otherwise(F.col(text))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted().alias("text"))
    found = docs.select("doc_id", periodic_runs(F.col("text")).alias("found")).select("doc_id", "found.*")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.array_join(lines, "").alias("lines"), "collapsed")
    return rows.select(
        "doc_id",
        "n_runs",
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
