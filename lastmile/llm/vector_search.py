"""Approximate nearest neighbours by balanced posting lists.

Build. Centroids are fitted on a bounded sample by balanced bisection (every cut halves a cluster, so lists
come out near equal), and joined into a graph of near neighbours that is small enough for every task's memory.
Every vector is put into the list of its nearest centroid and, if it lies near a boundary, into those
of other centroids hardly further away.

Search. A query walks the centroid graph, and reads the lists whose centroids are not much further away than
its nearest (distance ratio), however many these are, and goes on to the next ones while those read hold too
few ids for a full answer. The ratio is the one at which a few queries reach nearly all neighbours that they have in the fitting sample. Lists that
follow each other, and so lie near each other, share a shelf. Shelves and the queries that read them are dealt out in
blocks of bounded size, so a long list is searched by many tasks. Each block gives its best per query, from the lists that
the query reads; these are merged.

Rounds. A query reads its blocks in the order of their shelves, nearest first: one, then those up to the eighth, up to the 64th and
so on. Its last answer of the rounds before is a bound, and a block gives no row below it, since such a row is in
no answer. So the rows that blocks give for a query grow as the logarithm of the blocks it reads, not as their number.

Equal vectors. They tie with every query, and ties go to smaller ids: of each vector the smallest ids, one more than
an answer has, are put into lists. No answer changes, and a vector that a third of all rows share fills no lists.

The largest inner product is found as the least distance: vectors get one more component that
brings them all to the same norm; queries are brought to that norm and get zero there. Scores are inner products of the
given vectors in double precision.

Defined cases: vectors null, zero, with null or non-finite components or with another number of components
than most have take no part, nor do rows without an id; repeated ids count once, with their best
score; equal scores are ordered by id; with fewer candidates all are returned; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lastmile.llm.common import cut, if_few, stored, table

NEIGHBOURS = 20
QUERY_STEP = 20
MOST_SAMPLE = 20_000  # vectors that the centroids are fitted on
LIST_SIZE = 256  # vectors of the whole table per list, as far as the sample allows
SAMPLE_PER_LIST = 8  # fewer vectors of the sample make no centroid
DEGREE = 16  # edges of a centroid in the graph
BEAM = 96  # centroids that a walk keeps
SCANNED = 512  # so few centroids are compared at once, which costs less than a walk
MOST_COPIES = 4
COPY_RATIO = 1.01  # a vector is also put into lists at up to this times its least distance
FITTED_QUERIES = 256  # queries that the reading ratio is fitted on
REACHED = 0.95  # share of their neighbours in the sample that the reading ratio reaches
BLOCK = 4096  # vectors, and queries, of a shelf that one task compares
SHELF = BLOCK // LIST_SIZE  # lists of a shelf, a bit of its rows' masks each
ROUND = 8  # a round ends at this times the blocks that the one before ended at


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def bisect(points: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of ``lists`` clusters of near equal size."""
    if lists <= 1 or len(points) < 2:
        return points.mean(axis=0, keepdims=True)
    a, b = points[rng.choice(len(points), 2, replace=False)]
    left = lists // 2
    for _ in range(8):
        order = np.argsort(points @ (b - a), kind="stable")
        cut_at = len(points) * left // lists
        a, b = points[order[:cut_at]].mean(axis=0), points[order[cut_at:]].mean(axis=0)
    return np.vstack([bisect(points[order[:cut_at]], left, rng), bisect(points[order[cut_at:]], lists - left, rng)])


def merged(centroids: np.ndarray) -> np.ndarray:
    """The centroids, those that coincide but for rounding once."""
    scale = np.abs(centroids).max() or 1.0
    return centroids[np.sort(np.unique(np.round(centroids / scale, 9), axis=0, return_index=True)[1])]


class CentroidGraph:
    """Centroids, each joined to its nearest ones and a few at random, and a beam search over them."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.square = (centroids**2).sum(axis=1)
        n = len(centroids)
        rng = np.random.default_rng(7)
        near = []
        for k in range(0, n, 1024):
            d = self.square[None, :] - 2 * centroids[k : k + 1024] @ centroids.T
            near.append(np.argsort(d, axis=1, kind="stable")[:, 1 : DEGREE + 1])
        near = np.vstack(near)
        self.edges = np.hstack([near, rng.integers(0, n, (n, 4))]) if n > 1 else np.zeros((1, 1), np.int64)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, BEAM // 2)).astype(np.int64))

    def distances(self, points: np.ndarray, which: np.ndarray) -> np.ndarray:
        dots = np.einsum("qd,qcd->qc", points, self.centroids[which])
        return np.maximum((points**2).sum(axis=1)[:, None] + self.square[which] - 2 * dots, 0)

    def search(self, points: np.ndarray, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found per point by a walk that keeps ``width``, and their distances, nearest first; of few centroids all."""
        if width >= len(self.centroids) or len(self.centroids) <= SCANNED:
            dist = np.maximum((points**2).sum(axis=1)[:, None] + self.square - 2 * points @ self.centroids.T, 0)
            order = np.argsort(dist, axis=1, kind="stable")
            return order, np.sqrt(np.take_along_axis(dist, order, axis=1))
        rows = np.arange(len(points))
        beam = np.tile(self.entries, (len(points), 1))
        seen = np.zeros((len(points), len(self.centroids)), bool)
        seen[rows[:, None], beam] = True
        dist = self.distances(points, beam)
        walked = np.zeros(beam.shape, bool)
        while True:
            ahead = np.where(walked, np.inf, dist)
            pick = ahead.argmin(axis=1)
            if np.isinf(ahead[rows, pick]).all():
                break
            walked[rows, pick] = True
            after = self.edges[beam[rows, pick]]
            fresh = ~seen[rows[:, None], after]
            seen[rows[:, None], after] = True
            far = np.where(fresh, self.distances(points, after), np.inf)
            beam, dist, walked = np.hstack([beam, after]), np.hstack([dist, far]), np.hstack([walked, ~fresh])
            if beam.shape[1] > width:
                keep = np.argpartition(dist, width, axis=1)[:, :width]
                beam, dist, walked = (np.take_along_axis(x, keep, axis=1) for x in (beam, dist, walked))
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(beam, order, axis=1), np.sqrt(np.take_along_axis(dist, order, axis=1))

    def homes(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, list) for each list that a vector is put into."""
        near, far = (x[:, :MOST_COPIES] for x in self.search(points))
        row, col = np.nonzero((far <= far[:, :1] * COPY_RATIO + 1e-12) & np.isfinite(far))
        return row, near[row, col]

    def read_by(self, points: np.ndarray, ratio: float, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, list) for each list that a query reads: all within the ratio, and the next ones while fewer ids than
        an answer and the query's own are in those before. A walk whose last centroid is still wanted is repeated wider."""
        todo, width, out = np.arange(len(points)), BEAM, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(todo):
            near, far = self.search(points[todo], width)
            found = np.isfinite(far)
            held = np.cumsum(np.where(found, sizes[near], 0), axis=1)
            within = found & (far <= far[:, :1] * ratio + 1e-12)
            short = np.hstack([np.ones((len(todo), 1), bool), held[:, :-1] <= NEIGHBOURS])
            done = (held[:, -1] > NEIGHBOURS) & ~within[:, -1] if width < len(self.centroids) else np.ones(len(todo), bool)
            row, col = np.nonzero((within | (short & found)) & done[:, None])
            out.append((todo[row], near[row, col]))
            todo, width = todo[~done], 4 * width
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def fitted_ratio(graph: CentroidGraph, queries: pa.Table, sample: pa.Table, norm: float, count: int) -> float:
    """The distance ratio at which the queries reach their neighbours in the sample, as near as an answer's are among ``count``."""
    depth = min(max(1, -(-NEIGHBOURS * len(sample) // count)), len(sample) - 1)
    if depth < 1 or not len(queries):
        return 1.0
    vectors, wanted = columns(sample), columns(queries)
    scores = wanted @ vectors.T
    scores[queries["vec_id"].to_numpy()[:, None] == sample["vec_id"].to_numpy()] = -np.inf
    near = np.argpartition(-scores, depth - 1, axis=1)[:, :depth].ravel()
    query, home = graph.homes(lifted(vectors[near], norm))
    points = asked(wanted, norm)
    dist = np.sqrt(graph.distances(points[query // depth], home[:, None])[:, 0])
    dist = np.minimum.reduceat(dist, np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))))  # of a neighbour's lists the nearest
    least = graph.search(points, len(graph.centroids))[1][:, 0]
    return float(max(1.0, np.quantile(dist / np.maximum(np.repeat(least, depth), 1e-12), REACHED)))


def lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    rest = np.maximum(norm**2 - (vectors**2).sum(axis=1), 0)
    return np.hstack([vectors, np.sqrt(rest)[:, None]])


def asked(queries: np.ndarray, norm: float) -> np.ndarray:
    """Queries brought to ``norm``, which changes no order of their neighbours, with a zero component."""
    length = np.sqrt((queries**2).sum(axis=1, keepdims=True))
    return np.hstack([queries * (norm / length), np.zeros((len(queries), 1))])


def stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def columns(rows: pa.Table) -> np.ndarray:
    return stacked(rows["vector"].combine_chunks())


def shelved(row: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shelf, mask) of (row, list) pairs: once per row and shelf, with a bit for each of its lists; a row's shelves in the order of its pairs."""
    shelves = int(where.max(initial=0)) // SHELF + 1
    key, first, at = np.unique(row * shelves + where // SHELF, return_index=True, return_inverse=True)
    mask = np.zeros(len(key), np.int64)
    np.bitwise_or.at(mask, at, np.left_shift(1, where % SHELF))
    order = np.lexsort((first, key // shelves))
    key = key[order]
    return key // shelves, key % shelves, mask[order]


def passed(row: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each pair the sum of the sizes of its row's pairs before it; the pairs of a row stand together."""
    before = np.cumsum(size) - size
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))[: len(row)]
    return before - np.repeat(before[first], np.diff(np.append(first, len(row))))


def listed(vectors: DataFrame, kind: str, lists_of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], blocks: np.ndarray | None = None) -> DataFrame:
    """(shelf, mask, before, vec_id, vector): a row for each shelf with lists that ``lists_of`` names for a vector; ``before`` is
    the number of ``blocks`` (by shelf) in its shelves named before."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 512):
                batch = whole.slice(k, 512)
                row, shelf, mask = shelved(*lists_of(stacked(batch.column(1))))
                before = passed(row, np.ones(len(row), np.int64) if blocks is None else blocks[shelf])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shelf.astype(np.int32)), pa.array(mask), pa.array(before), batch.column(0).take(take), batch.column(1).take(take)],
                    names=["shelf", "mask", "before", "vec_id", "vector"],
                )

    return vectors.select("vec_id", "vector").mapInArrow(place, f"shelf int, mask long, before long, vec_id long, vector array<{kind}>")


def compare(lists: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """The best ids of a block of a shelf, each with its best row, for each query of a block of its readers: those not below its bound."""
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(lists) and len(queries):
        lists = lists.sort_values("vec_id", kind="stable")
        vectors, ids = np.stack(lists["vector"].to_numpy()).astype(np.float64), lists["vec_id"].to_numpy()
        longest = np.sqrt((vectors**2).sum(axis=1).max())
        shelf_mask = lists["mask"].to_numpy()
        of_id = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        for k in range(0, len(queries), 256):
            part = queries.iloc[k : k + 256]
            wanted = np.stack(part["vector"].to_numpy()).astype(np.float64)
            rough = wanted @ vectors.T
            rough[(part["mask"].to_numpy()[:, None] & shelf_mask) == 0] = -np.inf  # in none of the lists read
            bounds = part["bound"].to_numpy(np.float64, na_value=-np.inf)
            # rows below are in no answer; a product of matrices rounds, so what is near the bound is kept until its exact score is known
            low = bounds - 1e-9 * longest * np.sqrt((wanted**2).sum(axis=1))
            rough[rough < low[:, None]] = -np.inf
            some = np.flatnonzero(np.isfinite(rough.max(axis=1)))
            for query, vector, scores, bound in zip(part["vec_id"].to_numpy()[some], wanted[some], rough[some], bounds[some], strict=True):
                scores[ids == query] = -np.inf
                per_id = np.maximum.reduceat(scores, of_id)
                least = np.partition(per_id, -NEIGHBOURS)[-NEIGHBOURS] if len(per_id) > NEIGHBOURS else -np.inf
                # a product of matrices may round equal vectors unequally: the order is settled by sums of one fixed order
                at = np.flatnonzero((scores >= least - 1e-9 * abs(least)) & np.isfinite(scores)) if np.isfinite(least) else np.flatnonzero(np.isfinite(scores))
                exact = (vectors[at] * vector).sum(axis=1)
                at, exact = at[exact >= bound], exact[exact >= bound]
                best = np.lexsort((ids[at], -exact))
                first = np.sort(np.unique(ids[at[best]], return_index=True)[1])  # of an id its best row
                best = best[first][:NEIGHBOURS]
                out["query_id"] += [query] * len(best)
                out["vec_id"] += ids[at[best]].tolist()
                out["score"] += exact[best].tolist()
    return pd.DataFrame(out)


def nearest(table_of: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for each row that is a query."""
    kind = "float" if table_of.schema[vector].dataType.elementType.typeName() == "float" else "double"
    rows = table_of.where(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("vector"), is_query.alias("is_query")
    )
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("count"), F.sqrt(F.max(square)).alias("norm"))
    sizes = sizes.orderBy(F.desc("count"), "size").first()
    spark = table_of.sparkSession
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = sizes["norm"]
    rows = rows.where(F.size("vector") == sizes["size"])
    # a row number with a limit is applied before the shuffle too, so a vector of many rows meets as a few per task
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    candidates = stored(rows.select("vec_id", "vector").distinct().withColumn("place", place).where(F.col("place") <= NEIGHBOURS + 1).drop("place"))
    count = candidates.count()
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(11), "vec_id"), 11) / F.lit(float(1 << 53))
    sample = candidates.where(drawn < MOST_SAMPLE / count).toArrow().sort_by("vec_id")
    queries = rows.where("is_query").select("vec_id", "vector").distinct()
    fitted = queries.orderBy(F.xxhash64(F.lit(13), "vec_id"), "vector").limit(FITTED_QUERIES).toArrow()
    lists = max(1, min(count // LIST_SIZE, len(sample) // SAMPLE_PER_LIST))
    graph = CentroidGraph(merged(bisect(lifted(columns(sample), norm), lists, np.random.default_rng(5))) if len(sample) else np.zeros((1, sizes["size"] + 1)))
    ratio = fitted_ratio(graph, fitted, sample, norm, count)
    shared = spark.sparkContext.broadcast(graph)

    postings = cut(listed(candidates, kind, lambda points: shared.value.homes(lifted(points, norm))).drop("before"))
    # every id counts in one of the lists that hold it, so lists with so many ids together hold as many different ones
    least = F.col("shelf") * SHELF + F.bit_count(F.col("mask").bitwiseAND(-F.col("mask")) - 1)
    of_list = dict(postings.groupBy("vec_id").agg(F.min(least).alias("list")).groupBy("list").count().collect())
    ids_in = np.array([of_list.get(k, 0) for k in range(len(graph.centroids))])
    shelf_blocks = np.zeros((len(graph.centroids) - 1) // SHELF + 1, np.int64)
    for shelf, held_there in postings.groupBy("shelf").count().collect():
        shelf_blocks[shelf] = -(-held_there // BLOCK)
    readers = cut(listed(queries, kind, lambda points: shared.value.read_by(asked(points, norm), ratio, ids_in), shelf_blocks))
    parts = lambda df, name: df.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    blocks = cut(parts(postings, "vector_blocks").join(parts(readers, "query_blocks"), "shelf"))
    own = lambda name: F.pmod(F.xxhash64("vec_id"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    held = postings.join(blocks, "shelf").withColumn("i", own("vector_blocks")).withColumn("j", every("query_blocks"))
    reading = readers.join(blocks, "shelf").withColumn("j", own("query_blocks")).withColumn("i", every("vector_blocks"))
    turn = F.col("before") + F.col("i")
    block = ["shelf", "i", "j"]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    last = reading.agg(F.max(turn)).first()[0] or 0
    best, start, end = None, 0, 1
    while best is None or start <= last:
        now = reading.where((turn >= start) & (turn < end))
        searched = held.join(now.select(*block).distinct(), block, "left_semi")
        if best is None:
            now = now.withColumn("bound", F.lit(None).cast("double"))
        else:
            bounds = best.where(F.col("rank") == NEIGHBOURS).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
            now = now.join(if_few(bounds), "vec_id", "left")
        found = (
            searched.select(*block, "mask", "vec_id", "vector")
            .groupBy(*block)
            .cogroup(now.select(*block, "mask", "vec_id", "vector", "bound").groupBy(*block))
            .applyInPandas(lambda a, b: compare(a, b), "query_id long, vec_id long, score double")
        )
        if best is not None:
            found = best.select(*found.columns).unionByName(found)
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= NEIGHBOURS)
        best, start, end = cut(best), end, end * ROUND
    return best.select("query_id", "rank", "vec_id", "score")


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
