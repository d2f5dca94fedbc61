import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lastmile.llm import vector_search as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, step, most=20):
    good = [(k, np.array(v, np.float32).astype(float)) for k, v, _ in rows if k is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, vectors = np.array([k for k, _ in good]), np.array([v for _, v in good])
    out = {}
    for k, v in good:
        if k % step == 0:
            score = (vectors * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != k][:most]
            out[k] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_recall_ties_and_scores(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 16))
    rows = [(k, (centre[k % 12] + 0.6 * rng.normal(size=16)).astype(np.float32).tolist(), 0) for k in range(4000)]
    rows += [(4000 + k, rows[40][1], 0) for k in range(60)]  # equal vectors
    want = exact(rows, 20)
    got = {}
    for r in V.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for k, found in want.items():
        mine = sorted(got[k])
        assert [x[0] for x in mine] == list(range(1, 21))
        assert [x[1:] for x in mine] == sorted((x[1:] for x in mine), key=lambda x: (-x[1], x[0]))
        hit += len({x[0] for x in found} & {x[1] for x in mine})
    assert hit >= 0.95 * 20 * len(want)
    assert [x[1] for x in sorted(got[40])] == [x[0] for x in want[40]]


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (1, [2.0, 1.0], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [1.0, None], 0), (None, [1.0, 1.0], 0), (20, [3.0, 3.0], None), (20, [3.0, 3.0], None), (40, None, 0)]
    got = {}
    for r in V.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(1, 20, 9.0), (2, 1, 4.0)], 20: [(1, 0, 9.0), (2, 1, 9.0)]}
    assert V.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
    assert V.nearest(spark.createDataFrame(rows[2:7], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_rows_take_no_places(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist(), 0) for k in range(30)]
    near = [(1, (np.array(rows[0][1]) * (2 + k / 100)).tolist(), 0) for k in range(25)]  # one id, other vectors
    want = exact(rows + near, 20)
    for k, found in want.items():
        most = {}
        for j, s in exact(rows + near, 20, most=99)[k]:
            most.setdefault(j, s)
        want[k] = list(most)[:20]
    got = {}
    for r in V.nearest(spark.createDataFrame((rows + near) * 2, SCHEMA), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {k: [x[1] for x in sorted(v)] for k, v in got.items()} == want
    assert all(len(v) == 20 for v in want.values())


def test_a_third_of_equal_vectors_and_lists_with_too_few_ids(spark, monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(V, "LIST_SIZE", 9)  # fewer than an answer: every query goes on to further lists
    monkeypatch.setattr(V, "SAMPLE_PER_LIST", 4)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist(), 0) for k in range(1200)]
    rows += [(1200 + k, rows[40][1], 0) for k in range(600)]
    want = exact(rows, 20)
    got = {}
    for r in V.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {k: len(v) for k, v in got.items()} == {k: 20 for k in want}
    hit = sum(len({x[0] for x in found} & {x[1] for x in got[k]}) for k, found in want.items())
    assert hit >= 0.95 * 20 * len(want)
    for k in [40, *range(1200, 1800, 20)]:
        assert [x[1] for x in sorted(got[k])] == [x[0] for x in want[k]]


def test_lists_within_the_ratio_are_all_read():
    rng = np.random.default_rng(2)
    graph = V.CentroidGraph(rng.normal(size=(700, 6)))
    points = rng.normal(size=(40, 6))
    row, where = graph.read_by(points, 50.0, np.full(700, 100))  # wider than any walk's first beam
    assert len(row) == 40 * 700
    row, where = graph.read_by(points, 1.0, np.full(700, 1))  # one id a list: twenty and the query's own
    assert np.bincount(row).tolist() == [V.NEIGHBOURS + 1] * 40
    nearest = np.argsort(((points[:, None] - graph.centroids) ** 2).sum(axis=2), axis=1)[:, : V.NEIGHBOURS + 1]
    assert np.mean([len(set(where[row == k]) & set(nearest[k])) for k in range(40)]) >= 0.95 * (V.NEIGHBOURS + 1)
    row, _ = graph.read_by(points, 1.0, np.zeros(700, int))  # too few ids in all of them
    assert len(row) == 40 * 700


def test_coinciding_centroids_are_one():
    c = np.array([[1.0, 2.0], [1.0, 2.0 + 1e-14], [3.0, 4.0], [1.0, 2.0]])
    assert V.merged(c).tolist() == [[1.0, 2.0], [3.0, 4.0]]


def test_clashing_columns_are_ignored(spark):
    rows = [(k, [1.0 + k, 2.0], "x", 9, 9) for k in range(30)]
    plain = V.nearest(spark.createDataFrame([r[:2] for r in rows], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    more = V.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, vector string, is_query int, place int"), F.col("vec_id") % 20 == 0)
    assert sorted(plain.collect()) == sorted(more.collect()) != []


def test_a_block_gives_no_row_below_what_a_query_has():
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(300, 8))
    lists = pd.DataFrame({"mask": 1, "vec_id": np.arange(300), "vector": list(vectors)})
    score = np.sort((vectors * vectors[0]).sum(axis=1)[1:])[::-1]
    ids = lambda bound: V.compare(lists, pd.DataFrame({"mask": [1], "vec_id": [0], "vector": [vectors[0]], "bound": [bound]}))
    assert sorted(ids(None)["score"], reverse=True) == score[:20].tolist()
    assert sorted(ids(score[4])["score"], reverse=True) == score[:5].tolist()  # a score equal to the bound may win by its id
    assert len(ids(score[0] + 1)) == 0


def test_blocks_are_counted_from_the_nearest_shelf():
    row, where = np.array([0, 0, 0, 0, 2, 2]), np.array([40, 3, 41, 17, 5, 39])
    row, shelf, mask = V.shelved(row, where)
    assert (row.tolist(), shelf.tolist()) == ([0, 0, 0, 2, 2], [2, 0, 1, 0, 2])
    assert mask.tolist() == [1 << 8 | 1 << 9, 1 << 3, 1 << 1, 1 << 5, 1 << 7]
    assert V.passed(row, np.array([4, 1, 3])[shelf]).tolist() == [0, 3, 7, 0, 4]
    assert V.passed(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_many_rounds_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(11)
    monkeypatch.setattr(V, "LIST_SIZE", 9)
    monkeypatch.setattr(V, "SAMPLE_PER_LIST", 4)
    monkeypatch.setattr(V, "BLOCK", 40)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist(), 0) for k in range(1500)]
    of = lambda: sorted(map(tuple, V.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()))
    rounds = of()
    monkeypatch.setattr(V, "ROUND", 1 << 30)  # the nearest block, then all others at once
    assert of() == rounds
    monkeypatch.setattr(V, "BLOCK", 4096)
    assert of() == rounds
    want = exact(rows, 20)
    hit = sum(j in {x[0] for x in want[q]} for q, _, j, _ in rounds)
    assert len(rounds) == 20 * len(want) and hit >= 0.95 * len(rounds)


def test_few_centroids_are_all_compared():
    rng = np.random.default_rng(4)
    graph, points = V.CentroidGraph(rng.normal(size=(200, 6))), rng.normal(size=(30, 6))
    near, far = graph.search(points)
    want = np.sqrt(((points[:, None] - graph.centroids) ** 2).sum(axis=2))
    assert near.shape == (30, 200) and np.allclose(far, np.sort(want, axis=1))
    assert np.allclose(np.take_along_axis(want, near, axis=1), far)
