import random
from collections import Counter

from llm_cases import edge_docs, edge_rows, no_docs  # noqa: F401
from lastmile.llm import components as components_of
from lastmile.llm import minhash as M


def sets_of(rows):
    out = {}
    for key, text in rows:
        w = text.encode().lower().split() if text else []
        out[key] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute(rows):
    sets = sets_of(rows)
    low = {k: k for k in sets}

    def top(k):
        while low[k] != k:
            k = low[k]
        return k

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                low[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), top(k), top(k) == k) for k in keys}


def near_copies(seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(25):
        words = [f"W{rnd.randrange(3000)}" for _ in range(rnd.randrange(1, 150))]
        for _ in range(rnd.randrange(1, 9)):
            copy = list(words)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                copy[rnd.randrange(len(copy))] = f"w{rnd.randrange(3000)}"
            rows.append(" ".join(copy) if rnd.random() < 0.8 else " ".join(copy).swapcase())
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_groups_are_those_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    rows = [*near_copies(1), (9000, None), (9001, ""), (9002, " "), (9003, "just three words"), (9004, "Just THREE words")]
    got = {r["doc_id"]: tuple(r)[1:] for r in M.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_estimate_is_near_the_similarity(spark):
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(600)]
    other = base[:500] + [f"v{k}" for k in range(100)]
    docs = spark.createDataFrame([(0, " ".join(base)), (1, " ".join(other))], "doc_id long, text string")
    bits = M.sign(docs).select("doc_id", "bits")
    pair = bits.where("doc_id = 0").selectExpr("bits AS a").crossJoin(bits.where("doc_id = 1").selectExpr("bits AS b"))
    sets = sets_of([(0, " ".join(base)), (1, " ".join(other))])
    want = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(pair.select(M.estimate(pair.a, pair.b)).first()[0] - want) < 0.09


def test_edge_cases(edge_docs, no_docs):
    rows = M.link(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert {(r["n_shingles"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] == 0} == {(0, 0, True)}
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5, 6)} == {4}
    assert all(r["kept"] for r in rows if r["doc_id"] is None)
    kept = M.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    left = Counter(r["doc_id"] for r in kept.collect())
    assert left[4] == 1 and not left[5] and not left[6] and left[None] == 2
    assert M.link(no_docs).count() == 0


def test_every_text_of_an_id_is_compared_in_a_divided_bucket(spark):
    a, b = [[f"{c}{k}" for k in range(100)] for c in "ab"]
    texts = [(10, a), (10, b), (20, [*a[:99], "x"]), (30, [*b[:99], "y"])]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts], "doc_id long, text string")
    bits = M.sign(docs).selectExpr("doc_id AS id", "digest", "bits")
    sets = M.sets_of(bits.select("id").distinct(), docs.withColumnRenamed("doc_id", "id"))
    members = spark.createDataFrame([(1, k, 3, k) for k in (10, 20, 30)], "bucket long, id long, n long, component long")
    assert sorted(map(tuple, M.across(members, bits, sets).collect())) == [(20, 10), (30, 10)]


def test_a_row_without_id_bridges_two_documents(spark):
    words = [f"w{k}" for k in range(200)]
    first, middle, last = words[:], words[12:] + ["x"] * 12, words[24:] + ["x"] * 12 + ["y"] * 12
    rows = [(1, " ".join(first)), (None, " ".join(middle)), (2, " ".join(last)), (3, "alone with these five words")]
    docs = spark.createDataFrame([*rows, (None, "quite another text that nobody has")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in M.link(docs).collect()}
    assert got == {(1, 1, True), (None, 1, True), (2, 1, False), (3, 3, True), (None, None, True)}


def test_every_pair_of_a_bucket_of_many_blocks_is_found_once(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    base = [f"w{k}" for k in range(120)]
    docs = spark.createDataFrame([(k, " ".join([*base, f"x{k}"])) for k in range(40)], "doc_id long, text string")
    bits = M.sign(docs).selectExpr("doc_id AS id", "digest", "bits")
    sets = M.sets_of(bits.select("id"), docs.withColumnRenamed("doc_id", "id"))
    members = spark.createDataFrame([(7, k, 40, k) for k in range(40)], "bucket long, id long, n long, component long")
    assert sorted(map(tuple, M.across(members, bits, sets).collect())) == [(a, b) for a in range(40) for b in range(a)]


def test_few_rows_are_joined_without_a_shuffle(spark):
    pairs = M.cut(spark.createDataFrame([(2, 1), (3, 1)], "a long, b long"))
    bits = M.cut(spark.createDataFrame([(k, b"", [5] * 32) for k in (1, 2, 3)], "id long, digest binary, bits array<long>"))
    near = M.near(pairs, bits)
    assert sorted(map(tuple, near.collect())) == [(2, 1), (3, 1)]
    assert "Exchange hashpartitioning" not in near._jdf.queryExecution().toString()


def test_few_rows_go_to_few_checkpoint_files(spark, monkeypatch):
    files, real = [], M.cut

    def cut(*args):
        done = real(*args)
        files.append(done.rdd.getNumPartitions())
        return done

    monkeypatch.setattr(M, "cut", cut)
    monkeypatch.setattr(components_of, "cut", cut)
    rows = near_copies(3)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        done = M.link(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2))
        assert {r["doc_id"]: tuple(r)[1:] for r in done.collect()} == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 10 and sum(files) < 4 * 40
    assert done.rdd.getNumPartitions() == 1
