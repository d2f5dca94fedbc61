import random
import re
from collections import Counter

from llm_cases import edge_docs, edge_rows, no_docs  # noqa: F401
from lastmile.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), failed)


def test_counts_are_those_by_brute_force(spark, edge_docs, edge_rows, no_docs):
    texts = ["a b c d e " * 3, "x\ny\nx\n \nx", "a # b $ <c> 𝔘nicode é", "w " * 500, "a b c d e f a b c d e", *["\t lead and trail \n"] * 2]
    more = spark.createDataFrame([(1000 + k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    docs = edge_docs.select("doc_id", "text", "lang").unionByName(more)
    got = Counter((r["doc_id"], *r["_quality"][:6]) for r in Q.judge(docs).collect())
    want = Counter((r[0], *base(r[1])) for r in edge_rows) + Counter((1000 + k, *base(t)) for k, t in enumerate(texts))
    assert got == want
    assert Q.judge(no_docs).count() == 0
    assert Q.judge(edge_docs).columns == [*edge_docs.columns, "_quality"]


def test_texts_unlike_their_language_go_and_others_stay(spark):
    words = "the of and to in is that it for on was be with as by this at are from he".split()
    plain = [" ".join(f"{words[(k * 7 + j) % 20]} stem{(k * 13 + j * j) % 997}" for j in range(60)) + "." for k in range(80)]
    odd = [" ".join(f"##{j}%%{j * j}$$" for j in range(60)), plain[0].upper()]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(plain + odd)], "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["_quality"]["kept"] for r in Q.judge(docs).collect()}
    assert all(kept[k] for k in range(80))
    assert not kept[80] and not kept[81]
    short = spark.createDataFrame([(0, "## %% $$ ## %% $$ !! ## %% && **", "en")], "doc_id long, text string, lang string")
    assert Q.judge(short).first()["_quality"]["kept"]


def judged(spark, others):
    """Verdicts on ``others`` beside 60 plain texts, in which a third of the short words are common."""
    rnd = random.Random(5)
    common = "the of and to in is that it for on was be".split()
    rare = lambda n: "".join(rnd.choice("bcdfgjklmpqrsvxyz") for _ in range(n))
    plain = [" ".join(f"{rnd.choice(common)} {rare(4)} {rare(5)}" for _ in range(60)) + "." for _ in range(60)]
    texts = plain + [make(rnd, common, rare) for make in others]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["_quality"] for r in Q.judge(docs).collect()}
    assert all(found[k]["kept"] for k in range(60))
    return [found[60 + k] for k in range(len(others))]


def test_common_words_decide(spark):
    def all_common(rnd, common, rare):
        return " ".join(f"{rnd.choice(common)} {rare(8)}" for _ in range(90)) + "."

    def none_common(rnd, common, rare):
        return " ".join(rare(4) for _ in range(180)) + "."

    for q in judged(spark, [all_common, none_common]):
        assert not q["base_failed"] and q["class_distance"] < 0.2 and not q["kept"]


def test_letters_and_other_characters_are_apart(spark):
    made = [lambda rnd, common, rare, a=a: " ".join("".join(rnd.choice(a) for _ in range(8)) for _ in range(60)) for a in ("=_/~^@+{}[]", "─│┌┐└┘├┤", "😀😁😂🤣😃😄", "�¤§")]
    for q in judged(spark, made):
        assert not q["base_failed"] and q["common_distance"] is None and not q["kept"]
    decomposed, digits = judged(spark, [lambda rnd, common, rare: " ".join(f"{rnd.choice(common)} {rare(2)}é {rare(5)}" for _ in range(60)), lambda rnd, common, rare: " ".join(rnd.choice("٠١٢٣٤٥٦٧٨٩") * 8 for _ in range(60))])
    assert decomposed["kept"] and not digits["kept"]


def test_a_language_without_reference_is_not_held_against_others(spark, monkeypatch):
    monkeypatch.setattr(Q, "MOST_LANGUAGES", 1)
    rnd = random.Random(6)

    def plain(common):
        return " ".join(f"{rnd.choice(common)} {rnd.choice(common)} {rnd.randrange(10**8):08d}".translate(str.maketrans("0123456789", "bcdfgjklmp")) for _ in range(60))

    rows = [(k, plain("the of and to in is that it".split()), "en") for k in range(8)] + [(9, plain("der die und in den von zu das".split()), "de")]
    found = {r["doc_id"]: r["_quality"] for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(q["kept"] for q in found.values())
    assert found[0]["common_distance"] is not None and found[9]["common_distance"] is None


def of_many_languages(spark):
    """Plain texts of 40 languages, each with common words of its own; the rarest language has one odd text besides."""
    rnd = random.Random(8)
    rows = []
    for k in range(40):
        common = ["".join(rnd.choice("bcdfgjklmp") for _ in range(3)) for _ in range(8)]
        for j in range(4 if k < 39 else 2):
            rows.append((len(rows), " ".join(f"{rnd.choice(common)} {rnd.choice(common)} {'qrstvwxyz'[j] * 8}{rnd.randrange(10**6)}" for _ in range(60)), f"l{k:02d}"))
    rows += [(len(rows), " ".join("".join(rnd.choice("=_/~^@+{}[]") for _ in range(8)) + str(j) for j in range(60)), "l39")]
    rows += [(len(rows) + 1, rows[0][1], "l00"), (len(rows) + 2, None, "l00"), (len(rows) + 3, rows[-1][1], None), (len(rows) + 4, "few words", "l01")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_every_language_of_many_has_a_reference(spark):
    rows, docs = of_many_languages(spark)
    found = {r["doc_id"]: r["_quality"] for r in Q.judge(docs).collect()}
    assert len(found) == len(rows)
    odd = next(k for k, t, _ in rows if t and t.startswith(tuple("=_/~^@+{}[]")))
    assert found[odd]["class_distance"] is not None  # its language is not among the 32 with the most documents
    assert all(found[k]["common_distance"] is not None for k, _, lang in rows if lang == "l39" and k != odd)


def test_distances_by_join_are_those_by_plan(spark, monkeypatch):
    _, docs = of_many_languages(spark)
    by_join = {r["doc_id"]: r["_quality"] for r in Q.judge(docs).collect()}
    monkeypatch.setattr(Q, "INLINE_LANGUAGES", 40)
    by_plan = {r["doc_id"]: r["_quality"] for r in Q.judge(docs).collect()}
    near = lambda x, y: x == y or (x is not None and y is not None and abs(x - y) < 1e-9)
    assert by_join.keys() == by_plan.keys()
    for k, q in by_join.items():
        p = by_plan[k]
        assert near(q["class_distance"], p["class_distance"]) and near(q["common_distance"], p["common_distance"]), (k, q, p)
        assert (*q[:6], q["kept"]) == (*p[:6], p["kept"])


def test_few_words_go_to_few_checkpoint_files(spark, monkeypatch):
    from lastmile.llm import quality as Q

    files, real = [], Q.cut

    def cut(*args):
        done = real(*args)
        files.append(done.rdd.getNumPartitions())
        return done

    monkeypatch.setattr(Q, "cut", cut)
    docs = spark.createDataFrame([(k, f"the cat sat on the mat with {k}", "en") for k in range(30)], "doc_id long, text string, lang string")
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert Q.references(docs)[0] == ["en"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files == [1]
