"""Quality rules by distribution divergence, in DataFrame expressions only.

A document's character-class histogram and its common-word histogram are compared with the histograms
of each language of the corpus by Jensen-Shannon distance (base 2, so 0 to 1). A document is rejected
when even its nearest language is further away than the limit, in characters or in words. A text without
any common word is no further than 0.5 from a language whose common words make a third of its short words,
so it is rejected for having none. Short documents have histograms too thin to judge; below the minimum
lengths neither decides anything.

The references come from all documents of the corpus: per language the character classes of its texts,
its most frequent short words and how many of its words each makes up. Every language of the corpus has
one. Up to ``INLINE_LANGUAGES`` of them are written into the plan; with more, the references stay tables
and texts are joined with them (``distances_to_all``), to the same distances. A caller may set
``MOST_LANGUAGES`` to refer to the most frequent languages only; documents of a language without a
reference are then not held against those of others: the base rules decide alone.

On top stand the base rules: fewer than 10 words, or more than 20 % of the words in repeated five-word
windows.

Defined cases: a null, empty or blank text has no words and fails the base rules; documents of null
language are judged like others but shape no reference; with no reference at all the base rules decide
alone; repeated rows are judged alike; an empty table gives no rows; further columns pass through ``judge``, whatever their names (one named ``_quality`` is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lastmile.llm.common import SPACE_RUN, SPACES, cut, given_back, held, held_name, table, words

MIN_WORDS = 10
WINDOW = 5
MOST_REPEATED_PERCENT = 20
MOST_LANGUAGES: int | None = None  # None: every language has a reference
INLINE_LANGUAGES = 32
COMMON_WORDS = 12  # per language
COMMON_LENGTH = 5  # the frequent words of a language are short; longer ones are not counted
MIN_CHARS_FOR_CLASSES = 200
MIN_WORDS_FOR_COMMON = 50
MOST_CLASS_DISTANCE = 0.35
MOST_COMMON_DISTANCE = 0.5  # clean documents of the fixtures reach 0.38, tables of loose words start at 0.6

#: Character classes by pattern, of what is left of a text without letters and spaces.
CLASSES = {"symbol": r"[#*$%&|<>]", "digit": r"\p{Nd}", "stop": r"[.,;:!?'\"()-]"}
UPPER = r"\p{Lu}"
LETTERS_AND_SPACES = r"[\p{L}\p{M}\x20\x09-\x0D]+"
HISTOGRAM = len(CLASSES) + 4


def unlettered(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), LETTERS_AND_SPACES, "")


def class_counts(text: Column, word_chars: Column, rest: Column) -> Column:
    """Characters by class: those of ``CLASSES``, upper case, spaces, all other letters and marks, others.

    ``rest`` is the text without letters and spaces, a column of its own: the classes are sought in it only.
    """
    known = [F.regexp_count(rest, F.lit(pattern)).cast("long") for pattern in CLASSES.values()]
    upper = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(UPPER)).cast("long")
    total = F.char_length(F.coalesce(text, F.lit(""))).cast("long")
    others = F.char_length(rest).cast("long")
    return F.array(*known, upper, total - word_chars, word_chars - others - upper, others - sum(known[1:], known[0]))


def histogram(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))


def short_words(found: Column) -> Column:
    return F.filter(found, lambda w: F.char_length(w) <= COMMON_LENGTH)


def common_line(found: Column, common: list[str]) -> Column:
    """The words of ``found`` that are among ``common``, in lower case, each between two spaces of its own."""
    kept = F.filter(F.transform(short_words(found), F.lower), lambda w: w.isin(common))
    return F.concat(F.lit(" "), F.array_join(kept, "  "), F.lit(" "))


def times_in(line: Column, word: str) -> Column:
    """How often a word stands in a line made by ``common_line``."""
    return ((F.char_length(line) - F.char_length(F.replace(line, F.lit(f" {word} "), F.lit("")))) / (len(word) + 2)).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms that each sum to 1."""

    def part(x: Column, y: Column) -> Column:
        middle = (x + y) / 2
        side = lambda z: F.when(z > 0, z * F.log2(z / middle)).otherwise(0.0)
        return (side(x) + side(y)) / 2

    total = F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def with_repeats(df: DataFrame, found: str, out: str) -> DataFrame:
    """Add ``out``: words in five-word windows that stand in the text twice or more, the first included.

    Windows are compared by 64-bit hash. Only texts with a repeated window go on: their windows are sorted by
    (hash, place), neighbours with one hash are repeats, and the words they cover are counted once. Every array
    that a lambda looks into is a column of its own, so it is made once per text.
    """
    many = F.greatest(F.size(found) - (WINDOW - 1), F.lit(0))
    window = F.transform(
        F.sequence(F.lit(0), many - 1), lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + k) for k in range(WINDOW)])
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, k: F.coalesce(F.get(F.col("_placed"), k)["h"] == x["h"], F.lit(False))
    twice = F.filter("_placed", lambda x, k: same(x, k + 1) | same(x, k - 1))
    end = lambda x: (x + WINDOW).cast("long")
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct((a["n"] + end(x) - F.greatest(a["end"], x.cast("long"))).alias("n"), end(x).alias("end")),
        lambda a: a["n"],
    )
    return (
        df.withColumn("_hashes", F.transform(found, lambda w: F.xxhash64(w)))
        .withColumn("_windows", F.when(many > 1, window))
        .withColumn("_placed", F.when(repeats, placed))
        .withColumn("_starts", F.array_sort(F.transform(twice, lambda x: x["i"])))
        .withColumn(out, F.coalesce(covered, F.lit(0).cast("long")))
        .drop("_hashes", "_windows", "_placed", "_starts")
    )


def language_classes(known: DataFrame) -> DataFrame:
    """(lang, n, shares): per language the number of its documents and its histogram of character classes."""
    sums = [F.sum(F.get("counts", k)).alias(f"c{k}") for k in range(HISTOGRAM)]
    in_words = F.char_length(F.regexp_replace("text", SPACE_RUN, "")).cast("long")
    counted = known.withColumn("rest", unlettered(F.col("text"))).select("lang", class_counts(F.col("text"), in_words, F.col("rest")).alias("counts"))
    shares = histogram(F.array(*[F.coalesce(f"c{k}", F.lit(0)) for k in range(HISTOGRAM)]))
    return counted.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *sums).select("lang", "n", shares.alias("shares"))


def language_words(known: DataFrame, many: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n): how often each short word stands in each language; and the common words of all languages (word).

    ``many``: how many documents there are, where that is known; there are seldom more rows.
    """
    counts = cut(
        known.select("lang", F.explode(short_words(words(F.col("text")))).alias("word"))
        .groupBy("lang", F.lower("word").alias("word"))
        .agg(F.count(F.lit(1)).alias("n")),
        many,
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return counts, counts.withColumn("rank", rank).where(F.col("rank") <= COMMON_WORDS).select("word").distinct()


def of_known_language(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], list[str], list[list[float]], list[list[float]]] | None:
    """The languages, the common words of all of them, and per language the histograms of classes and of common words.

    The last entry of a common-word histogram is the share of all other short words. None if there are more
    languages than a plan should hold.
    """
    known = of_known_language(docs, text, lang)
    most = INLINE_LANGUAGES + 1 if MOST_LANGUAGES is None else MOST_LANGUAGES
    chosen = language_classes(known).orderBy(F.desc("n"), "lang").limit(most).collect()
    if MOST_LANGUAGES is None and len(chosen) > INLINE_LANGUAGES:
        return None
    langs = [r["lang"] for r in chosen]
    if not langs:
        return [], [], [], []
    counts, ranked = language_words(known.where(F.col("lang").isin(langs)), sum(r["n"] for r in chosen))
    common = sorted(r["word"] for r in ranked.collect())
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    found = {(r["lang"], r["word"]): r["n"] for r in counts.where(F.col("word").isin(common)).collect()} if common else {}
    by_class, by_word = [], []
    for r in chosen:
        by_class.append(r["shares"])
        part = [found.get((r["lang"], w), 0) / max(totals.get(r["lang"], 0), 1) for w in common]
        by_word.append([*part, max(0.0, 1.0 - sum(part))])
    return langs, common, by_class, by_word


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def distances_to_all(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(_key, _by_class, _by_word, _n_common) per text: the distances to its nearest language, whatever their number.

    A distance sums over the words that text and language share, by a join on the word; words of only one of both
    add half their share. Parts are added as decimals, so the order they come in does not matter.
    """
    known = of_known_language(docs, text, lang)
    counts, common = language_words(known)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(common, "word", "left_semi").join(totals, "lang").select("lang", "word", (F.col("n") / F.col("total")).alias("q"))
    langs = language_classes(known).select("lang", "shares").join(shares.groupBy("lang").agg(F.sum("q").alias("q_all")), "lang", "left")

    body = F.col(text)
    texts = docs.where(body.isNotNull()).select(text_key(body).alias("_key"), body.alias("text"))
    texts = texts.withColumn("rest", unlettered(F.col("text"))).withColumn("found", words(F.col("text")))
    in_words = F.char_length(F.array_join("found", "")).cast("long")
    # equal texts are one: their words are counted together and divided by their number
    per_text = texts.groupBy("_key").agg(
        F.count(F.lit(1)).alias("copies"), F.max(F.size(short_words(F.col("found")))).alias("short"),
        F.max(class_counts(F.col("text"), in_words, F.col("rest"))).alias("counts"),
    )
    said = texts.select("_key", F.explode(short_words(F.col("found"))).alias("word")).select("_key", F.lower("word").alias("word"))
    said = said.join(common, "word", "left_semi").groupBy("_key", "word").agg(F.count(F.lit(1)).alias("n"))
    said = said.join(per_text.select("_key", "copies", "short"), "_key")
    said = said.select("_key", "word", (F.col("n") / F.col("copies")).cast("long").alias("n"), "short").withColumn("p", F.col("n") / F.col("short"))

    def part(x: Column, y: Column) -> Column:
        side = lambda z: F.when(z > 0, z * F.log2(z / ((x + y) / 2))).otherwise(0.0)
        return (side(x) + side(y)) / 2

    p, q = F.col("p"), F.col("q")
    shared = said.join(shares, "word").groupBy("_key", "lang").agg(
        F.sum((part(p, q) - (p + q) / 2).cast("decimal(38,20)")).cast("double").alias("shared")
    )
    n_common = said.groupBy("_key").agg(F.sum("n").alias("_n_common"))
    pairs = per_text.join(n_common, "_key", "left").crossJoin(F.broadcast(langs)).join(shared, ["_key", "lang"], "left")
    p_all = F.coalesce("_n_common", F.lit(0)) / F.greatest("short", F.lit(1))
    q_all = F.coalesce("q_all", F.lit(0.0))
    p_rest = (F.col("short") - F.coalesce("_n_common", F.lit(0))) / F.greatest("short", F.lit(1))
    total = F.coalesce("shared", F.lit(0.0)) + (p_all + q_all) / 2 + part(p_rest, F.greatest(F.lit(0.0), 1 - q_all))
    return pairs.groupBy("_key").agg(
        F.min(divergence(histogram(F.col("counts")), F.col("shares"))).alias("_by_class"),
        F.min(F.sqrt(F.greatest(total, F.lit(0.0)))).alias("_by_word"),
        F.coalesce(F.max("_n_common"), F.lit(0)).alias("_n_common"),
    )


def nearest(histogram: Column, known: list[list[float]]) -> Column:
    """Distance to the nearest of the known histograms."""
    each = [divergence(histogram, F.array(*[F.lit(x) for x in q])) for q in known]
    return F.least(*each) if len(each) > 1 else each[0]


def judge(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with a struct ``_quality``: the counts, base_failed, both distances (null if not judged) and kept."""
    names = [c for c in docs.columns if c != "_quality"]
    docs, text, lang = held(docs), held_name(text), held_name(lang)
    inline = references(docs, text, lang)
    langs, common, by_class, by_word = inline or ([], [], [], [])
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counted = (
        with_repeats(docs.withColumn("_words", words(F.col(text))), "_words", "_repeats")
        .withColumn("_lines", lines)
        .withColumn("_word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
        .withColumn("_rest", unlettered(F.col(text)))
        .withColumn("_counts", class_counts(F.col(text), F.col("_word_chars"), F.col("_rest")))
        .withColumn("_line", common_line(F.col("_words"), common) if common else F.lit(""))
        .withColumn("_short", F.size(short_words(F.col("_words"))))
    )
    times = F.array(*[times_in(F.col("_line"), w) for w in common]) if common else F.array().cast("array<bigint>")
    counted = counted.withColumn("_times", times)
    share = F.transform("_times", lambda x: x / F.greatest(F.col("_short"), F.lit(1)))
    n_common = F.aggregate("_times", F.lit(0).cast("long"), lambda a, x: a + x)
    shares = F.concat(share, F.array((F.col("_short") - n_common) / F.greatest(F.col("_short"), F.lit(1))))
    n_words = F.size("_words").cast("long")
    referenced = F.lit(True) if inline is None else F.col(lang).isNull() | F.col(lang).isin(langs)
    long_enough = (referenced & (F.char_length(text) >= MIN_CHARS_FOR_CLASSES), referenced & (F.col("_short") >= MIN_WORDS_FOR_COMMON))
    null = F.lit(None).cast("double")
    if inline is None:
        far = distances_to_all(docs, text, lang)
        judged = counted.withColumn("_key", text_key(F.col(text))).join(far, "_key", "left")
        judged = judged.withColumn("_by_class", F.when(long_enough[0], F.col("_by_class"))).withColumn("_by_word", F.when(long_enough[1], F.col("_by_word")))
        n_common = F.coalesce("_n_common", F.lit(0))
    else:
        judged = (
            counted.withColumn("_shares", shares)
            .withColumn("_by_class", F.when(long_enough[0], nearest(histogram(F.col("_counts")), by_class)) if by_class else null)
            .withColumn("_by_word", F.when(long_enough[1], nearest(F.col("_shares"), by_word)) if by_word else null)
        )
    judged = (
        judged.withColumn("_base", (n_words < MIN_WORDS) | (F.col("_repeats") * 100 > n_words * MOST_REPEATED_PERCENT))
    )
    some = F.col("_by_word").isNull() | (n_common > 0)
    near = (F.coalesce("_by_class", F.lit(0.0)) <= MOST_CLASS_DISTANCE) & (F.coalesce("_by_word", F.lit(0.0)) <= MOST_COMMON_DISTANCE)
    quality = F.struct(
        n_words.alias("n_words"),
        F.col("_word_chars").alias("word_chars"),
        F.get("_counts", 0).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_repeats").alias("n_repeat_words"),
        F.col("_base").alias("base_failed"),
        F.col("_by_class").alias("class_distance"),
        F.col("_by_word").alias("common_distance"),
        (~F.col("_base") & near & some).alias("kept"),
    )
    return given_back(judged.withColumn("_quality", quality), names, "_quality")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "_quality.*")
