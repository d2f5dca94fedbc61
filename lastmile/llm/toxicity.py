"""Toxicity by a classifier chain.

The labelled categories are predicted one after the other, each by a logistic regression over the words of a
document and the probabilities of the categories before it. A later model must not learn from probabilities
that an earlier one gives to its own training rows, so these are out-of-fold: each fold is predicted by a
model of the other folds. Unlabelled documents get them from the models of all folds.

The models are fitted on ``MOST_TRAINING`` labelled documents at most (an even sample by hash of the id), on
the words and beginnings of words of at least ``MIN_DOCUMENTS`` of them, ``MOST_WORDS`` at most. Every document is scored.

Defined cases: a null, empty or blank text has no words and gets the probability of an empty document;
repeated labels of an id count once (the largest); labels null or of unknown ids are not learned from; with no
labelled documents at all every probability is 0 and nothing is toxic; repeated rows are scored alike; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lastmile.llm.common import cut, table

CHAIN = ("quality", "toxic")  # in order of prediction; the last one decides
MOST_TRAINING = 20_000
FOLDS = 3
MIN_DOCUMENTS = 5
MOST_WORDS = 50_000
REGULARISATION = 1e-4  # on the sum of absolute weights: most words get none
TRAINING_PARTS = 2  # every step of a fit is a job; more parts of a bounded sample only add tasks
MOST_STEPS = 30
THRESHOLD = 0.4
BEGINNINGS = (4, 5)  # letters of a word that are a feature of their own


def bare_words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_features(text: Column) -> Column:
    """The distinct words of a text and their beginnings, which stand for a word's inflected and compound forms."""
    found = F.array_distinct(bare_words(text))
    starts = [F.transform(F.filter(found, lambda w, n=n: F.char_length(w) > n), lambda w, n=n: F.concat(F.lit("^"), F.left(w, F.lit(n)))) for n in BEGINNINGS]
    return F.array_distinct(F.concat(found, *starts))


def fraction(key: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))


def fit(rows: DataFrame, label: str, before: list[str]):
    """Model of one category over ``words_of`` and the probabilities of the categories before it."""
    inputs = with_inputs(rows.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double")), before)
    return LogisticRegression(featuresCol="_inputs", labelCol=label, regParam=REGULARISATION, elasticNetParam=1.0, maxIter=MOST_STEPS, standardization=False).fit(inputs)


def with_inputs(rows: DataFrame, before: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=["_words", *before], outputCol="_inputs").transform(rows)


def predicted(rows: DataFrame, model, before: list[str], out: str) -> DataFrame:
    scored = model.setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_prediction").transform(with_inputs(rows, before))
    return scored.withColumn(out, vector_to_array("_probability")[1]).drop("_inputs", "_probability", "_raw", "_prediction")


def train(labelled: DataFrame, chain: tuple[str, ...] = CHAIN):
    """(word model, one model per category) from rows doc_id, words and the categories."""
    words = CountVectorizer(inputCol="words", outputCol="_words", binary=True, minDF=MIN_DOCUMENTS, vocabSize=MOST_WORDS).fit(labelled)
    fold = F.floor(fraction(F.col("doc_id"), 1) * FOLDS).cast("int")
    rows = cut(words.transform(labelled).withColumn("fold", fold).select("doc_id", "fold", "_words", *chain).coalesce(TRAINING_PARTS))
    models, before = [], []
    for place, category in enumerate(chain):
        models.append(fit(rows, category, before))
        if place == len(chain) - 1:
            break
        out, parts = f"p_{category}", []
        for k in range(FOLDS):
            others = rows.where(F.col("fold") != k)
            model = models[-1] if others.isEmpty() else fit(others, category, before)
            parts.append(predicted(rows.where(F.col("fold") == k), model, before, out))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        rows = cut(whole)
        before = [*before, out]
    return words, models


def score(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...] = CHAIN) -> DataFrame:
    """(doc_id, p_<category> of the chain, toxic) of every row of ``docs``."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in chain])
    known = known.where(F.greatest(*[F.col(c).isNotNull() for c in chain]))
    rows = docs.select("doc_id", "text")
    share = MOST_TRAINING / max(known.count(), 1)
    sample = known.where(fraction(F.col("doc_id"), 2) < share)
    labelled = cut(rows.join(sample, "doc_id").select("doc_id", word_features(F.col("text")).alias("words"), *chain))
    names = [f"p_{c}" for c in chain]
    usable = labelled.agg(*[F.count(c).alias(c) for c in chain], F.max(F.size("words")).alias("words")).first()
    if not all(usable[c] for c in chain) or not usable["words"]:
        return rows.select("doc_id", *[F.lit(0.0).alias(n) for n in names], F.lit(False).alias("toxic"))
    words, models = train(labelled, chain)
    scored = words.transform(rows.select("doc_id", word_features(F.col("text")).alias("words"))).drop("words")
    before: list[str] = []
    for name, model in zip(names, models, strict=True):
        scored = predicted(scored, model, before, name)
        before = [*before, name]
    return scored.select("doc_id", *names, (F.col(names[-1]) >= THRESHOLD).alias("toxic"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
