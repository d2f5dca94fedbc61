"""Language identification by mixture inference over n-grams.

Training counts hashed byte trigrams per language over all training documents. A document is taken for
a mixture: each of its trigrams comes from one of its languages. Expectation-maximisation
estimates the proportions; the set of languages is chosen by penalised likelihood, adding a language only
where the gain in likelihood outweighs the penalty for one more proportion. The prediction is the
language with the largest proportion, which is also the score.

The model is a table of ``languages x 65,536`` probabilities; ``MOST_LANGUAGES`` bounds it (the languages
with the most training documents).

Defined cases: a null text and a text without a letter are ``und`` with score 0, as is every text when
nothing could be learned; null languages are not learned from; repeated rows are predicted alike; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lastmile.llm.common import table

CELLS = 1 << 16
MOST_LANGUAGES = 256
SMOOTHING = 0.5
FOLDS, HELD_OUT = 3, 1
FIT_STEPS = 12
REFIT_STEPS = 8
LEAST_SHARE = 0.02  # a language needs this proportion in the first fit to be a candidate
OVERLAP = 3  # neighbouring trigrams share letters: this many count as one observation
PENALTY = 3.0  # times log of the number of observations, per language added

#: Letters in lower case, other bytes of UTF-8 characters as they are, all else a space.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LETTER = regex.compile(r"\p{L}")  # fractions, superscripts and enclosed or Roman numerals are none


def grams(text: str) -> np.ndarray:
    """Cells of the trigrams of a text, runs of blanks left out."""
    folded = b" %s " % b" ".join(text.lower().encode().translate(FOLDED).split())
    b = np.frombuffer(folded, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities of the cells, from rows (lang, text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang", sort=False)["text"]:
                found = np.concatenate([grams(text) for text in texts])
                sums[lang] = sums.get(lang, 0) + np.bincount(found, minlength=CELLS)
        for lang, cells in sums.items():
            used = np.flatnonzero(cells)
            yield pd.DataFrame({"lang": lang, "cell": used.astype(np.int32), "n": cells[used]})

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()]
    if not langs:
        return [], np.empty((0, CELLS))
    counted = known.where(F.col("lang").isin(langs)).mapInPandas(count, "lang string, cell int, n long")
    cells = counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(langs)
    sums = np.full((len(langs), CELLS), SMOOTHING)
    np.add.at(sums, (cells["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(int), cells["cell"].to_numpy(int)), cells["n"].to_numpy(float))
    return langs, np.log(sums / sums.sum(axis=1, keepdims=True)).astype(np.float32)


def fit(likelihood: np.ndarray, weight: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Proportions of the rows of ``likelihood`` (languages x cells) and the mean log likelihood, by EM."""
    share = np.full(len(likelihood), 1 / len(likelihood))
    total = weight.sum()
    for _ in range(steps):
        mixed = share @ likelihood
        share = share * (likelihood @ (weight / mixed)) / total
    return share, float(weight @ np.log(share @ likelihood))


def infer(found: np.ndarray, model: np.ndarray) -> tuple[int, float]:
    """Place of the main language of a document's cells, and its proportion."""
    cells, weight = np.unique(found, return_counts=True)
    weight = weight.astype(np.float64)
    logs = model[:, cells].astype(np.float64)
    likelihood = np.exp(logs - logs.max(axis=0))  # a factor per cell changes no proportion and no comparison
    singles = np.log(likelihood) @ weight
    chosen = [int(singles.argmax())]
    share, best = np.ones(1), singles[chosen[0]]
    first, _ = fit(likelihood, weight, FIT_STEPS)
    order = [int(k) for k in np.argsort(-first, kind="stable") if first[k] >= LEAST_SHARE]
    cost = PENALTY * np.log(max(len(found) / OVERLAP, 2.0))
    for k in order:
        if k in chosen:
            continue
        tried, gained = fit(likelihood[[*chosen, k]], weight, REFIT_STEPS)
        if (gained - best) / OVERLAP > cost:
            chosen, share, best = [*chosen, k], tried, gained
    main = int(share.argmax())
    return chosen[main], float(min(max(share[main], 0.0), 1.0))


def predict(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                infer(grams(text), shared.value) if langs and text and LETTER.search(text) else None
                for text in batch.column(1).to_pylist()
            ]
            lang = pa.array([langs[r[0]] if r else "und" for r in rows], pa.string())
            score = pa.array([r[1] if r else 0.0 for r in rows], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, score], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(guess, "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    langs, model = learn(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    guessed = predict(docs.select("doc_id", "text"), langs, model)
    return guessed.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
