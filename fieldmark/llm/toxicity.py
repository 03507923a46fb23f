"""Toxicity as an ordered severity, by cumulative-link regression on the words of a text.

``P(grade > k) = sigmoid(w.x - cut_k)``: all cuts share the weights ``w``, so the predicted chances are
ordered, and the sum of them is the expected severity. ``x`` has a 1 for each word, or beginning of a word,
of the vocabulary that the text holds.

The fit reads at most ``max_labelled`` labelled documents, those with the smallest hash of their id; this bound
also bounds the vocabulary. The sample's sparse rows are the only thing that reaches the driver.
Scoring reads every document in one pass, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features too: they stand for the forms of a stem.
BEGINNINGS = (5, 6)
#: Standard errors from the overall share that make a feature part of the vocabulary.
LEAST_Z = 4.5

SCORES = T.StructType(
    [
        T.StructField("n_matched", T.LongType(), False),
        T.StructField("expected_severity", T.DoubleType(), False),
        T.StructField("p_toxic", T.DoubleType(), False),
        T.StructField("grade", T.IntegerType(), False),
        T.StructField("is_toxic", T.BooleanType(), False),
    ]
)


@dataclass(frozen=True)
class OrdinalModel:
    words: tuple[str, ...]
    weights: np.ndarray
    cuts: np.ndarray


def features(text: str | None) -> set[str]:
    """Lower-case runs of letters, and the beginnings of the longer ones (written with a dash after them)."""
    words = set(LETTERS.findall(text.lower())) if text else set()
    return words | {f"{word[:n]}-" for word in words for n in BEGINNINGS if len(word) > n}


@F.pandas_udf(T.ArrayType(T.StringType()))
def feature_sets(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: sorted(features(text)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def fit_ordinal(
    rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, width: int, penalty: float = 0.01, steps: int = 600
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing cuts of the cumulative-link model, by accelerated gradient steps.

    ``rows`` and ``columns`` are the places of the ones. The cuts are the first cut and the logarithms of
    the gaps after it, so they stay in order.
    """
    n, top = len(grades), int(grades.max()) if len(grades) else 0
    weights = np.zeros(width)
    if not n or not top:
        return weights, np.full(max(top, 1), 20.0)
    share = np.array([np.clip((grades > k).mean(), 1e-4, 1 - 1e-4) for k in range(top)])
    start = -np.log(share / (1 - share))
    free = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
    above = (grades[:, None] > np.arange(top)).astype(float)
    state = np.concatenate((weights, free))
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, steps + 1):
        weights, free = state[:width], state[width:]
        gaps = np.exp(free[1:])
        cuts = free[0] + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(rows, weights=weights[columns], minlength=n)
        upper = sigmoid(score[:, None] - cuts)  # chance to be above each cut
        padded = np.concatenate((np.ones((n, 1)), upper, np.zeros((n, 1))), axis=1)
        each = np.arange(n)
        chance = np.maximum(padded[each, grades] - padded[each, grades + 1], 1e-12)
        slope = np.zeros((n, top + 2))
        slope[:, 1:-1] = upper * (1 - upper)
        low, high = slope[each, grades], slope[each, grades + 1]
        by_score = -(low - high) / chance
        by_cut = np.zeros(top + 2)
        np.add.at(by_cut, grades, low / chance)
        np.add.at(by_cut, grades + 1, -high / chance)
        by_cut = by_cut[1:-1]
        tail = np.cumsum(by_cut[::-1])[::-1]
        slope_of_free = np.concatenate((tail[:1], tail[1:] * gaps))
        slope_of_weights = np.bincount(columns, weights=by_score[rows], minlength=width) + penalty * weights
        gradient = np.concatenate((slope_of_weights, slope_of_free)) / n
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = 0.1 * (1 - step / (steps + 1))
        state = state - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
    weights, free = state[:width], state[width:]
    return weights, free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 20_000,
    least_docs: int = 5,
    grades: int = 3,
) -> OrdinalModel:
    """A model from binary labels.

    The words of the vocabulary are those whose share of toxic documents is farthest from the overall
    share (at least LEAST_Z standard errors). Toxic documents get the grades 1 to ``grades`` by how many
    words that mark toxicity they hold; the others have grade 0. Rows without an id, label or text take
    no part; a document labelled twice is toxic if one label says so.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", feature_sets("text").alias("words"))
    rows = rows.persist()
    try:
        total = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
        if not total[0] or not total[1] or total[0] == total[1]:
            return OrdinalModel((), np.zeros(0), np.full(grades, 20.0))
        share = total[1] / total[0]
        counted = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
            F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("n_toxic")
        )
        spread = F.sqrt(F.col("n") * share * (1 - share))
        vocabulary = (
            counted.where(F.col("n") >= least_docs)
            .select("word", ((F.col("n_toxic") - F.col("n") * share) / spread).alias("z"))
            .where(F.abs("z") >= LEAST_Z)
            .orderBy(F.abs("z").desc(), "word")
            .collect()
        )
        words = [row.word for row in vocabulary]
        place = {word: i for i, word in enumerate(words)}
        marks = np.array([row.z > 0 for row in vocabulary], dtype=bool)

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def places(sets: pd.Series) -> pd.Series:
            return sets.map(lambda found: [place[w] for w in found if w in place])

        kept = rows.select("toxic", places("words").alias("places")).toPandas()
    finally:
        rows.unpersist()
    toxic = kept["toxic"].to_numpy(dtype=int)
    sizes = kept["places"].map(len).to_numpy(dtype=int)
    columns = np.concatenate([*kept["places"].map(lambda x: np.asarray(x, dtype=int)), np.zeros(0, dtype=int)])
    at = np.repeat(np.arange(len(kept)), sizes)
    marked = np.bincount(at, weights=marks[columns] if len(words) else None, minlength=len(kept))
    bounds = np.quantile(marked[toxic == 1], np.arange(1, grades) / grades)
    grade = np.where(toxic == 1, 1 + np.searchsorted(bounds, marked, side="left"), 0)
    weights, cuts = fit_ordinal(at, columns, grade, len(words))
    return OrdinalModel(tuple(words), weights, cuts)


def score(
    docs: DataFrame, model: OrdinalModel, text: str = "text", out: str = "toxicity", threshold: float = 0.35
) -> DataFrame:
    """``docs`` with a struct ``out`` of SCORES; null and empty texts hold no word of the vocabulary.

    ``grade`` is the most likely grade; ``is_toxic`` says that the text holds a word of the vocabulary and that a
    grade above 0 has a chance of at least ``threshold``. A column that is already named ``out`` is replaced.
    Repeated rows are scored alike; an empty table stays empty.
    """
    weight = dict(zip(model.words, model.weights.tolist(), strict=True))
    cuts = model.cuts

    @F.pandas_udf(SCORES)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = weight.keys()
        for texts in batches:
            found = [known & features(text) for text in texts]
            z = np.array([sum(weight[w] for w in sorted(hit)) for hit in found], dtype=float).reshape(-1, 1)
            upper = sigmoid(z - cuts)
            edge = np.ones((len(z), 1))
            chances = -np.diff(np.concatenate((edge, upper, 0 * edge), axis=1), axis=1)
            yield pd.DataFrame(
                {
                    "n_matched": np.array([len(hit) for hit in found], dtype=np.int64),
                    "expected_severity": upper.sum(axis=1),
                    "p_toxic": upper[:, 0],
                    "grade": chances.argmax(axis=1).astype(np.int32),
                    "is_toxic": (upper[:, 0] >= threshold) & np.array([bool(hit) for hit in found], dtype=bool),
                }
            )

    return docs.withColumn(out, predict(F.col(f"`{text}`")))
