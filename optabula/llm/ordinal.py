"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

A text is a set of hashed features: its lower-cased runs of letters, its runs of signs and digits,
and binned shares (capitals, signs, distinct words, length). One weight vector is shared by all
grades, and ordered thresholds cut the score: P(grade <= g) = logistic(t_g - w x). The model gives
the expected grade and the probability of a grade from `keep_from` on, by which texts are selected.

Features and scores are computed in Arrow batches over all texts. The fit takes a bounded sample of
rated documents (`sample`: those whose doc_ids hash least), whose features go to the driver.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optabula.kernels import curvature_direction

from .common import fresh, written

SIZE_BITS = 18
GRADES = 3
# Features of fewer sampled documents have weight 0.
LEAST_DOCUMENTS = 5
# Features whose part of the loss is worked out at once: the driver holds them all, in four bytes each.
AT_ONCE = 1 << 19
_RUNS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _bin(share: float) -> int:
    return int(min(share, 1.0) * 10)


def features(text: str) -> np.ndarray:
    """The sorted distinct feature numbers of a text; a text without words has one of its own."""
    runs = _RUNS.findall(text)
    letters = [r for r in runs if r[0].isalpha()]
    lower = text.lower()
    kinds = set(_RUNS.findall(lower)) if lower != text else set(runs)
    words = max(len(letters), 1)
    upper = sum(map(str.isupper, letters)) if letters else 0
    kinds |= {f"\x01upper{_bin(upper / words)}",
              f"\x01signs{_bin((len(runs) - len(letters)) / words)}",
              f"\x01distinct{_bin(len(set(letters)) / words)}",
              f"\x01length{len(letters).bit_length()}"}
    mask = (1 << SIZE_BITS) - 1
    return np.unique(np.fromiter(
        (zlib.crc32(k.encode("utf-8", "replace")) & mask for k in kinds), np.int32, len(kinds)))


class Ordinal(NamedTuple):
    weights: np.ndarray  # float32, 2**SIZE_BITS
    thresholds: np.ndarray  # GRADES - 1, ascending

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > g) for g = 0 .. GRADES - 2, one row per score."""
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(self.thresholds[None, :] - scores[:, None]))


def _cuts(owner: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of whole documents, of about AT_ONCE features each."""
    starts = np.searchsorted(owner, owner[::AT_ONCE])
    edges = np.unique(np.r_[starts, len(owner)]).tolist()
    return list(zip(edges, edges[1:]))


def _loss(p: np.ndarray, rows: tuple, grades: np.ndarray, ridge: float) -> tuple:
    """Mean negative log-likelihood with its gradient; p: weights, first threshold, log gaps."""
    index, owner, n_features = rows
    n = len(grades)
    w, gaps = p[:n_features], np.exp(p[n_features + 1:])
    t = np.r_[-np.inf, p[n_features] + np.r_[0.0, np.cumsum(gaps)], np.inf]
    cuts = _cuts(owner)
    score = np.zeros(n)
    for a, b in cuts:
        first, last = owner[a], owner[b - 1] + 1
        score[first:last] = np.bincount(owner[a:b] - first, w[index[a:b]], minlength=last - first)
    with np.errstate(over="ignore"):
        hi, lo = (1.0 / (1.0 + np.exp(-(t[grades + k] - score))) for k in (1, 0))
    mass = np.maximum(hi - lo, 1e-300)
    d_hi, d_lo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
    by_score = (d_hi - d_lo) / n
    grad_w = np.zeros(n_features)
    for a, b in cuts:  # added one by one: the sum does not depend on the cuts
        np.add.at(grad_w, index[a:b].astype(np.intp), by_score[owner[a:b]])
    grad_w += ridge * w
    by_t = (np.bincount(grades, -d_hi, minlength=GRADES)[:-1]
            + np.bincount(grades, d_lo, minlength=GRADES)[1:]) / n
    grad_t = np.r_[by_t.sum(), [by_t[k + 1:].sum() * gaps[k] for k in range(len(gaps))]]
    value = -np.log(mass).mean() + 0.5 * ridge * w @ w
    # A weak pull keeps thresholds finite where a grade has no ratings.
    pull = 1e-4 * p[n_features:]
    return value + 0.5 * (pull @ p[n_features:]), np.r_[grad_w, grad_t + pull]


def fit_ordinal(sets: list[np.ndarray], grades: np.ndarray, ridge: float = 5e-4,
                rounds: int = 80) -> Ordinal:
    """Limited-memory quasi-Newton over the sampled documents' feature sets.

    Without any rating nothing is known against any text: thresholds of minus infinity.
    """
    weights = np.zeros(1 << SIZE_BITS, np.float32)
    if not len(grades):
        return Ordinal(weights, np.full(GRADES - 1, -np.inf))
    found_in = np.zeros(1 << SIZE_BITS, np.int64)
    for s in sets:
        np.add.at(found_in, s, 1)
    held = found_in >= LEAST_DOCUMENTS
    number = (np.cumsum(held) - 1).astype(np.int32)
    n_features = int(held.sum())
    sets = [number[s[held[s]]] for s in sets]
    rows = (np.concatenate(sets), np.repeat(
        np.arange(len(sets), dtype=np.int32), [len(s) for s in sets]), n_features)
    del sets
    p = np.r_[np.zeros(n_features), -1.0, np.zeros(GRADES - 2)]
    value, grad = _loss(p, rows, grades, ridge)
    pairs: list = []
    for _ in range(rounds):
        if np.linalg.norm(grad) < 1e-6:
            break
        step = curvature_direction(grad, pairs)
        if step @ grad >= 0:
            step, pairs = -grad, []
        size = 1.0 if pairs else min(1.0, 1.0 / np.linalg.norm(grad))
        while size > 1e-8:
            trial = p + size * step
            trial_value, trial_grad = _loss(trial, rows, grades, ridge)
            if trial_value <= value + 1e-4 * size * (grad @ step):
                break
            size /= 2
        else:
            break
        s, y = trial - p, trial_grad - grad
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-10:]
        p, value, grad = trial, trial_value, trial_grad
    weights[held] = p[:n_features]
    return Ordinal(weights, p[n_features] + np.r_[0.0, np.cumsum(np.exp(p[n_features + 1:]))])


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for low quality, 1 for good but toxic texts, 2 for good clean ones.

    Rows with a null are no ratings; of several ratings of a document the lowest counts.
    """
    grade = F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).otherwise(2)
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, rated: DataFrame, sample: int = 20_000) -> Ordinal:
    """Fits on at most `sample` rated texts, those whose doc_id and text hash least.

    Rows that repeat a doc_id and its text are one case; other texts of the doc_id are cases too.
    """
    from collections.abc import Iterator

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([features(t.as_py()) for t in batch.column(3)],
                                              pa.list_(pa.int32()))],
                names=["doc_id", "text_key", "grade", "features"])

    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.coalesce("text", F.lit(""))
    found = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"),
                         text.alias("text"))
             .join(F.broadcast(chosen), "doc_id")  # at most `sample` ids
             .select("doc_id", "text_key", "grade", "text")
             .mapInArrow(hashed, "doc_id long, text_key long, grade int, features array<int>")
             .dropDuplicates(["doc_id", "text_key"]))
    found = written(found, "rated")
    if found.count() > sample:  # doc_ids that come with several texts
        found = found.orderBy(F.xxhash64("doc_id", "text_key"), "doc_id", "text_key").limit(sample)
    cases = found.select("grade", "features").toArrow()
    return fit_ordinal([np.asarray(x.values) for x in cases.column("features")],
                       cases.column("grade").to_numpy().astype(np.int64))


def scored(spark, model: Ordinal, keep_from: int = 2, least: float = 0.5):
    """A function of the text column: struct of expected_grade, p_keep and kept."""
    shared = spark.sparkContext.broadcast(model)  # 1 MB

    @F.pandas_udf("expected_grade double, p_keep double, kept boolean")
    def score(texts):
        import pandas as pd

        m = shared.value
        scores = np.array([m.weights[features(t or "")].sum(dtype=np.float64) for t in texts])
        above = m.above(scores)
        p = above[:, keep_from - 1]
        return pd.DataFrame({"expected_grade": above.sum(axis=1), "p_keep": p, "kept": p >= least})

    return score


def classify(docs: DataFrame, labels: DataFrame, sample: int = 20_000, keep_from: int = 2,
             least: float = 0.5) -> DataFrame:
    """`docs` with the struct `quality` behind its columns, from a model trained on its ratings.

    Null texts are empty; null doc_ids are scored and never rated; repeated rows are scored each;
    ties of the sample's hash go to the lesser doc_id; an empty table gives no rows; without any
    rating all texts are kept; other columns are kept as they are. Where `docs` has a column
    `quality`, the struct's name gets an underscore.
    """
    name, = fresh(docs, "quality")
    model = train(docs, ratings(labels), sample)
    score = scored(docs.sparkSession, model, keep_from, least)
    return docs.withColumn(name, score(F.coalesce("text", F.lit(""))))
