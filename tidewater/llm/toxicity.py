"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - t_k): one weight vector is shared by the ordered thresholds
t_0 < t_1 < ... Features are a text's distinct lower-case words and the first four and five
letters of longer words (inflected forms share them), hashed. The expected severity is the
sum of P(grade > k); a text is rejected if P(grade > 0) is at least one half.

The model is fitted on a bounded sample of labelled rows (at most sample_per_class of each
grade, by hash order of their ids). Features are chosen and counted in Spark; the sample's
kept features are then fitted with proximal gradient steps (an L1 penalty keeps the weights
sparse). Every document is scored over its whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, cut, id_and_text, read_table, released

TOKEN = re.compile(r"[^\W\d_]+")


def features_of_word(word: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(f.encode()) for f in (word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)))


def features(text: str) -> np.ndarray:
    """The distinct hashed features of a text, in order."""
    found: set[int] = set()
    found.update(*map(features_of_word, set(TOKEN.findall(text.lower()))))
    return np.array(sorted(found), dtype=np.int64)


@dataclass
class OrdinalModel:
    """Weights by hashed feature, and one threshold for each step up in grade."""

    weights: dict[int, float]
    thresholds: list[float]

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and k."""
        return 1.0 / (1.0 + np.exp(np.clip(np.asarray(self.thresholds)[None, :] - np.asarray(score)[:, None], -60, 60)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def ordinal_loss(flat: np.ndarray, owner: np.ndarray, grades: np.ndarray, share: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, its gradient by the weights, by the thresholds): minus the log-likelihood of the grades, each row counting by its share.

    flat, owner: the active columns of all rows, and the row of each.
    """
    each, n = np.arange(len(grades)), len(grades)
    score = np.bincount(owner, weights=weights[flat], minlength=n)
    cdf = np.column_stack([np.zeros(n), _sigmoid(thresholds[None, :] - score[:, None]), np.ones(n)])
    low, high = cdf[each, grades], cdf[each, grades + 1]
    mass = np.maximum(high - low, 1e-12)
    d_low, d_high = low * (1 - low), high * (1 - high)
    d_weights = np.bincount(flat, weights=(share * (d_high - d_low) / mass)[owner], minlength=len(weights))
    d_threshold = np.zeros(len(thresholds) + 2)
    np.add.at(d_threshold, grades + 1, -share * d_high / mass)
    np.add.at(d_threshold, grades, share * d_low / mass)
    return float(-(share * np.log(mass)).sum()), d_weights, d_threshold[1:-1]


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, grade_count: int, l1: float | None = None, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of a cumulative-link model. rows: each sample's active columns, numbered from 0.

    l1 is the penalty on the mean loss; by default it falls with the noise, as the root of the sample's size.
    """
    l1 = 0.03 / np.sqrt(max(1, len(rows))) if l1 is None else l1
    columns = 1 + max((int(r.max()) for r in rows if len(r)), default=-1)
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if len(rows) else np.empty(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    share = np.bincount(grades, minlength=grade_count) + 0.5
    balance = (share**-0.5)[grades]  # half-way between rows and grades counting alike
    balance = balance / balance.sum()
    above = np.array([share[k + 1 :].sum() for k in range(grade_count - 1)]) / share.sum()
    prior = np.log((1 - above) / above)
    first, gaps = prior[0], np.log(np.maximum(np.diff(prior), 1e-2))
    weights = np.zeros(columns)
    momentum, ahead, t = weights.copy(), weights.copy(), 1.0
    usual = max(1.0, float(np.bincount(owner, weights=np.ones(len(flat)), minlength=len(rows)).max(initial=1.0)))
    rate, velocity = 4.0 / np.sqrt(usual), np.full(columns, 1e-8)
    for _ in range(rounds):
        thresholds = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        _, gradient, inner = ordinal_loss(flat, owner, grades, balance, ahead, thresholds)
        velocity = 0.9 * velocity + 0.1 * gradient**2
        step = rate * 0.05 / (np.sqrt(velocity) + 1e-4)
        moved = ahead - step * gradient
        weights = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = weights + min(0.5, (t - 1) / following) * (weights - momentum)
        momentum, t = weights, following
        first -= 0.5 * inner.sum()
        for k in range(len(gaps)):
            gaps[k] = np.clip(gaps[k] - 0.5 * np.exp(gaps[k]) * inner[k + 1 :].sum(), -4, 3)
    return weights, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def sample_labels(labels: DataFrame, sample_per_class: int) -> DataFrame:
    """(doc_id, grade) of at most sample_per_class labelled ids of each grade, by hash order of the id.

    Grades from labels: 0 not toxic; toxic is 1, and 2 if the text is of low quality too. Rows
    with a null id or a null toxic are left out; a null quality counts as good. An id that is
    labelled repeatedly has its highest grade.
    """
    toxic, poor = F.col("toxic") > 0, F.coalesce(F.col("quality"), F.lit(1)) < 1
    graded = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(toxic & poor, 2).when(toxic, 1).otherwise(0).alias("grade"))
    graded = graded.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    tops = [graded.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_class) for g in range(3)]
    return cut(tops[0].unionByName(tops[1]).unionByName(tops[2]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_per_class: int = 4000, max_features: int = 4096, least_rows: int = 3) -> OrdinalModel:
    """Fit on labelled documents. What reaches the driver is bounded: 3 * sample_per_class rows of at most max_features features.

    Without labelled documents of more than one grade nothing can be learned: the model then
    has no weights and rejects nothing.
    """
    sample = sample_labels(labels, sample_per_class)
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("feature", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pa.array([features(t.as_py()) for t in b["text"]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["grade"], lists], schema=schema)

    texts = id_and_text(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text")  # 3 * sample_per_class rows
    sparse = cut(texts.mapInArrow(released(run), "doc_id long, grade int, feature array<long>"))
    counts = {r["grade"]: r["n"] for r in sparse.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    clean, toxic = counts.get(0, 0), sum(n for g, n in counts.items() if g)
    if not clean or not toxic:
        return OrdinalModel({}, [30.0, 31.0])
    seen = sparse.select("grade", F.explode("feature").alias("feature")).groupBy("feature").agg(F.count_if(F.col("grade") > 0).alias("t"), F.count_if(F.col("grade") == 0).alias("c"))
    spread = F.sqrt((F.col("t") + F.col("c")).cast("double")) + 1
    gain = F.abs(F.col("t") / toxic - F.col("c") / clean) / spread * (toxic + clean)
    chosen = seen.where(F.col("t") + F.col("c") >= least_rows).orderBy(gain.desc(), "feature").limit(max_features)
    number = {f: i for i, f in enumerate(sorted(r["feature"] for r in chosen.select("feature").collect()))}
    rows, grades = [], []
    wanted = F.broadcast(chosen.select("feature"))  # max_features rows
    kept = sparse.select("doc_id", "grade", F.explode_outer("feature").alias("feature")).join(wanted.withColumn("hit", F.lit(True)), "feature", "left")
    kept = kept.groupBy("doc_id", "grade").agg(F.collect_set(F.when(F.col("hit"), F.col("feature"))).alias("feature")).orderBy("doc_id")
    for r in kept.toLocalIterator():
        rows.append(np.array(sorted(number[f] for f in r["feature"]), dtype=np.int64))
        grades.append(r["grade"])
    weights, thresholds = fit_ordinal(rows, np.array(grades), 3)
    by_feature = {f: float(weights[c]) for f, c in number.items() if c < len(weights) and weights[c]}
    return OrdinalModel(by_feature, [float(x) for x in thresholds])


def _active(weights: dict[int, float]) -> BoundedCache:
    return BoundedCache(lambda word: tuple(f for f in features_of_word(word) if f in weights), 150_000)


def _score(text: str, active: BoundedCache, weights: dict[int, float]) -> float:
    found: set[int] = set()
    found.update(*filter(None, map(active.__getitem__, set(TOKEN.findall(text.lower())))))
    return sum(weights[f] for f in sorted(found))


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_severity, p_toxic, grade, toxic) of every row, over whole texts.

    grade is the largest k with P(grade >= k) of at least one half. A null or empty text has
    no features and is scored by the thresholds alone. Null ids and repeated rows are kept as
    they are, an empty table gives none, other columns are left out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("expected_severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())])
    weights, thresholds = model.weights, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(weights, thresholds)
        active = _active(weights)
        for b in batches:
            scores = np.fromiter((_score(t.as_py(), active, weights) for t in b["text"]), dtype=np.float64, count=b.num_rows)
            above = own.exceed(scores)
            grade = (above >= 0.5).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(above.sum(axis=1).round(6)), pa.array(above[:, 0].round(6)), pa.array(grade), pa.array(grade > 0)], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(released(run), "doc_id long, expected_severity double, p_toxic double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs without the rejected ones, in one pass: rows and columns that stay are as they were. Only texts go to Python.

    A null or empty text is judged by the thresholds alone; ids aren't read, so null and repeated
    ones stay as they are; an empty table gives no rows.
    """
    weights, thresholds = model.weights, model.thresholds

    @F.pandas_udf("boolean")
    def accepted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        active = _active(weights)
        for texts in batches:
            yield pd.Series([_score(t or "", active, weights) < thresholds[0] for t in texts], dtype=bool)

    return docs.where(accepted(F.coalesce(F.col("text"), F.lit(""))))


def op5_ordinal_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))
