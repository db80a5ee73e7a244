"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a document of label 1 over one of label 0) give a linear score
by logistic loss on feature differences. The cut is a quantile of the training
scores: the one that tells the labels apart best; scores are mapped so that
it lies at ``threshold``.

Plan: the fit reads at most ``max_labelled`` labelled documents, chosen by a hash
of the id over all of them (the only sample here; the bound is a parameter);
their ids are broadcast, which that bound makes safe. Scoring is one narrow pass
over the whole texts.

Defined results: a null text is empty and gets a score like any other; null
labels and ids are left out of the fit; a document labelled twice counts twice, of
several documents of one id the one of least features counts;
without labels of both kinds all scores are 0.5; equal texts have equal scores, and a score
equal to the threshold is kept; very long texts are read whole; an empty table gives no rows; other columns pass
through whatever their names, but for one named as ``score_col``, which the score replaces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import holding, require, spare

MAX_LABELLED = 20_000
NAMES = (
    "log_words", "word_length", "symbols", "upper", "pipes", "marks", "digits", "distinct_words", "duplicate_lines",
    "words_per_line", "stops", "longest_word", "symbol_ends", "shouted_words", "repeated_windows", "letters",
)
_SYMBOL = re.compile(r"[#*$%&<>{}\[\]\\^~@=+]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_MARK = re.compile(r"[!?]")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[a-zA-ZÀ-ɏ]+")
_STOP = re.compile(r"[.,;:](?=\s|\Z)")
_SYMBOL_END = re.compile(r"[#*$%&!|]{2,}(?=\s|\Z)")
_SHOUT = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")


def features(text: str | None) -> list[float]:
    """``NAMES``, each a ratio or a logarithm, of the whole text."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    windows = set(zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else set()
    letters = sum(map(len, _LETTER.findall(text)))
    count = lambda p: len(p.findall(text))
    return [
        log1p(len(words)),
        min(30.0, letters / n),
        count(_SYMBOL) / n,
        count(_UPPER) / max(1, letters),
        text.count("|") / n,
        count(_MARK) / n,
        count(_DIGIT) / chars,
        len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        log1p(len(words) / max(1, len(lines))),
        count(_STOP) / n,
        log1p(max(map(len, words), default=0)),
        count(_SYMBOL_END) / n,
        count(_SHOUT) / n,
        1 - len(windows) / max(1, len(words) - 2) if len(words) > 2 else 0.0,
        letters / chars,
    ]


@dataclass(frozen=True)
class Ranker:
    """score = sigmoid(weights * standardised features + offset)."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    offset: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - np.array(self.mean)) / np.array(self.scale)).clip(-8, 8) @ np.array(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) + self.offset, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, threshold: float = 0.3, pairs_each: int = 20, penalty: float = 1e-3, seed: int = 7) -> Ranker:
    """Newton steps on the pairs' logistic loss, then the cut by score quantile."""
    d = len(NAMES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker((0.0,) * d, (1.0,) * d, (0.0,) * d, 0.0)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = ((x - mean) / scale).clip(-8, 8)
    rng = np.random.default_rng(seed)
    # Every document of either label takes part in some pairs.
    a = np.r_[rng.choice(good, len(bad) * pairs_each), np.repeat(good, 2)]
    b = np.r_[np.repeat(bad, pairs_each), rng.choice(bad, len(good) * 2)]
    diff = z[a] - z[b]
    w = np.zeros(d)
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        gradient = -(diff * p[:, None]).mean(0) + penalty * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + penalty * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    # Cutting below place k drops the k lowest scores; documents of label 1 must not be lost lightly.
    lost = np.r_[0, np.cumsum(y[order] == 1)] / len(good)
    caught = np.r_[0, np.cumsum(y[order] == 0)] / len(bad)
    gain = caught - 2 * lost
    ks = np.flatnonzero(gain >= gain.max() - 1e-12)
    k = int(ks[len(ks) // 2])
    ordered = np.r_[s[order[0]] - 1, s[order], s[order[-1]] + 1]
    cut = (ordered[k] + ordered[k + 1]) / 2
    return Ranker(tuple(mean), tuple(scale), tuple(w), float(np.log(threshold / (1 - threshold)) - cut))


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, **options) -> Ranker:
    """Fit on labelled documents outside fold 0, ``max_labelled`` at most."""
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(F.col(id_col)) != 0))
    order = [F.xxhash64("id"), F.col("id"), F.col("y")]
    chosen = chosen.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).orderBy(*order).limit(max_labelled)
    chosen = chosen.withColumn("n", F.row_number().over(Window.orderBy(*order)))  # of at most max_labelled rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "text", "n")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t) for t in batch.column(2).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int64()), x, batch.column(3).cast(pa.int64())], names=["id", "y", "x", "n"])

    # One row for each label, however many documents have its id.
    found = rows.mapInArrow(task, "id string, y bigint, x array<double>, n bigint").groupBy("n").agg(F.min("id").alias("id"), F.min("y").alias("y"), F.min("x").alias("x")).toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    y, ids = found.column("y").to_numpy(), found.column("id").to_numpy(zero_copy_only=False)
    order = np.lexsort((*x.T, y, [zlib.crc32(i.encode()) for i in ids])) if len(y) else []
    return fit(x[order], y[order], **options)


def score(docs: DataFrame, model: Ranker, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1) added."""
    require(docs, text_col)

    @F.pandas_udf("double")
    def of(texts):
        import pandas as pd

        holding(None)
        return pd.Series(model.score(np.array([features(t) for t in texts], float).reshape(-1, len(NAMES))))

    return docs.withColumn(score_col, of.asNondeterministic()(F.col(text_col)))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """``docs`` without the rows that score under ``threshold``. All columns stay."""
    names = docs.columns
    column = spare(docs, "_score")
    return score(docs, train(docs, labels, threshold=threshold, **options), score_col=column).where(F.col(column) >= threshold).select(*names)
