"""Quality by regularised quadratic discriminant analysis.

Each text gets statistics of its characters, words and lines, transformed
towards normal shape (logarithms of sizes, smoothed log-odds of shares). For
each class the mean and covariance of the training rows are kept; a covariance
is shrunk towards the pooled one and towards a diagonal, so it is always
invertible. A text's score is the probability of class 1 from the difference of
the classes' log densities: half the squared Mahalanobis distance, by a
product with the inverse of the class's Cholesky factor (both are made once and
cached in the model), and the log determinant.

Means and covariances come from counts, sums and sums of products over all
training rows, added up where the rows are; nothing is sampled.

Training rows are the labelled documents whose ``crc32(doc_id)`` modulo
``folds`` is not 0; the label, the language, the source and the id are never
inputs of a score.

Defined results: null and empty texts have the statistics of an empty text and
get a score like any other; labels that are null or neither 0 nor 1 are not
used; an id labelled twice counts twice; with training rows of one class only,
or none, every score is the share of class 1 (0.5 for none); equal texts get
equal scores; a text of any length is read whole; an empty table gives no rows;
an input column named as a result is kept under a name with a leading
underscore (with ``store`` the id alone is kept).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import aside, fresh, load, shielded, small_batches, stored, unshielded

FOLDS = 5
THRESHOLD = 0.3
SHRINK_POOLED = 0.1
SHRINK_DIAGONAL = 0.05
STATS = ("chars", "words", "word_length", "upper", "digits", "symbols", "inner_symbols", "symbol_words", "bars", "capital_words", "short_words", "repeats", "top_word", "lines", "line_repeats", "line_length", "sentence_ends")
D = len(STATS)
ENDS_ODD = re.compile(r"[^\w\s.,;:?'\")\]]{2,}(?=\s|$)|(?:^|\s)[^\w\s]+(?=\s|$)")
SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-]")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of ``STATS``."""
    text = text or ""
    n = len(text)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    w = len(words)
    seen, seen_lines = Counter(words), Counter(lines)
    letters = sum(map(len, words)) or 1
    upper = sum(map(str.isupper, text))
    share = lambda part, whole: float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))
    symbols = len(SYMBOL.findall(text))
    return [
        float(np.log1p(n)),
        float(np.log1p(w)),
        float(np.log1p(letters / max(w, 1))),
        share(upper, letters),
        share(sum(map(text.count, "0123456789")), letters),
        share(symbols, letters),
        share(text.count("!") + text.count("?"), letters),
        share(len(ENDS_ODD.findall(text)), w),
        share(text.count("|"), w),
        share(sum(1 for x in words if x[:1].isupper()), w),
        share(sum(1 for x in words if len(x) <= 3), w),
        share(w - len(seen), w),
        share(max(seen.values(), default=0), w),
        float(np.log1p(len(lines))),
        share(sum(len(k) * (v - 1) for k, v in seen_lines.items()), n),
        float(np.log1p(n / max(len(lines), 1))),
        share(text.count(".") + text.count("!") + text.count("?"), w),
    ]


@dataclass
class Model:
    """Class shares, means, inverse Cholesky factors and log determinants."""

    share: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    logdets: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        if self.means is None:
            return np.full(len(x), self.share)
        density = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.factors[c].T
            density.append(-0.5 * (z * z).sum(1) - 0.5 * self.logdets[c])
        odds = density[1] - density[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = SHRINK_POOLED, diagonal: float = SHRINK_DIAGONAL) -> Model:
    """From each class's count, sum and sum of products."""
    n = {c: sums[c][0] if c in sums else 0 for c in (0, 1)}
    total = n[0] + n[1]
    if not n[0] or not n[1]:
        return Model(n[1] / total if total else 0.5)
    means = np.array([sums[c][1] / n[c] for c in (0, 1)])
    cov = np.array([sums[c][2] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)])
    both = (n[0] * cov[0] + n[1] * cov[1]) / total
    factors, logdets = [], []
    for c in (0, 1):
        own = (1 - pooled) * cov[c] + pooled * both
        own = (1 - diagonal) * own + diagonal * np.diag(np.diag(own)) + 1e-3 * np.eye(len(own))
        low = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(low))
        logdets.append(2 * np.log(np.diag(low)).sum())
    return Model(n[1] / total, means, np.array(factors), np.array(logdets))


def with_statistics(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out array<double>``, the statistics of each whole text."""
    small_batches(df.sparkSession)

    @F.pandas_udf("array<double>")
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in texts:
            yield pd.Series([statistics(t) for t in x], dtype=object)

    return df.withColumn(out, udf(text))


def train(rows: DataFrame, stats: str = "stats", label: str = "quality") -> Model:
    """Fit on ``rows`` (statistics and a 0/1 label): one small row of sums comes from each task."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for pdf in batches:
            for c in (0, 1):
                mine = pdf[stats][pdf[label] == c]
                if len(mine):
                    x = np.stack(mine.to_numpy())
                    s = sums.setdefault(c, [0.0, np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)])
                    s[0], s[1], s[2] = s[0] + len(x), s[1] + x.sum(0), s[2] + x.T @ x
        if sums:
            yield pd.DataFrame({"c": list(sums), "n": [s[0] for s in sums.values()], "v": [np.concatenate([s[1], s[2].ravel()]) for s in sums.values()]})

    each = rows.where(F.col(label).isin(0, 1)).select(stats, label).mapInPandas(add, "c long, n double, v array<double>")
    added = each.select("c", "n", F.posexplode("v")).groupBy("c", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("v"))
    # two classes by D + D * D sums
    got = added.collect()
    sums = {}
    for c in {r["c"] for r in got}:
        mine = sorted((r["pos"], r["n"], r["v"]) for r in got if r["c"] == c)
        v, d = np.array([x[2] for x in mine]), D
        sums[c] = (mine[0][1], v[:d], v[d:].reshape(d, d))
    return fit(sums)


def fold(key: str = "doc_id", folds: int = FOLDS) -> F.Column:
    """``crc32`` of the id as text modulo ``folds``; a null id has 0 and is never trained on."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(0))


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, store: bool = True) -> DataFrame:
    """Add ``held_out, score, predicted`` to the documents.

    With ``store``, statistics are written once to the shared folder with the
    id, for training and scoring without reading texts twice (the result then
    has the id alone); without, they are computed again and all columns pass.
    """
    joined = key
    df, now_named = aside(df, "held_out", "score", "predicted")
    key, text = now_named(key), now_named(text)
    base = df.select(key, text) if store else df
    (stats,) = fresh(base, "stats")
    wanted = labels.select(F.col(joined).alias("label_of"), F.col(label).alias("label")).where(F.col("label_of").isNotNull() & (fold("label_of") != 0))
    rows = with_statistics(base, text, stats)
    if store:
        rows = stored(rows.select(key, stats), "statistics")
        training = rows.join(wanted, F.col(key) == F.col("label_of"))
    else:
        training = with_statistics(base.select(key, text).join(wanted, F.col(key) == F.col("label_of")), text, stats)
    model = train(training, stats, "label")

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy()) if len(x) else np.zeros((0, D))), dtype=float)

    out = rows.withColumn("held_out", fold(key) == 0).withColumn("score", score(F.col(stats)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(stats)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    rows, at = shielded(docs)
    labels = load(spark, sf_dir, "labels").withColumnRenamed("doc_id", at["doc_id"])
    return unshielded(classify(rows, labels, at["doc_id"], at["text"], store=False).where("predicted = 1"), at)
