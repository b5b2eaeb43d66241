"""Quality classifier: regularised quadratic discriminant analysis.

A text becomes DIM transformed statistics (logs of counts, smoothed log-odds of shares). Each class is a normal
distribution; its covariance is shrunk towards the pooled one and towards its own diagonal, and its Cholesky factor
is computed once. A text's score is the difference of the two log-densities (Mahalanobis distances from triangular
solves, and log-determinants), put through a logistic curve fitted on the training rows. Fitting needs sums and
products of the statistics by class and a histogram of the differences, both aggregated where the rows are; every
labelled training row counts.

Training labels come only from rows whose crc32 of the id as text leaves a remainder modulo FOLDS. Null and empty
texts have statistics like any text (no words); label rows that repeat count again, null labels and labels without
a text do not count; rows with equal ids stay rows; extra columns are ignored; an empty table gives an empty
result. A text of any length is one unit, held by one task; ties don't matter, as each row is scored by itself. Without
training rows of both classes every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

FOLDS = 5
THRESHOLD = 0.3
SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.05
BINS, SPAN = 2000, 12.0
STATS = (
    "words", "word_length", "word_length_spread", "upper", "digits", "symbols", "exclaims", "bars", "points", "distinct", "same_as_last",
    "repeated_windows", "wordless", "line_words", "line_repeats", "long_words", "not_ascii", "most_common",
)
DIM = len(STATS)
_UPPER = c.byte_class(lambda b: 65 <= b <= 90)
_ALPHA = c.byte_class(lambda b: 65 <= b <= 90 or 97 <= b <= 122)
_DIGIT = c.byte_class(lambda b: 48 <= b <= 57)
_SYMBOL = c.byte_class(lambda b: chr(b) in "#*$%&<>@^~=+\\{}[]_/")
_POINT = c.byte_class(lambda b: chr(b) in ".,;:?")
_LETTER = c.byte_class(lambda b: b >= 0x80 or chr(b).isalpha())


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of STATS for each text."""
    n = len(off) - 1
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off]).astype(float)
    odds = lambda part, whole: np.log((part + 0.5) / (whole - part + 0.5))
    solid = c.SOLID[data]
    ws, we = c.runs(solid, off)
    row = np.searchsorted(off, ws, "right") - 1
    words = np.bincount(row, minlength=n).astype(float)
    sums = lambda x: np.bincount(row, x, n)
    length = (we - ws).astype(float)
    chars = sums(length)
    mean = chars / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(sums(length**2) / np.maximum(words, 1) - mean**2, 0))
    h = c.span_hashes(c.LOWER[data], ws, we)
    own = c.in_row(h, row)
    order = np.argsort(own, kind="stable")
    s = own[order]
    first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    distinct = np.bincount(row[order[first]], minlength=n).astype(float)
    counts = np.diff(np.append(np.flatnonzero(first), len(s)))
    most = np.zeros(n)
    np.maximum.at(most, row[order[first]], counts)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    sh, at = c.shingles(h, row, 3)
    covered = np.zeros(len(h), bool)
    twice = at[c.repeated(c.in_row(sh, row[at]))]
    for j in range(3):
        covered[twice + j] = True
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    wordless = (letters[we] == letters[ws]).astype(float)
    ls, le, lrow = c.line_spans(data, off)
    full = np.concatenate([[0], np.cumsum(solid)])
    has = full[le] > full[ls]
    ls, le, lrow = ls[has], le[has], lrow[has]
    lines = np.bincount(lrow, minlength=n).astype(float)
    again = np.bincount(lrow[c.later(c.in_row(c.digests(data, ls, le)[:, 0], lrow))], minlength=n).astype(float)
    upper, alpha = total(_UPPER[data]), total(_ALPHA[data])
    columns = (
        np.log1p(words), np.log1p(mean), np.log1p(spread), odds(upper, alpha), odds(total(_DIGIT[data]), chars), odds(total(_SYMBOL[data]), chars),
        odds(total(data == 33), chars), odds(total(data == 124), chars), odds(total(_POINT[data]), chars), odds(distinct, words), odds(sums(same), words),
        odds(sums(covered.astype(float)), words), odds(sums(wordless), words), np.log1p(words / np.maximum(lines, 1)), odds(again, lines),
        odds(sums((length > 20).astype(float)), words), odds(total(data >= 0x80), chars), odds(most, words),
    )
    return np.stack(columns, 1)


def substituted(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of factor y = b for a lower triangular factor, a column for each of b, by forward substitution."""
    y = np.empty_like(b)
    for i in range(len(b)):
        y[i] = (b[i] - factor[i, :i] @ y[:i]) / factor[i, i]
    return y


class Model:
    """Two normal distributions with cached Cholesky factors, and the logistic curve over their log-density difference."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, products: np.ndarray):
        self.prior = np.log(n[1] / n[0])
        mean = sums / n[:, None]
        cov = products / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        pooled = (n[:, None, None] * cov).sum(0) / n.sum()
        self.parts = []
        for k in (0, 1):
            a = (1 - SHRINK_POOLED) * cov[k] + SHRINK_POOLED * pooled
            a = (1 - SHRINK_DIAGONAL) * a + SHRINK_DIAGONAL * np.diag(np.diag(a)) + 1e-3 * np.eye(len(a))
            factor = np.linalg.cholesky(a)
            self.parts.append((mean[k], factor, 2 * np.log(np.diag(factor)).sum()))
        self.curve = (0.0, 1.0)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log-density of class 1 less that of class 0, compressed (asinh), for each row of x."""
        d = [(substituted(factor, (x - m).T) ** 2).sum(0) for m, factor, _ in self.parts]
        raw = 0.5 * (d[0] - d[1] + self.parts[0][2] - self.parts[1][2]) + self.prior
        return np.arcsinh(raw)

    def fit_curve(self, value: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
        """Newton steps of a logistic regression on binned differences, with one pseudo-row of either class."""
        a, b = 0.0, 1.0
        value, ones, zeros = np.append(value, [0.0]), np.append(ones, 1.0), np.append(zeros, 1.0)
        x = np.stack([np.ones_like(value), value], 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a + b * value)))
            w = (ones + zeros) * p * (1 - p)
            step = np.linalg.solve((x.T * w) @ x + 1e-6 * np.eye(2), x.T @ (ones - (ones + zeros) * p))
            a, b = a + step[0], b + step[1]
            if abs(step).max() < 1e-9:
                break
        self.curve = (a, max(b, 1e-3))

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * self.difference(x), -500, 500)))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)


def fit(train: DataFrame) -> Model | None:
    """From rows (stats, label): everything that leaves the executors has a size that only DIM and BINS set."""

    def moments(batches):
        sums = np.zeros((2, 1 + DIM + DIM * DIM))
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy()
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], sums.shape[1]).astype(np.int32)), pa.array(np.tile(np.arange(sums.shape[1]), 2).astype(np.int32)), pa.array(sums.ravel())], names=["k", "i", "v"])

    got = train.select("stats", "label").mapInArrow(moments, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((2, 1 + DIM + DIM * DIM))
    for k, i, v in got:
        sums[k, i] = v
    if (sums[:, 0] == 0).any():
        return None
    model = Model(sums[:, 0], sums[:, 1 : 1 + DIM], sums[:, 1 + DIM :].reshape(2, DIM, DIM))

    def bins(batches):
        counts = np.zeros((2, BINS), np.int64)
        for batch in batches:
            at = np.clip((model.difference(_matrix(batch.column(0))) + SPAN) / (2 * SPAN) * BINS, 0, BINS - 1).astype(int)
            np.add.at(counts, (batch.column(1).to_numpy(), at), 1)
        k, i = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(counts[k, i])], names=["k", "i", "n"])

    counts = np.zeros((2, BINS))
    for k, i, n in train.select("stats", "label").mapInArrow(bins, "k int, i int, n long").groupBy("k", "i").agg(F.sum("n")).collect():
        counts[k, i] = n
    model.fit_curve((np.arange(BINS) + 0.5) / BINS * 2 * SPAN - SPAN, counts[1], counts[0])
    return model


def _fold(x):
    return F.pmod(F.crc32(x.cast("string").cast("binary")), F.lit(FOLDS))


def _training(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    marked = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (_fold(F.col("doc_id")) != 0))
    return c.cut(stats.join(marked, "doc_id").select("stats", "label"), "train")


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, stats) of each document, written once."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(*c.flat(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, DIM), pa.int32()), pa.array(x.ravel()))], names=["doc_id", "stats"])

    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return c.cut(c.map_text(df, measure, "doc_id long, stats array<double>"), "stats")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    base = measured(docs, id_col, text_col)
    model = fit(_training(base, labels, id_col, label_col))

    def scores(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            s = model.score(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    out = base.mapInArrow(scores, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs, all columns, that the classifier predicts as good. Each row's own text decides, so ids need not be unique."""
    model = fit(_training(measured(docs, id_col, text_col), labels, id_col, label_col))
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def good(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.score(statistics(*c.flat(batch.column(at)))) >= THRESHOLD))

    return c.map_text(docs, good, docs.schema, text_col)
