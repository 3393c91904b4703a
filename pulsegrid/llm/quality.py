"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics (sizes, shares of kinds of
characters, repetition of words and lines).  Each class gets a mean and a
shrunken covariance,

    S_c = (1 - ridge) * ((1 - pooling) * C_c + pooling * C) + ridge * I,

over standardised statistics, and its Cholesky factor is computed once and
carried in the model.  The score of a text is the logistic of the difference of
the two log densities, from Mahalanobis distances, plus the log prior odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.storage import saved
from pulsegrid.llm.words import hash_spans, word_slices

STATISTICS = (
    "log_words", "mean_word", "spread_word", "log_lines", "line_words", "distinct_words", "top_word", "distinct_lines", "top_line",
    "upper", "digit", "stop", "symbol", "wide", "short_words", "long_words", "entropy", "same_neighbour", "odd_words", "runs",
)
POOLING, RIDGE = 0.1, 0.1
THRESHOLD = 0.7
#: Labelled rows are all used; the moments that fitting needs are one row a class.
LIMIT = 12.0


def _mask(chars: bytes) -> np.ndarray:
    mask = np.zeros(256)
    mask[list(chars)] = 1
    return mask


_UPPER = _mask(bytes(range(65, 91)))
_DIGIT = _mask(bytes(range(48, 58)))
_STOP = _mask(b".,;:!?")
_WIDE = np.concatenate((np.zeros(128), np.ones(128)))
_SPACE = _mask(b" \t\n\r\x0b\x0c")
_LOWER = _mask(bytes(range(97, 123)))
_SYMBOL = 1 - np.clip(_UPPER + _LOWER + _DIGIT + _STOP + _WIDE + _SPACE, 0, 1)
_LETTER = ((_UPPER + _LOWER + _WIDE) > 0).astype(np.uint8)


def _shares(key: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, largest count) of each document; docs ascends."""
    order = np.sort((docs.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24)))
    if not len(order):
        return np.zeros(n), np.zeros(n)
    at = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
    count = np.diff(np.concatenate((at, [len(order)])))
    doc = (order[at] >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(doc, minlength=n).astype(float)
    top = np.zeros(n)
    np.maximum.at(top, doc, count)
    return distinct, top


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text; a null or empty text is all zeros."""
    parts = []
    for w in word_slices(column):
        n, docs = len(w.bounds) - 1, w.docs
        words = np.diff(w.bounds).astype(float)
        some = np.maximum(words, 1)
        size = np.diff(w.offsets).astype(float)
        byte_doc = np.repeat(np.arange(n), np.diff(w.offsets))
        hist = np.bincount(byte_doc * 256 + w.data, minlength=n * 256).reshape(n, 256).astype(float)
        length = (w.ends - w.starts).astype(float)
        mean = np.bincount(docs, length, n) / some
        spread = np.sqrt(np.maximum(np.bincount(docs, length**2, n) / some - mean**2, 0))
        distinct, top = _shares(w.hashes, docs, n)
        # lines: spans between line feeds, empty ones left out
        brk = w.data == 10
        edge = np.zeros(len(w.data) + 1, dtype=bool)
        edge[w.offsets] = True
        inside = ~brk
        before, after = np.concatenate(([False], inside)), np.concatenate((inside, [False]))
        starts = np.flatnonzero(after & (~before | edge))
        ends = np.flatnonzero(before & (~after | edge))
        line_doc = byte_doc[starts] if len(starts) else starts
        lines = np.bincount(line_doc, minlength=n).astype(float)
        line_distinct, line_top = _shares(hash_spans(w.data, starts, ends), line_doc, n)
        chars = np.maximum(size - hist @ _SPACE, 1)
        p = hist / np.maximum(size, 1)[:, None]
        entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
        same = np.zeros(len(w.hashes), dtype=bool)
        if len(same):
            same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (docs[1:] == docs[:-1])
        first, last = _LETTER[w.data[w.starts]], w.data[np.maximum(w.ends - 1, 0)] if len(w.ends) else np.zeros(0, np.uint8)
        odd = (first == 0) | ((_LETTER[last] == 0) & (_STOP[last] == 0))
        run = np.zeros(len(w.data), dtype=bool)
        if len(run) > 1:
            run[1:] = (w.data[1:] == w.data[:-1]) & (byte_doc[1:] == byte_doc[:-1])
        share = lambda mask: np.sqrt(hist @ mask / chars)
        part = lambda flags: np.sqrt(np.bincount(docs, flags, n) / some)
        parts.append(
            np.column_stack(
                (
                    np.log1p(words), np.log1p(mean), np.log1p(spread), np.log1p(lines), np.log1p(words / np.maximum(lines, 1)),
                    np.sqrt(distinct / some), np.sqrt(top / some), np.sqrt(line_distinct / np.maximum(lines, 1)), np.sqrt(line_top / np.maximum(lines, 1)),
                    share(_UPPER), share(_DIGIT), share(_STOP), share(_SYMBOL), share(_WIDE), part(length <= 3), part(length >= 16),
                    entropy, part(same), part(odd), np.sqrt(np.bincount(byte_doc, run, n) / chars),
                )
            )
        )
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


@dataclass
class Discriminant:
    """Fitted classes; ``factors`` holds the inverses of the Cholesky factors."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row."""
        z = np.clip((x - self.centre) / self.scale, -LIMIT, LIMIT)
        density = [k - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, k in zip(self.means, self.factors, self.constants, strict=True)]
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit_moments(count: np.ndarray, total: np.ndarray, square: np.ndarray, pooling: float = POOLING, ridge: float = RIDGE) -> Discriminant:
    """From the count, sum and sum of outer products of each of the classes 0 and 1.

    A class without rows takes the pooled moments and a prior of one row, so
    scores stay defined.
    """
    d = total.shape[1]
    n = max(count.sum(), 1.0)
    centre = total.sum(0) / n
    cov = square.sum(0) / n - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-6))
    cov = cov / np.outer(scale, scale)
    means, factors, constants = [], [], []
    for c in (0, 1):
        if count[c] > 0:
            mean = total[c] / count[c]
            own = (square[c] / count[c] - np.outer(mean, mean)) / np.outer(scale, scale)
            mean = (mean - centre) / scale
        else:
            mean, own = np.zeros(d), cov
        shrunk = (1 - ridge) * ((1 - pooling) * own + pooling * cov) + ridge * np.eye(d)
        factor = np.linalg.cholesky((shrunk + shrunk.T) / 2)
        means.append(mean)
        factors.append(np.linalg.inv(factor))
        constants.append(np.log(max(count[c], 1.0) / n) - np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, np.array(means), np.array(factors), np.array(constants))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x) with one row for each row of ``docs``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(2))
            flat = pa.array(x.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["doc_id", "held_out", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(compute, f"doc_id {kind}, held_out boolean, x array<double>")


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Learns from the labelled rows that are not held out.

    Partial sums are made in each task and added by Spark; the driver gets one
    number for each entry of the moments, whatever the size of the input.
    """
    y = F.col("quality").cast("int")
    train = stats.where(~F.col("held_out")).join(labels.where(y.isin(0, 1)).select("doc_id", y.alias("y")), "doc_id").select("x", "y")
    d = len(STATISTICS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for b in batches:
            if b.num_rows == 0:
                continue
            x = b.column(0).flatten().to_numpy().reshape(-1, d)
            y = b.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                sums[c] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).reshape(-1)))
        at = np.arange(sums.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.reshape(-1))], ["at", "part"])

    rows = train.mapInArrow(partial, "at int, part double").groupBy("at").agg(F.sum("part").alias("whole")).collect()
    sums = np.zeros(2 * (1 + d + d * d))
    for r in rows:
        sums[r["at"]] = r["whole"]
    sums = sums.reshape(2, -1)
    return fit_moments(sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    * a null text is scored as an empty one, an empty one like any other;
    * a null doc_id is never held out and never labelled;
    * labels other than 0 and 1 are not used, repeated rows count as often as they stand;
    * without labels every score is 0.5.
    """
    stats = saved(document_statistics(docs), "quality-statistics")
    model = fit(stats, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy().reshape(-1, len(STATISTICS))
            s = model.scores(x)
            made = [b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted to be of quality 1, columns unchanged."""
    model = fit(saved(document_statistics(docs), "quality-statistics"), labels)
    at = docs.columns.index("text")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(statistics(b.column(at))) >= THRESHOLD))

    return docs.mapInArrow(select, docs.schema)
