"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Indicators (present or not, hashed to ``2**bits`` columns) of a document are its word unigrams and
bigrams, unigrams and bigrams of word *shapes* (which kinds of characters a word holds), and the rate
steps of each shape, of repeated neighbours and of distinct words. Each column is scaled by the
log-count ratio of the two classes, a linear hinge-loss model is fitted by dual coordinate descent, and
a logistic curve fitted on rows that the first fit didn't see turns its margin into a score.

Defined results: a null or empty text has only the bias and the "no words" indicator; a very long text is
read whole; rows with a null doc_id or null label don't train; a doc_id with contradicting labels doesn't
train; repeated rows are scored alike, and train once; a score of 0.5 counts as label 1; without any training
row, or with one class only, every score is that class's smoothed share; an empty table gives an empty result;
extra columns of the input, of any name but the new one's, are left alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracelode.llm import textnum
from tracelode.llm.common import crc32_mod, driver_gives_back, table

#: Kinds of bytes that make a word's shape, one bit each.
KINDS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:", "!", "?", "*", "$%&#", "|", "-_/\\", "\"'()[]{}<>", "@=+~^`"]


def _kind_bits() -> np.ndarray:
    bits = np.zeros(256, np.uint32)
    for k, chars in enumerate(KINDS):
        bits[[ord(c) for c in chars]] = 1 << k
    bits[128:] = 1 << len(KINDS)
    return bits


KIND_BITS = _kind_bits()
#: Steps of a rate: an indicator for each that is reached.
STEPS = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])


def indicators(column: pa.ChunkedArray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of documents in order: (columns of all their indicators, first of each document)."""
    data, offs = textnum.buffers(column)
    shift = np.uint64(64 - bits)
    for i, j in textnum.chunks(offs):
        own, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        n = j - i
        s, e, bounds = textnum.spans(own, at)
        c = textnum.prefix_hash(own)
        h = textnum.mix((c[e] - c[s]) * textnum.powers(len(own) + 1)[1][s])
        doc = np.repeat(np.arange(n), np.diff(bounds))
        if len(s):
            cuts = np.empty(2 * len(s), np.int64)
            cuts[0::2], cuts[1::2] = s, e
            kinds = np.append(KIND_BITS[own], np.uint32(0))
            shape = np.bitwise_or.reduceat(kinds, cuts)[0::2]
            shape |= (KIND_BITS[own[s]] == 1).astype(np.uint32) << 14
            shape |= np.minimum(np.log2(e - s).astype(np.uint32), 5) << 15
        else:
            shape = np.zeros(0, np.uint32)
        total = np.maximum(np.diff(bounds), 1)
        parts = [(h, doc, 1)]
        pair = doc[1:] == doc[:-1]
        parts.append((h[:-1][pair] * np.uint64(3) + h[1:][pair], doc[1:][pair], 2))
        wide = shape.astype(np.uint64)
        parts.append((wide, doc, 3))
        parts.append((wide[:-1][pair] * np.uint64(1 << 20) + wide[1:][pair], doc[1:][pair], 4))

        def rates(value: np.ndarray, of: np.ndarray, salt: int) -> None:
            key = (of.astype(np.uint64) << np.uint64(32)) | value
            uniq, count = np.unique(key, return_counts=True)
            own_doc = (uniq >> np.uint64(32)).astype(np.int64)
            reached = np.searchsorted(STEPS, count / total[own_doc], "right")  # noqa: B023
            k = np.repeat(np.arange(len(uniq)), reached)
            step = np.arange(len(k)) - np.repeat(np.cumsum(reached) - reached, reached)
            parts.append(((uniq[k] & np.uint64(0xFFFFFFFF)) * np.uint64(16) + step.astype(np.uint64), own_doc[k], salt))  # noqa: B023

        rates(wide & np.uint64(0x7FFF), doc, 5)
        for k in range(len(KINDS) + 1):
            has = (shape >> k) & 1 == 1
            rates(np.full(int(has.sum()), k, np.uint64), doc[has], 6)
        same = h[1:][pair] == h[:-1][pair]
        rates(np.zeros(int(same.sum()), np.uint64), doc[1:][pair][same], 7)
        seen = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
        new = seen[np.append(True, seen[1:] != seen[:-1])] if len(seen) else seen
        rates(np.zeros(len(new), np.uint64), (new >> np.uint64(44)).astype(np.int64), 8)
        size = np.log2(np.diff(bounds) + 1).astype(np.uint64)
        parts.append((size, np.arange(n), 9))

        key = np.concatenate([(d.astype(np.uint64) << np.uint64(bits)) | (textnum.mix(v + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> shift) for v, d, salt in parts])
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        yield (key & np.uint64((1 << bits) - 1)).astype(np.int32), np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(bits))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, width: int, smooth: float = 1.0) -> np.ndarray:
    """log of the class's smoothed shares of each indicator, label 1 over label 0."""
    counts = []
    for label in (1, 0):
        own = [r for r, v in zip(rows, y, strict=True) if v == label]
        c = smooth + np.bincount(np.concatenate(own), minlength=width) if own else np.full(width, smooth)
        counts.append(c / c.sum())
    return np.log(counts[0] / counts[1])


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 0.1, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model on the scaled indicators."""
    w, bias = np.zeros(len(ratio)), 0.0
    values = []
    for r in rows:  # rows of unit length, so that long texts don't dominate
        x = ratio[r]
        values.append(x / max(np.sqrt(x @ x), 1e-9))
    sign = np.where(y == 1, 1.0, -1.0)
    share = {1: (y == 1).mean(), 0: (y == 0).mean()}
    upper = np.where(y == 1, cost * 0.5 / max(share[1], 1e-9), cost * 0.5 / max(share[0], 1e-9)) * 100
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, x = rows[i], values[i]
            gradient = sign[i] * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), upper[i])
            if d := new - alpha[i]:
                w[r] += d * sign[i] * x
                bias += d * sign[i]
                alpha[i], moved = new, moved + abs(d)
        if moved < 1e-3 * len(rows):
            break
    return w * ratio, bias


def margins(rows: list[np.ndarray], ratio: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    square = ratio * ratio
    return np.array([w[r].sum() / max(np.sqrt(square[r].sum()), 1e-9) + bias for r in rows])


def logistic_curve(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and offset by Newton steps on smoothed labels."""
    t = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    a, b = 2.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * (a - 2), (p - t).sum()])
        v = p * (1 - p) + 1e-9
        hess = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return max(float(a), 0.05), float(b)


@dataclass
class Model:
    bits: int
    ratio: np.ndarray
    w: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, column: pa.ChunkedArray) -> np.ndarray:
        square, out = self.ratio * self.ratio, []
        for cols, first in indicators(column, self.bits):
            sums = [np.concatenate(([0.0], np.cumsum(v[cols])))[first] for v in (self.w, square)]
            m = np.diff(sums[0]) / np.sqrt(np.maximum(np.diff(sums[1]), 1e-18)) + self.bias
            out.append(1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def fit(rows: list[np.ndarray], y: np.ndarray, bits: int) -> Model:
    """A model from the indicators of each row; every fifth row only fits the logistic curve first."""
    width = 1 << bits
    if not len(y) or y.min() == y.max():
        p = ((y == 1).sum() + 1) / (len(y) + 2)
        return Model(bits, np.zeros(width), np.zeros(width), 0.0, 1.0, float(np.log(p / (1 - p))))
    held = np.arange(len(y)) % 5 == 4
    slope, offset = 2.0, 0.0
    if min((y[~held] == 1).sum(), (y[~held] == 0).sum(), (y[held] == 1).sum(), (y[held] == 0).sum()) > 0:
        part = [r for r, h in zip(rows, held, strict=True) if not h]
        ratio = log_count_ratio(part, y[~held], width)
        w, bias = dual_coordinate_descent(part, y[~held], ratio)
        slope, offset = logistic_curve(margins([r for r, h in zip(rows, held, strict=True) if h], ratio, w, bias), y[held])
    ratio = log_count_ratio(rows, y, width)
    w, bias = dual_coordinate_descent(rows, y, ratio)
    return Model(bits, ratio, w, bias, slope, offset)


def train(docs: DataFrame, labels: DataFrame, bits: int = 18, max_rows: int = 6000) -> Model:
    """Fits on at most ``max_rows`` labelled documents, those whose hashed id is least.

    That bound is what keeps the fit in the driver's memory: 6,000 rows of indicators are about 20 MB.
    ``labels``: (doc_id, label). Rows that must not train are left out by the caller. Ids are chosen among those
    that have a document; of a doc_id's rows the least text trains, so a row an id reaches the driver.
    """
    clean = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("lo"), F.max("label").alias("label")).where("lo = label").select("doc_id", F.col("label").cast("int").alias("label"))
    chosen = docs.select("doc_id").join(clean, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cols[first[k] : first[k + 1]].tobytes() for cols, first in indicators(batch.column("text"), bits) for k in range(len(first) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "cols"])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows bounds what is broadcast
    once = joined.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = once.select("doc_id", "label", "text").mapInArrow(textnum.released(featured), "doc_id long, label int, cols binary").toPandas()
    got = got.sort_values("doc_id", kind="stable") if len(got) else got
    got = got.iloc[np.random.default_rng(11).permutation(len(got))]
    model = fit([np.frombuffer(c, np.int32) for c in got["cols"]], got["label"].to_numpy(np.int64), bits)
    del got
    driver_gives_back(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with the score in a new column ``out``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits columns: its size doesn't depend on the input
    names = [*docs.columns, out]
    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.scores(batch.column("text")), pa.float64())], names)

    return docs.mapInArrow(textnum.released(scored), schema)


def labelled_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The production model: labels of ids whose crc32 modulo 3 is not 1."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return train(docs, labels.where(crc32_mod(F.col("doc_id"), 3) != 1))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, labelled_model(spark, docs, sf_dir))
    return out.select("doc_id", (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns they came with, whatever their names.

    Null and empty texts are scored as any other and go or stay by their score; each of repeated rows stays or
    goes as the other does; rows with a null doc_id stay if their text is accepted; an empty table stays empty.
    """
    names, own = docs.columns, f"score_{uuid.uuid4().hex}"
    kept = score(docs, labelled_model(spark, table(spark, sf_dir, "documents"), sf_dir), own)
    return kept.where(F.col(own) >= 0.5).select(*names)
