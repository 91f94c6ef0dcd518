"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct character 3-, 4- and 5-grams of its
whole text (A-Z lower-cased, a blank before the first character), hashed to
``2**BITS`` cells. Cell f is scaled by

    r_f = log((df1_f / n1 + a) / (df0_f / n0 + a)),   a = SMOOTH / (n0 + n1)

(df: training documents of the label that hold the cell), and a logistic
regression with L2 penalty learns one weight per scaled cell. Weight times
ratio is the model: 2**BITS floats, a fixed size, whatever the corpus.

Training reads labelled rows only and at most about ``SAMPLE`` of them,
chosen by a hash of the id (the bound is on the fit alone). Scoring reads
every text in full, in blocks of ``BLOCK`` characters, so that memory does
not depend on the length of a text.

Defined cases: null or empty text has the features of a single blank and
gets a score near the base rate; a null doc_id is never held out and has no
label; of several label rows for an id, toxic wins; a null label is no
label; without labelled rows (or with one class only) the score is the
share of label 1, 0 if there is none. Repeated rows score alike; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipway.llm.common import LOWER, crc_mod, prepare, table, utf8_arrays

ORDERS = (3, 4, 5)
BITS = 18
SAMPLE = 6000
SMOOTH = 5.0
BLOCK = 1 << 20
THRESHOLD = 0.3


class Grams:
    """Distinct hashed n-grams of texts; holds the scratch table."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.mark = np.full(1 << bits, -1, np.int64)
        self.stamp = 0

    def _cells(self, x: np.ndarray, n: int) -> np.ndarray:
        h = x[:len(x) - n + 1] * np.uint32(2654435761)
        for j in range(1, n):
            h = (h + x[j:len(x) - n + 1 + j]) * np.uint32(2246822519)
            h ^= h >> np.uint32(15)
        return (h * np.uint32(3266489917 + 2 * n)) >> np.uint32(32 - self.bits)

    def _new(self, cells: np.ndarray, floor: int) -> np.ndarray:
        """Distinct cells not yet stamped at or above ``floor``."""
        cells = cells[self.mark[cells] < floor]
        at = np.arange(self.stamp, self.stamp + len(cells))
        self.stamp += len(cells) + 1
        self.mark[cells] = at
        return cells[self.mark[cells] == at]

    def of(self, chars: np.ndarray) -> np.ndarray:
        """Distinct cells of one text, given its code points."""
        floor, parts = self.stamp, []
        for at in range(0, max(len(chars), 1), BLOCK):
            x = chars[at:at + BLOCK + max(ORDERS) - 1].astype(np.uint32)
            x = np.concatenate([np.array([32], np.uint32), x]) if at == 0 else x
            cells = [self._cells(x, n) for n in ORDERS if len(x) >= n]
            if cells:
                parts.append(self._new(np.concatenate(cells), floor))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def code_points(col) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string column with A-Z folded, and row offsets."""
    data, offs = utf8_arrays(col)
    low = LOWER[data]
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return np.frombuffer(low.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), lead[offs]


def _rows(col: pa.Array, grams: Grams) -> Iterator[np.ndarray]:
    chars, offs = code_points(col)
    for a, b in zip(offs[:-1], offs[1:]):
        yield grams.of(chars[a:b])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int,
                  sample: int) -> DataFrame:
    """(text, y) of a sample of labelled documents outside the held-out remainder.

    The ids are chosen by hash so that about ``sample`` rows are kept; their
    number bounds the broadcast.
    """
    lab = (labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
           .filter("_id is not null and _y is not null").filter(crc_mod(F.col("_id"), modulus) != held)
           .groupBy("_id").agg(F.max("_y").alias("_y")))
    n = lab.count()
    if n > sample:
        cut = int(sample / n * (1 << 30))
        lab = lab.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < cut)
    return docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(
        F.broadcast(lab), "_id").select("_text", "_y")


def fit_weights(cells: np.ndarray, ptr: np.ndarray, y: np.ndarray, bits: int = BITS, steps: int = 1200,
                l2: float = 1e-4, rate: float = 0.05, seed: int = 7) -> tuple[np.ndarray, float]:
    """Scaled weights and bias from documents in compressed-row form."""
    size, n = 1 << bits, len(y)
    n1 = int(y.sum())
    n0 = n - n1
    if not n0 or not n1:
        p = min(max(n1 / n if n else 0.0, 0.0), 1.0)
        return np.zeros(size, np.float32), -50.0 if p == 0 else 50.0
    pos = np.repeat(y == 1, np.diff(ptr))
    df1 = np.bincount(cells[pos], minlength=size)
    df0 = np.bincount(cells[~pos], minlength=size)
    a = SMOOTH / n
    r = np.log((df1 / n1 + a) / (df0 / n0 + a))
    w, b = np.zeros(size), float(np.log(n1 / n0))
    gw, gb = np.full(size, 1e-2), 1e-2
    rng = np.random.default_rng(seed)
    for _ in range(max(1, -(-steps * 64 // n))):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            rows = order[at:at + 64]
            idx = np.concatenate([cells[ptr[i]:ptr[i + 1]] for i in rows])
            own = np.repeat(np.arange(len(rows)), ptr[rows + 1] - ptr[rows])
            z = b + np.bincount(own, w[idx] * r[idx], len(rows))
            err = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[rows]
            g = np.bincount(idx, err[own], size) * r / len(rows) + l2 * w
            gw += g * g
            w -= rate * g / np.sqrt(gw)
            e = err.mean()
            gb += e * e
            b -= rate * e / np.sqrt(gb)
    return (w * r).astype(np.float32), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held: int = 2,
        sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Train on the sample: features in parallel, the fit in one task of bounded size."""
    rows = training_rows(docs, labels, label, modulus, held, sample)

    def features(batches):
        grams = Grams()
        for b in batches:
            got = [np.sort(c).astype(np.int32) for c in _rows(b.column(0), grams)]
            yield pa.RecordBatch.from_arrays(
                [b.column(1).cast(pa.int32()), pa.array([c.tobytes() for c in got], pa.binary())], ["y", "cells"])

    def learn(frames):
        pdf = pd.concat([*frames, pd.DataFrame({"y": [], "cells": []})])
        pdf = pdf.sort_values(["y", "cells"], kind="stable")  # the order of arrival does not matter
        each = [np.frombuffer(c, np.int32) for c in pdf["cells"]]
        ptr = np.concatenate([[0], np.cumsum([len(c) for c in each])]).astype(np.int64)
        cells = np.concatenate(each) if each else np.zeros(0, np.int32)
        w, b = fit_weights(cells, ptr, pdf["y"].to_numpy(np.int64))
        yield pd.DataFrame({"w": [w.tobytes()], "b": [b]})

    feats = rows.mapInArrow(features, T.StructType([T.StructField("y", T.IntegerType()),
                                                    T.StructField("cells", T.BinaryType())]))
    got = feats.repartition(1).mapInPandas(learn, "w binary, b double").collect()
    if not got:
        return np.zeros(1 << BITS, np.float32), -50.0
    return np.frombuffer(got[0]["w"], np.float32), got[0]["b"]


def scorer(model: tuple[np.ndarray, float]):
    """Column function: text -> probability of label 1."""
    weights, bias = model

    @F.pandas_udf(T.DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams = Grams()
        for s in texts:
            z = np.array([bias + weights[c].sum(dtype=np.float64)
                          for c in _rows(pa.array(s, pa.string(), from_pandas=True), grams)])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    return score


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows of ``docs`` as (doc_id, held_out, score, predicted)."""
    prepare(docs.sparkSession)
    score = scorer(fit(docs, labels))
    out = docs.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
                      score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all their columns kept."""
    prepare(docs.sparkSession)
    score = scorer(fit(docs, labels))
    return docs.filter(score(F.col("text")) < THRESHOLD)
