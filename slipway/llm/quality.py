"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Words are runs of letters, of digits, or of other signs, case kept, hashed to
``2**BITS`` cells. Each cell has a fixed sparse index vector (``TERNARY``
entries of +1 or -1 among ``DIM``); its word vector is the sum of the index
vectors of the words up to two places away, over all documents. A document
is the mean and the spread of its words' vectors, each vector of unit length.
A network of one hidden layer (numpy) learns the label from at most about
``SAMPLE`` labelled rows (the bound is on this fit alone), a tenth of which is
held back to set the temperature of its probabilities.

The word vectors are 2**BITS x DIM numbers whatever the corpus; tasks add up
their own before the shuffle, which is by cell.

Defined cases: null or empty text has the zero vector and gets the score that
goes with it; a null doc_id is never held out and has no label; of several
label rows for an id the largest counts; without labelled rows, or with one
class only, the score is the share of label 1; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipway.llm.common import BYTE_VALUES, SPACE, crc_mod, mix64, prepare, span_hashes, table, utf8_arrays
from slipway.llm.toxicity import training_rows

BITS, DIM, TERNARY, REACH = 14, 48, 3, 2
SAMPLE = 6000
HIDDEN = 32
THRESHOLD = 0.5
BLOCK = 200_000  # words handled at a time

_KIND = np.full(256, 3, np.uint8)
_KIND[SPACE] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def word_cells(col) -> tuple[np.ndarray, np.ndarray]:
    """Cell of every word of a string column, in order, and row offsets."""
    data, offs = utf8_arrays(col)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind = _KIND[data]
    edge = np.append(True, kind[1:] != kind[:-1])
    edge[offs[offs < len(data)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    on = kind[starts] != 0
    starts, ends = starts[on], ends[on]
    cells = (span_hashes(data, starts, ends, BYTE_VALUES) >> np.uint64(64 - BITS)).astype(np.int64)
    return cells, np.searchsorted(starts, offs)


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each cell's index vector."""
    h = mix64(np.arange(1, (TERNARY << BITS) + 1, dtype=np.uint64)).reshape(-1, TERNARY)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63) == 1, 1.0, -1.0)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(2**BITS, DIM) unit word vectors from all texts."""

    def gather(batches):
        place, sign = _index()
        total = np.zeros((1 << BITS) * DIM)
        for b in batches:
            cells, first = word_cells(b.column(0))
            doc = np.repeat(np.arange(len(b)), np.diff(first))
            for step in range(1, REACH + 1):
                same = doc[step:] == doc[:-step]
                x, y = cells[:-step][same], cells[step:][same]
                for a, o in ((x, y), (y, x)):
                    for k in range(TERNARY):
                        total += np.bincount(a * DIM + place[o, k], sign[o, k], len(total))
        rows = total.reshape(-1, DIM)
        at = np.flatnonzero(rows.any(axis=1))
        yield _vectors(at, rows[at])

    def add(batches):
        total = np.zeros((1 << BITS, DIM))
        for b in batches:
            v = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, DIM)
            np.add.at(total, b.column(0).to_numpy(), v)
        at = np.flatnonzero(total.any(axis=1))
        yield _vectors(at, total[at])

    kind = "cell long, v binary"
    got = (docs.select("text").mapInArrow(gather, kind).repartition("cell").mapInArrow(add, kind).toPandas())
    out = np.zeros((1 << BITS, DIM))
    if len(got):
        out[got["cell"].to_numpy(np.int64)] = np.frombuffer(b"".join(got["v"]), np.float32).reshape(-1, DIM)
        used = out.any(axis=1)
        out[used] /= np.linalg.norm(out[used], axis=1, keepdims=True)
    return out.astype(np.float32)


def _vectors(at: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    raw = rows.astype(np.float32).tobytes()
    w = 4 * DIM
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(
        [raw[i * w:(i + 1) * w] for i in range(len(at))], pa.binary())], ["cell", "v"])


def features(col, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each row; zeros where there are no words."""
    cells, first = word_cells(col)
    n = np.diff(first)
    one, two = np.zeros((len(n), DIM)), np.zeros((len(n), DIM))
    at = 0
    while at < len(n):  # whole rows up to BLOCK words at a time; a longer row in parts
        end = max(at + 1, int(np.searchsorted(first, first[at] + BLOCK, side="right")) - 1)
        for a in range(first[at], max(first[end], first[at] + 1), BLOCK):
            v = vectors[cells[a:min(a + BLOCK, first[end])]]
            ptr = np.clip(first[at:end] - a, 0, len(v))
            some = np.flatnonzero(np.diff(np.append(ptr, len(v))) > 0)
            if len(some):
                one[at + some] += np.add.reduceat(v, ptr[some], axis=0)
                two[at + some] += np.add.reduceat(v * v, ptr[some], axis=0)
        at = end
    k = np.maximum(n, 1)[:, None]
    mean = one / k
    return np.hstack([mean, np.sqrt(np.maximum(two / k - mean * mean, 0))])


def train(x: np.ndarray, y: np.ndarray, epochs: int = 300, seed: int = 11) -> dict:
    """Two layers by Adam, then the temperature by the likelihood of the rows held back."""
    share = float(y.mean()) if len(y) else 0.0
    if not len(y) or share in (0.0, 1.0):
        return {"share": share}
    rng = np.random.default_rng(seed)
    mu, sd = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mu) / sd
    back = rng.random(len(y)) < 0.1
    fit, own = z[~back], y[~back].astype(float)
    p = {"a": rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), "b": np.zeros(HIDDEN),
         "c": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "d": np.array(np.log(share / (1 - share)))}
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    for t in range(1, epochs + 1):
        hid = np.tanh(fit @ p["a"] + p["b"])
        err = (1 / (1 + np.exp(-(hid @ p["c"] + p["d"]))) - own) / len(own)
        back_h = np.outer(err, p["c"]) * (1 - hid * hid)
        grad = {"a": fit.T @ back_h + 1e-4 * p["a"], "b": back_h.sum(axis=0), "c": hid.T @ err + 1e-4 * p["c"],
                "d": err.sum()}
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    out = {**p, "mu": mu, "sd": sd, "t": 1.0}
    held = logits(out, x[back])
    sign = np.where(y[back] == 1, 1.0, -1.0)
    grid = np.geomspace(0.25, 8, 61)
    if len(held):
        out["t"] = float(grid[np.argmin([np.logaddexp(0, -sign * held / t).mean() for t in grid])])
    return out


def logits(model: dict, x: np.ndarray) -> np.ndarray:
    hid = np.tanh((x - model["mu"]) / model["sd"] @ model["a"] + model["b"])
    return (hid @ model["c"] + model["d"]) / model["t"]


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows of ``docs`` as (doc_id, held_out, score, predicted)."""
    spark = docs.sparkSession
    prepare(spark)
    vectors = spark.sparkContext.broadcast(word_vectors(docs))

    def pooled(batches):
        for b in batches:
            f = features(b.column(0), vectors.value)
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array([r.tobytes() for r in f], pa.binary())],
                                             ["y", "x"])

    got = (training_rows(docs, labels, "quality", 3, 1, SAMPLE)
           .mapInArrow(pooled, T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())]))
           .toPandas().sort_values(["y", "x"], kind="stable"))
    x = np.frombuffer(b"".join(got["x"]), np.float64).reshape(-1, 2 * DIM)
    model = train(x, got["y"].to_numpy(np.int64))

    @F.pandas_udf(T.DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            if "share" in model:
                yield pd.Series(np.full(len(s), model["share"]))
                continue
            z = logits(model, features(pa.array(s, pa.string(), from_pandas=True), vectors.value))
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    out = docs.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
                      score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
