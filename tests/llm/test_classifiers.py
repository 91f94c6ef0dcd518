"""op2 and op8 against plain versions: features, ratios, word vectors, pooling, temperature."""
import re

import numpy as np
import pyarrow as pa
import pytest

from slipway.llm import quality, toxicity

TEXTS = ["The bad and the GOOD\nwords", "", None, "x", "éa ÉA 123 a1! b-c", "one two three four five six seven " * 9]


def plain_cells(text, bits):
    x = [32] + [ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in text or ""]
    out = set()
    for n in toxicity.ORDERS:
        for i in range(len(x) - n + 1):
            h = x[i] * 2654435761 % 2**32
            for j in range(1, n):
                h = (h + x[i + j]) * 2246822519 % 2**32
                h ^= h >> 15
            out.add((h * (3266489917 + 2 * n) % 2**32) >> (32 - bits))
    return out


@pytest.mark.parametrize("block", [3, 64, 1 << 20])
def test_toxicity_features_are_the_distinct_grams(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    got = list(toxicity._rows(pa.array(TEXTS), toxicity.Grams()))
    for t, cells in zip(TEXTS, got):
        assert len(cells) == len(set(cells.tolist())) and set(cells.tolist()) == plain_cells(t, toxicity.BITS)


def test_toxicity_weights_carry_the_log_count_ratios():
    """Cells of one label only get weights of that label's sign, cells of both in equal shares none."""
    rng = np.random.default_rng(0)
    docs, y = [], np.arange(200) % 2
    for t in y:
        docs.append(np.unique(np.concatenate([[5, 6] if t else [7, 8], [9], rng.integers(20, 60, 5)])))
    ptr = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    cells = np.concatenate(docs).astype(np.int32)
    w, b = toxicity.fit_weights(cells, ptr, y, bits=6)
    assert w[5] > 0.5 and w[6] > 0.5 and w[7] < -0.5 and w[8] < -0.5 and abs(w[9]) < 1e-6
    z = np.array([b + w[d].sum() for d in docs])
    assert ((z > 0) == (y == 1)).all()
    for one in (0, 1):  # a single label: its share
        w, b = toxicity.fit_weights(cells, ptr, np.full(200, one), bits=6)
        assert not w.any() and (1 / (1 + np.exp(-b)) > 0.5) == bool(one)


def plain_words(text):
    """Runs of letters (ASCII letters and all bytes outside ASCII), of digits, or of other signs."""
    return re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+", (text or "").encode())


def cell_of(word):
    return int(quality.word_cells(pa.array([word], pa.binary()).cast(pa.string(), safe=False))[0][0])


def test_quality_words_and_pooling(monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1 << quality.BITS, quality.DIM)).astype(np.float32)
    cells, first = quality.word_cells(pa.array(TEXTS))
    assert np.diff(first).tolist() == [len(plain_words(t)) for t in TEXTS]
    for block in (2, 5, 200_000):
        monkeypatch.setattr(quality, "BLOCK", block)
        got = quality.features(pa.array(TEXTS), vectors)
        for t, row in zip(TEXTS, got):
            v = np.array([vectors[cell_of(w)] for w in plain_words(t)], float).reshape(-1, quality.DIM)
            want = np.concatenate([v.mean(axis=0), v.std(axis=0)]) if len(v) else np.zeros(2 * quality.DIM)
            assert np.allclose(row, want, atol=2e-3)  # sums of squares in single precision


def test_word_vectors_against_a_plain_loop(spark):
    texts = [t for t in TEXTS if t] + ["bad the words", "two one"]
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    place, sign = quality._index()
    want = np.zeros((1 << quality.BITS, quality.DIM))
    for t in texts:
        cells = [cell_of(w) for w in plain_words(t)]
        for i, c in enumerate(cells):
            for j in range(max(0, i - quality.REACH), min(len(cells), i + quality.REACH + 1)):
                if i != j:
                    for p, s in zip(place[cells[j]], sign[cells[j]]):
                        want[c, p] += s
    used = want.any(axis=1)
    want[used] /= np.linalg.norm(want[used], axis=1, keepdims=True)
    assert np.allclose(got, want, atol=1e-5) and used.sum() > 10


def test_temperature_is_the_likeliest_of_the_rows_held_back():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 6))
    y = (rng.random(600) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    model = quality.train(x, y)
    seed = np.random.default_rng(11)
    back = seed.random(len(y)) < 0.1  # the same rows as in the fit
    raw = quality.logits({**model, "t": 1.0}, x[back])
    sign = np.where(y[back] == 1, 1.0, -1.0)

    def loss(t):
        return np.log(1 + np.exp(-sign * raw / t)).mean()

    assert all(loss(model["t"]) <= loss(t) + 1e-12 for t in np.geomspace(0.25, 8, 61))
    assert ((quality.logits(model, x) > 0) == (y == 1)).mean() > 0.75
    assert quality.train(x, np.ones(600, int)) == {"share": 1.0} and quality.train(x[:0], y[:0]) == {"share": 0.0}
