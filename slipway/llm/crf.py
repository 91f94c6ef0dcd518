"""Language identification: a linear-chain conditional random field labels every word.

Words are runs of letters, lower-cased. A word's score for a language adds learned
weights of its affixes (first and last 1 to 3 letters), of its letter 2- and 3-grams
(the word's ends marked) and of the lexicon: the ``LEXICON`` most frequent words of the
training documents with the share of each language in their relative frequencies.
Learned transition weights join neighbouring words. Forward-backward over the whole
text gives each word's probability of each language; a document's language is the one
with the greatest sum over its words, its score that sum's share.

Training documents have one language each, so a training sequence is spliced from
stretches of documents of several languages: the transitions are learned from switches.
The fit reads at most ``SEGMENTS`` stretches of ``STRETCH`` words a language, from about
``DOCS`` documents a language chosen by a hash of the id (the bound is on the fit alone);
the lexicon counts the words of all training documents.

Texts are read in full. A text of more than ``PIECE`` bytes is labelled in pieces of that
size, each a sequence of its own, cut between words; where it is cut depends on that text alone.
Sequences are handled in blocks of ``STEP`` words whose transition products are formed side by
side, so the number of steps in Python is the longest text's words / ``STEP``.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every
text if there is no training document with a letter; with one language only, that language
has score 1; a null doc_id is neither held out nor learned from, a null lang not learned
from; of equally likely languages the first in order of name; repeated rows are predicted
alike; other columns are not read.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipway.llm.common import crc_mod, mix64, prepare, span_hashes, spans, table, utf8_arrays

BITS = 16
LEXICON = 20_000
DOCS, SEGMENTS, STRETCH = 1_500, 2_500, 24
PIECE = 1 << 20
STEP = 32
SPLICED = 4  # stretches of a training sequence
ROUNDS, RATE, L2 = 60, 0.15, 1e-6
UNKNOWN = "und"


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: is it a letter, its lower case, the number that stands for it in hashes."""
    letter = np.zeros(0x110000, bool)
    low = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            letter[c] = True
            t = s.lower()
            if len(t) == 1:
                low[c] = ord(t)
    return letter, low, mix64(low.astype(np.uint64) + np.uint64(1))


def _groups(data: np.ndarray, offs: np.ndarray):
    """(first row, bytes, row offsets): whole rows of about PIECE bytes together, a longer row by itself in pieces."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + PIECE, "right")) - 1)
        a, end = int(offs[at]), int(offs[to])
        if to > at + 1 or end - a <= PIECE:
            yield at, data[a:end], offs[at:to + 1] - a
        else:
            while a < end:
                b = min(a + PIECE, end)
                if b < end:  # an ASCII sign that is no letter ends words
                    d = data[a:b]
                    free = np.flatnonzero((d < 0x80) & ~(((d | 32) >= 97) & ((d | 32) <= 122)))
                    if len(free):
                        b = a + int(free[-1]) + 1
                    else:
                        while b > a + 1 and data[b] & 0xC0 == 0x80:
                            b -= 1
                yield at, data[a:b], np.array([0, b - a])
                a = b
        at = to


def words(col):
    """Each group of texts: first row, row offsets into its code points and into its words, the (lower-cased)
    code points, and the words' starts, ends and hashes."""
    letter, low, value = _letters()
    data, offs = utf8_arrays(col)
    for r0, d, o in _groups(data, offs):
        lead = np.zeros(len(d) + 1, np.int64)
        np.cumsum((d & 0xC0) != 0x80, out=lead[1:])
        chars = np.frombuffer(d.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        starts, ends, first = spans(chars, lead[o], letter)
        yield r0, lead[o], first, low[chars], starts, ends, span_hashes(chars, starts, ends, value)


class Features:
    """Cells and values of word types in compressed form."""

    def __init__(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts
        n = len(size)
        begin = np.cumsum(size + 2) - (size + 2)
        flat = np.zeros(int((size + 2).sum()), np.uint64)
        own = np.repeat(np.arange(n), size)
        place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        flat[begin[own] + 1 + place] = chars[starts[own] + place]
        flat[begin], flat[begin + size + 1] = 1, 2
        word = np.repeat(np.arange(n), size + 2)
        cells, rows, values = [], [], []

        def add(kind, at, length, who, value):
            h = np.full(len(at), kind + 1, np.uint64)
            for j in range(length):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + flat[at + j])
            cells.append((h >> np.uint64(64 - BITS)).astype(np.int64))
            rows.append(who)
            values.append(value)

        left = begin[word] + size[word] + 2 - np.arange(len(word))  # places to the word's end
        for g in (2, 3):
            at = np.flatnonzero(left >= g)
            add(g, at, g, word[at], 2.0 / (size[word[at]] + 3 - g))
        for g in (1, 2, 3):
            who = np.flatnonzero(size >= g)
            add(10 + g, begin[who] + 1, g, who, np.ones(len(who)))
            add(20 + g, begin[who] + 1 + size[who] - g, g, who, np.ones(len(who)))
        self.n, self.cell = n, np.concatenate(cells)
        self.row, self.value = np.concatenate(rows), np.concatenate(values)


class Model:
    """Weights of the field; ``langs`` in order of name."""

    def __init__(self, langs: list[str], lexicon: np.ndarray, shares: np.ndarray):
        k = len(langs)
        self.langs, self.lexicon, self.shares = langs, lexicon, shares.astype(np.float32)
        self.cell, self.lex = np.zeros((1 << BITS, k), np.float32), np.zeros((k + 1, k))
        self.bias, self.start, self.step = np.zeros(k), np.zeros(k), np.zeros((k, k))

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Lexicon features: the shares of each language, or a mark for unknown words."""
        k = len(self.langs)
        out = np.zeros((len(hashes), k + 1))
        out[:, k] = 1
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
            on = self.lexicon[at] == hashes
            out[on, :k], out[on, k] = self.shares[at[on]], 0
        return out

    def emit(self, f: Features, known: np.ndarray) -> np.ndarray:
        """(word types, languages): log potentials."""
        got = [np.bincount(f.row, self.cell[f.cell, y] * f.value, f.n) for y in range(len(self.langs))]
        return np.stack(got, axis=1) + known @ self.lex + self.bias


def posteriors(e: np.ndarray, ptr: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """(words, labels): forward-backward probabilities of sequences given by offsets ``ptr``.

    Each sequence is cut into blocks of STEP words. The products of the blocks' transition
    matrices are formed for all blocks at once and carried along each sequence;
    within the blocks, forward and backward vectors then run side by side.
    """
    n, k = e.shape
    size = np.diff(ptr)
    seq = np.flatnonzero(size)
    if not n:
        return np.zeros((0, k))
    many = -(-size[seq] // STEP)
    first = np.cumsum(many) - many  # first block of each sequence
    nb = int(many.sum())
    within = np.arange(n) - np.repeat(ptr[seq], size[seq])
    block, at = np.repeat(first, size[seq]) + within // STEP, within % STEP
    pot = np.ones((STEP, nb, k))
    pot[at, block] = np.exp(e - e.max(axis=1, keepdims=True))
    real = np.zeros((STEP, nb), bool)
    real[at, block] = True
    move = np.exp(step - step.max())
    head = np.zeros(nb, bool)
    head[first] = True

    def onward(v, t):  # rows of v (.., k) one word further
        out = v @ move
        if t == 0:
            out[head] = v[head]
        out *= pot[t].reshape(nb, *[1] * (v.ndim - 2), k)
        out[~real[t]] = v[~real[t]]
        return out / out.reshape(nb, -1).max(axis=1).reshape(nb, *[1] * (v.ndim - 1))

    product = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    if many.max() > 1:
        for t in range(STEP):
            product = onward(product, t)
    ahead, behind = np.ones((nb, k)), np.ones((nb, k))  # forward into a block, backward out of it
    ahead[first] = np.exp(start - start.max())
    for j in range(1, int(many.max())):
        b = first[many > j] + j
        v = np.einsum("bi,bij->bj", ahead[b - 1], product[b - 1])
        ahead[b] = v / v.max(axis=1, keepdims=True)
    for j in range(int(many.max()) - 1, 0, -1):
        b = first[many > j] + j
        v = np.einsum("bij,bj->bi", product[b], behind[b])
        behind[b - 1] = v / v.max(axis=1, keepdims=True)
    forward = np.empty((STEP, nb, k))
    v = ahead
    for t in range(STEP):
        v = forward[t] = onward(v, t)
    out = np.empty((STEP, nb, k))
    v = behind
    for t in range(STEP - 1, -1, -1):
        out[t] = forward[t] * v
        back = (pot[t] * v) @ move.T
        if t == 0:
            break
        v = np.where(real[t][:, None], back / back.max(axis=1, keepdims=True), v)
    got = out[at, block]
    return got / got.sum(axis=1, keepdims=True)


def _pairs(e, start, step):
    """Posteriors and expected transitions of equally long sequences (training): (S, T, k) arrays."""
    s, t, k = e.shape
    pot = np.exp(e - e.max(axis=2, keepdims=True))
    move = np.exp(step - step.max())
    f, b = np.empty_like(pot), np.ones_like(pot)
    v = np.exp(start - start.max()) * pot[:, 0]
    f[:, 0] = v / v.sum(axis=1, keepdims=True)
    for i in range(1, t):
        v = (f[:, i - 1] @ move) * pot[:, i]
        f[:, i] = v / v.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        v = (b[:, i + 1] * pot[:, i + 1]) @ move.T
        b[:, i] = v / v.sum(axis=1, keepdims=True)
    g = f * b
    g /= g.sum(axis=2, keepdims=True)
    moved = np.zeros((k, k))
    for i in range(1, t):
        x = f[:, i - 1, :, None] * move * (pot[:, i] * b[:, i])[:, None, :]
        moved += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return g, moved


def fit(model: Model, texts: list[str], labels: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> Model:
    """Maximum likelihood (L2, Adam) on sequences spliced from the given stretches of one language each."""
    k = len(model.langs)
    order = np.random.default_rng(seed).permutation(len(texts))
    texts, labels = [texts[i] for i in order], labels[order]
    chars, starts, ends, hashes, row, base = [], [], [], [], [], 0
    for r0, _, first, c, s, e, h in words(pa.array(texts, pa.string())):
        chars.append(c)
        starts.append(s + base)
        ends.append(e + base)
        hashes.append(h)
        row.append(r0 + np.repeat(np.arange(len(first) - 1), np.diff(first)))
        base += len(c)
    if not base or k < 2:
        return model
    chars, starts, ends, hashes, row = (np.concatenate(x) for x in (chars, starts, ends, hashes, row))
    types, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    f, known = Features(chars, starts[first], ends[first]), model.known(types)
    gold = labels[row]
    length = STRETCH * SPLICED // 2  # sequences of equal length; the switches lie anywhere in them
    n = len(word) // length
    if not n:
        length, n = len(word), 1
    word, gold = word[:n * length], gold[:n * length]
    tags = gold.reshape(n, length)
    target = np.zeros((f.n, k))
    np.add.at(target, (word, gold), 1)
    went = np.zeros((k, k))
    np.add.at(went, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    begun = np.bincount(tags[:, 0], minlength=k)
    cells = model.cell.astype(np.float64)
    params = [cells, model.lex, model.bias, model.start, model.step]
    one, two = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        model.cell = cells.astype(np.float32)
        e = model.emit(f, known)[word].reshape(n, length, k)
        g, moved = _pairs(e, model.start, model.step)
        gap = target - np.stack([np.bincount(word, g.reshape(-1, k)[:, y], f.n) for y in range(k)], axis=1)
        by_cell = np.stack([np.bincount(f.cell, gap[f.row, y] * f.value, 1 << BITS) for y in range(k)], axis=1)
        grads = [by_cell, known.T @ gap, gap.sum(axis=0), begun - g[:, 0].sum(axis=0), went - moved]
        for i, (p, d) in enumerate(zip(params, grads)):
            d = d / len(word) - L2 * p
            one[i] = 0.9 * one[i] + 0.1 * d
            two[i] = 0.99 * two[i] + 0.01 * d * d
            p += RATE * (one[i] / (1 - 0.9 ** r)) / (np.sqrt(two[i] / (1 - 0.99 ** r)) + 1e-9)
    model.cell = cells.astype(np.float32)
    return model


def _training(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    return (docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang"))
            .filter("lang is not null and id is not null").filter(crc_mod(F.col("id"), modulus) != held))


def lexicon(rows: DataFrame, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent words and the share of each language in their relative frequencies."""

    def count(batches):
        held: dict[str, list] = {}
        size = 0

        def cut():
            nonlocal size
            for lang, parts in held.items():
                h = np.concatenate([p[0] for p in parts])
                u, at = np.unique(h, return_inverse=True)
                held[lang] = [(u, np.bincount(at, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64))]
            size = sum(len(p[0][0]) for p in held.values())

        def rows_():
            for lang, [(h, c)] in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)),
                                                  pa.array(c)], ["lang", "word", "n"])

        for b in batches:
            tag = b.column(1).to_numpy(zero_copy_only=False)
            for r0, _, first, _, _, _, h in words(b.column(0)):
                lang = tag[r0:r0 + len(first) - 1].repeat(np.diff(first))
                for x in set(lang):
                    u, c = np.unique(h[lang == x], return_counts=True)
                    held.setdefault(x, []).append((u, c))
                    size += len(u)
            if size > 1 << 21:
                cut()
                if size > 1 << 20:  # memory stays bounded: partial counts are added up later
                    yield from rows_()
                    held, size = {}, 0
        cut()
        yield from rows_()

    n = rows.select("text", "lang").mapInArrow(count, "lang string, word long, n long") \
            .groupBy("word", "lang").agg(F.sum("n").alias("n"))
    each = F.array(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)) for x in langs])
    by_word = n.groupBy("word").agg(F.sum("n").alias("n"), each.alias("each"))
    top = by_word.filter("n >= 3").orderBy(F.desc("n"), "word").limit(LEXICON).collect()  # at most LEXICON rows
    h = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    c = np.array([r["each"] for r in top], np.float64).reshape(len(top), len(langs))
    if len(top):
        c = c / np.maximum(c.sum(axis=0), 1)
        c = c / c.sum(axis=1, keepdims=True)
    order = np.argsort(h)
    return h[order], c[order]


PART = pa.schema([("lang", pa.string()), ("text", pa.string()), ("id", pa.int64()), ("at", pa.int64())])


def stretches(rows: DataFrame, n_docs: dict[str, int]) -> DataFrame:
    """(lang, text): at most SEGMENTS stretches of STRETCH words a language, from anywhere in the sampled texts."""
    space = F.lit(1 << 30)
    cuts = F.create_map(*[F.lit(v) for lang, n in n_docs.items() for v in (lang, min(1 << 30, (DOCS << 30) // n + 1))])
    some = rows.filter(F.pmod(F.xxhash64("id"), space) < cuts[F.col("lang")])

    def cut(batches):
        for b in batches:
            key, lang = b.column(0).to_pylist(), b.column(2).to_pylist()
            for r0, _, first, c, s, e, _ in words(b.column(1)):
                out: dict[str, list] = {"lang": [], "text": [], "id": [], "at": []}
                for r in range(len(first) - 1):
                    for a in range(first[r], first[r + 1], STRETCH):
                        z = min(a + STRETCH, first[r + 1]) - 1
                        out["lang"].append(lang[r0 + r])
                        out["text"].append(c[s[a]:e[z]].tobytes().decode("utf-32-le"))
                        out["id"].append(key[r0 + r])
                        out["at"].append(int(a - first[r]))
                yield pa.RecordBatch.from_pydict(out, PART)

    cut_up = some.select(F.xxhash64("id").alias("id"), "text", "lang").mapInArrow(
        cut, "lang string, text string, id long, at long")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", "at", "text"), "text")
    return cut_up.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SEGMENTS).select("lang", "text")


def train(docs: DataFrame, modulus: int = 4, held: int = 2) -> Model:
    """Lexicon from all training documents; the field fitted in one task on a sample of bounded size."""
    prepare(docs.sparkSession)
    rows = _training(docs, modulus, held)
    n_docs = {r["lang"]: r["n"] for r in rows.filter("text is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(n_docs)
    if not langs:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0)))
    model = Model(langs, *lexicon(rows, langs))

    def learn(frames):
        pdf = pd.concat([*frames, pd.DataFrame({"lang": [], "text": []})]).sort_values(["lang", "text"], kind="stable")
        labels = np.searchsorted(langs, pdf["lang"].to_numpy(str)) if len(pdf) else np.zeros(0, np.int64)
        yield pd.DataFrame({"model": [pickle.dumps(fit(model, list(pdf["text"]), labels))]})

    got = stretches(rows, n_docs).repartition(1).mapInPandas(learn, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else model


def _labelled(model: Model, col: pa.Array):
    """Each group of texts: first row, row offsets into its code points and words, the words' starts, ends, posteriors."""
    for r0, begin, first, chars, starts, ends, h in words(col):
        if not len(h) or not model.langs:
            yield r0, begin, first, starts, ends, np.zeros((len(h), len(model.langs)))
            continue
        types, at, word = np.unique(h, return_index=True, return_inverse=True)
        e = model.emit(Features(chars, starts[at], ends[at]), model.known(types))[word]
        yield r0, begin, first, starts, ends, posteriors(e, first, model.start, model.step)


def predict(docs: DataFrame, model: Model, modulus: int = 4, held: int = 2) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score, n_words."""
    prepare(docs.sparkSession)
    k = len(model.langs)
    names = np.array([*model.langs, UNKNOWN], object)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON rows and 2**BITS cells, whatever the corpus

    def read(batches):
        for b in batches:
            mass, n = np.zeros((len(b), k)), np.zeros(len(b), np.int64)
            for r0, _, first, _, _, p in _labelled(sent.value, b.column(2)):
                row = r0 + np.repeat(np.arange(len(first) - 1), np.diff(first))
                n += np.bincount(row, minlength=len(b))
                for y in range(k):
                    mass[:, y] += np.bincount(row, p[:, y], len(b))
            on = (n > 0) & (k > 0)
            best = mass.argmax(axis=1) if k else np.zeros(len(b), np.int64)
            share = mass.max(axis=1) / np.maximum(n, 1) if k else np.zeros(len(b))
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(names[np.where(on, best, k)], pa.string()),
                pa.array(np.where(on, np.clip(share, 0, 1), 0.0)), pa.array(n)],
                ["doc_id", "held_out", "lang_pred", "score", "n_words"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(crc_mod(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"),
                        F.col("text").cast("string").alias("text"))
    return named.mapInArrow(read, "doc_id long, held_out boolean, lang_pred string, score double, n_words long")


def runs(docs: DataFrame, model: Model) -> DataFrame:
    """Stretches of one language: doc_id, piece, start and end (code points in the piece), lang, n_words, score.
    A text up to PIECE bytes is one piece, 0; piece numbers of a longer text go up by one."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches):
        for b in batches:
            key, last, out = b.column(0).to_pylist(), (-1, -1), []
            for r0, begin, first, starts, ends, p in _labelled(sent.value, b.column(1)):
                tag = p.argmax(axis=1) if p.size else np.zeros(0, np.int64)
                for r in range(len(first) - 1):
                    last = (r0 + r, last[1] + 1 if last[0] == r0 + r else 0)
                    a, z = first[r], first[r + 1]
                    if a == z or not p.size:
                        continue
                    new = np.append(a, a + 1 + np.flatnonzero(tag[a + 1:z] != tag[a:z - 1]))
                    for i, j in zip(new, np.append(new[1:], z)):
                        out.append((key[r0 + r], last[1], int(starts[i] - begin[r]), int(ends[j - 1] - begin[r]), sent.value.langs[tag[i]],
                                    int(j - i), float(p[i:j, tag[i]].mean())))
            yield pa.RecordBatch.from_pylist([dict(zip(RUN.names, o)) for o in out], RUN)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        read, "doc_id long, piece int, start long, end long, lang string, n_words long, score double")


RUN = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                 ("lang", pa.string()), ("n_words", pa.int64()), ("score", pa.float64())])


def op12_crf_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
