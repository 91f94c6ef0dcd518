"""Context-tree weighting over bytes, and a smoothed word model beside it.

A text is read as its lower-cased words, each ended by a blank, then an end
mark. Every byte is eight binary decisions. A decision is predicted in the
contexts of the 0, 1, ... ``DEPTH`` bytes before it: for the first ``START``
bytes of a word (or its end mark) these run through the blank into the last
``TAIL`` bytes of the word before, for later bytes back to the blank that
begins the word. Every context node counts both outcomes and gives the
Krichevsky-Trofimov estimate, and the estimates of all depths are mixed by
the weights of context-tree weighting: at a node with block probability Pe
and children Pw, ``Pw = OWN * Pe + (1 - OWN) * prod Pw_child``, and its own
estimate enters with weight ``OWN * Pe / Pw``. Counts come from all training texts; then
the weights are fixed and every text is scored under them.

So a token's code length is that of its head (the tail before it and its
first bytes, packed into one number) plus that of the rest of its word, and
the tree is built from the distinct heads and words and their counts:

1. ``vocabulary``: each task adds up its heads and words; one shuffle.
2. ``cells``: (context, byte) of every head and word with its count, packed into 64
   bits with the nearest context byte first, so that in order of that number
   a context node is a stretch of rows. Cells are dealt by their two nearest
   bytes; a group holds the whole subtree below and is weighted on its own.
   Depths 0 and 1 (at most 256 * 255 nodes) are mixed in from the driver.
3. A head's or word's score is the sum over its cells, a text's that over its
   tokens. The at most ``HEAD`` most frequent heads and words are looked up in
   the tasks, all others are joined. Both ways are exact.

Defined cases: null or empty text is the end mark alone; a null doc_id is a
training row; repeated rows train and score like any rows; without training
rows all outcomes are even; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipway.llm.common import (
    BYTE_VALUES_LOWER, LOWER, SPACE, crc_mod, prepare, span_hashes, spans, stored, table, utf8_arrays)

HEAD = 1 << 18
DEPTH = 7
TAIL, START = 3, 2
OWN = 0.5  # prior weight of a node's own estimate against those of longer contexts
BLANK, END_BYTE = 0x20, 0xFF  # the second is in no UTF-8 text
END_WORD = -1
HELD = 0


def words(col):
    """Hash of every word (A-Z lower-cased) and row offsets; bytes and spans of the words."""
    data, offs = utf8_arrays(col)
    starts, ends, first = spans(data, offs, ~SPACE)
    h = span_hashes(data, starts, ends, BYTE_VALUES_LOWER)
    return np.minimum(h, np.uint64((1 << 64) - 2)).view(np.int64), first, data, starts, ends


def heads(data, first, starts, ends):
    """The head of every token, end marks included, and row offsets.

    A head packs the tail of the word before, nearest byte first, the first
    bytes of the word and its blank, and how many of the latter there are.
    """
    m = len(starts)
    low = LOWER[data].astype(np.int64) if m else np.zeros(1, np.int64)
    tail = np.zeros(m + 1, np.int64)  # of each word; last: none
    for t in range(1, TAIL + 1):
        tail[:m] = tail[:m] << 8 | np.where(ends - t >= starts, low[ends - t], 0)
    before = np.arange(m) - 1
    before[first[:-1][first[:-1] < first[1:]]] = m
    code = tail[before]
    for j in range(START):
        at = starts + j
        code = code << 8 | np.where(at < ends, low[np.minimum(at, len(low) - 1)], np.where(at == ends, BLANK, 0))
    code |= np.minimum(ends - starts + 1, START) << 8 * (TAIL + START)
    last = tail[np.where(first[1:] > first[:-1], first[1:] - 1, m)]
    end = (last << 8 | END_BYTE) << 8 * (START - 1) | 1 << 8 * (TAIL + START)
    return np.insert(code, first[1:], end), first + np.arange(len(first))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(key, word, n): every distinct word of all texts and its count in training rows;
    likewise the heads, whose word is null."""

    def run(batches):
        held, waiting, rows, trained = [], 0, 0, 0
        codes, counts = np.zeros(0, np.int64), np.zeros(0)

        def merged(parts):
            k, w, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.argsort(k, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(k[order]) != 0)) if len(k) else np.zeros(0, np.int64)
            return k[order][first], w[order][first], np.add.reduceat(n[order], first) if len(k) else n

        def batch(k, w, n):
            w = pa.nulls(len(k), pa.binary()) if w is None else pa.array(list(w), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), w,
                                               pa.array(n, pa.int64())], ["key", "word", "n"])

        for b in batches:
            h, first, data, starts, ends = words(b.column(1))
            train = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
            u, at, inv = np.unique(h, return_index=True, return_inverse=True)
            n = np.bincount(inv, np.repeat(train, np.diff(first)), len(u)).astype(np.int64)
            raw = LOWER[data].tobytes()
            w = np.empty(len(u), object)
            w[:] = [raw[a:e] for a, e in zip(starts[at].tolist(), ends[at].tolist())]
            held.append((u, w, n))
            waiting += len(u)
            rows += len(b)
            trained += int(train.sum())
            c, at = heads(data, first, starts, ends)
            codes, inv = np.unique(np.concatenate([codes, c]), return_inverse=True)
            counts = np.bincount(inv, np.concatenate([counts, np.repeat(train, np.diff(at))]), len(codes))
            if len(codes) > 1_000_000:
                yield batch(codes, None, counts.astype(np.int64))
                codes, counts = codes[:0], counts[:0]
            if waiting > 1_500_000:
                held = [merged(held)]
                if len(held[0][0]) > 750_000:
                    yield batch(*held.pop())
                waiting = len(held[0][0]) if held else 0
        if held:
            yield batch(*merged(held))
        if rows:
            yield batch(codes, None, counts.astype(np.int64))
            yield batch([END_WORD], [bytes([END_BYTE])], [trained])

    train = F.coalesce(crc_mod(F.col("doc_id"), 10) != HELD, F.lit(True)).alias("train")
    return (docs.select(train, "text").mapInArrow(run, "key long, word binary, n long")
            .groupBy("key", "word").agg(F.sum("n").alias("n")))


def word_cells(word: bytes) -> np.ndarray:
    """The cells of a word after its head: DEPTH context bytes, nearest first, then the byte."""
    text = bytes([BLANK]) + word + (b"" if word == bytes([END_BYTE]) else bytes([BLANK]))
    out, ctx = [], BLANK << 8 * (DEPTH - 1)
    for b in text[1:]:
        out.append(ctx << 8 | b)
        ctx = b << 8 * (DEPTH - 1) | ctx >> 8
    return np.array(out[START:], np.uint64)


def head_cells(code: np.ndarray):
    """The cells of heads, and the place of the head of each."""
    ctx = BLANK << 8 * (DEPTH - 1) | (code >> 8 * START & (1 << 8 * TAIL) - 1) << 8 * (DEPTH - 1 - TAIL)
    out, own = [], []
    for j in range(START):
        b = code >> 8 * (START - 1 - j) & 255
        at = np.flatnonzero(code >> 8 * (TAIL + START) > j)
        out.append((ctx << 8 | b)[at].view(np.uint64))
        own.append(at)
        ctx = b << 8 * (DEPTH - 1) | ctx >> 8
    return np.concatenate(out), np.concatenate(own)


def _symbols(vocab: DataFrame) -> DataFrame:
    """(cell, key, n, head) of every byte of every head and word; one row with a
    null cell for a word that is all head."""

    def run(batches):
        for b in batches:
            is_head = b.column(1).is_null().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(~is_head)
            each = [word_cells(w) for w in b.column(1).drop_null().to_pylist()]
            size = np.array([len(c) for c in each], np.int64)
            bare = at[size == 0]
            cell, own = head_cells(b.column(0).to_numpy()[is_head])
            own = np.concatenate([np.repeat(at, size), np.flatnonzero(is_head)[own], bare])
            cell = np.concatenate([*each, cell]).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(cell), pa.nulls(len(bare), pa.int64())]),
                pa.array(b.column(0).to_numpy()[own]), pa.array(b.column(2).to_numpy()[own]),
                pa.array(is_head[own])], ["cell", "key", "n", "head"])

    return vocab.select("key", "word", "n").mapInArrow(run, "cell long, key long, n long, head boolean")


# ---- the tree ----------------------------------------------------------------

def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5 (Stirling after a shift by eight)."""
    p = x * (x + 1) * (x + 2) * (x + 3)
    q = (x + 4) * (x + 5) * (x + 6) * (x + 7)
    y = x + 8
    return ((y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3)
            + 1 / (1260 * y ** 5)) - np.log(p) - np.log(q)


def _log_pe(n0, n1):
    out = np.zeros(n0.shape)
    at = (n0 + n1) > 0
    a, b = n0[at], n1[at]
    out[at] = _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - math.log(math.pi)
    return out


def _weigh(pe, children):
    """log Pw of nodes, and the weight with which their own estimate enters."""
    pw = np.logaddexp(pe + math.log(OWN), children + math.log(1 - OWN))
    return pw, np.exp(pe + math.log(OWN) - pw)


def _subtree(cell: np.ndarray, n: np.ndarray, top: int):
    """Weight the tree of the given cells (uint64) from DEPTH up to depth ``top``.

    Yields per bit level: the bit of each cell, the mixture of each cell's node
    of depth ``top``, its node's number, and log Pw of those nodes.
    """
    byte = (cell & np.uint64(255)).astype(np.int64)
    for level in range(8):
        bit = byte >> (7 - level) & 1
        prefix = (np.uint64(1 << level) | (byte >> (8 - level)).astype(np.uint64))
        one, zero = n * bit, n * (1 - bit)
        p = pw = first = None
        for depth in range(DEPTH, top - 1, -1):
            ctx = cell >> np.uint64(8 * (DEPTH + 1 - depth)) if depth else np.zeros(len(cell), np.uint64)
            _, at, node = np.unique(ctx << np.uint64(8) | prefix, return_index=True, return_inverse=True) \
                if depth < DEPTH else np.unique(cell >> np.uint64(8 - level), return_index=True, return_inverse=True)
            n0, n1 = np.bincount(node, zero), np.bincount(node, one)
            pe, kt = _log_pe(n0, n1), (n1 + 0.5) / (n0 + n1 + 1)
            if p is None:
                p, pw = kt[node], pe
            else:
                pw, own = _weigh(pe, np.bincount(node[first], pw, len(at)))
                own = own[node]
                p = own * kt[node] + (1 - own) * p
            first = at
        yield level, bit, p, first, pw, prefix


def _groups(batches):
    """Whole groups (cells of equal nearest two bytes) from sorted (cell, n) batches."""
    held_c, held_n = [], []
    for b in batches:
        c = b.column(0).to_numpy().view(np.uint64)
        n = b.column(1).to_numpy()
        g = c >> np.uint64(48)
        edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(c)] if len(c) else []
        for a, e in zip(edges[:-1], edges[1:]):
            if held_c and held_c[-1][-1] >> np.uint64(48) != g[a]:
                yield np.concatenate(held_c), np.concatenate(held_n)
                held_c, held_n = [], []
            held_c.append(c[a:e])
            held_n.append(n[a:e])
    if held_c:
        yield np.concatenate(held_c), np.concatenate(held_n)


def cell_scores(cells: DataFrame) -> DataFrame:
    """(cell, lp): log10 probability of each cell's byte after its context."""
    dealt = stored(cells.select("cell", "n", F.shiftrightunsigned("cell", 48).alias("g")).repartition("g")
                   .sortWithinPartitions("g", "cell").select("cell", "n"), "cells")

    def tops(batches):  # per group and decision: counts of both outcomes and log Pw at depth 2
        for cell, n in _groups(batches):
            for level, bit, _, first, pw, prefix in _subtree(cell, n, 2):
                node = np.searchsorted(np.sort(prefix[first]), prefix)
                order = np.argsort(prefix[first])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(first), int(cell[0] >> np.uint64(56)))),
                    pa.array(prefix[first][order].astype(np.int64)), pa.array(np.bincount(node, n * (1 - bit))),
                    pa.array(np.bincount(node, n * bit)), pa.array(pw[order])], ["c1", "node", "n0", "n1", "pw"])

    # c1: the nearest byte; at most 256 x 255 rows after the sum
    top = (dealt.mapInArrow(tops, "c1 long, node long, n0 double, n1 double, pw double")
           .groupBy("c1", "node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "pw")]).toPandas())
    one = np.zeros((3, 256, 256))
    for k, c in enumerate(("n0", "n1", "pw")):
        one[k][top["c1"], top["node"]] = top[c]
    pe1 = _log_pe(one[0], one[1])
    pw1, own1 = _weigh(pe1, one[2])
    kt1 = (one[1] + 0.5) / (one[0] + one[1] + 1)
    n0, n1 = one[0].sum(axis=0), one[1].sum(axis=0)
    pe0 = _log_pe(n0, n1)
    own0 = _weigh(pe0, pw1.sum(axis=0))[1]
    kt0 = (n1 + 0.5) / (n0 + n1 + 1)
    low = dealt.sparkSession.sparkContext.broadcast((own1, kt1, own0, kt0))

    def score(batches):
        own1, kt1, own0, kt0 = low.value
        for cell, n in _groups(batches):
            c1, lp = int(cell[0] >> np.uint64(56)), np.zeros(len(cell))
            for _, bit, p, _, _, prefix in _subtree(cell, n, 2):
                node = prefix.astype(np.int64)
                p = own1[c1][node] * kt1[c1][node] + (1 - own1[c1][node]) * p
                p = own0[node] * kt0[node] + (1 - own0[node]) * p
                lp += np.log10(np.where(bit == 1, p, 1 - p))
            for a in range(0, len(cell), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(cell[a:a + 100_000].view(np.int64)),
                                                  pa.array(lp[a:a + 100_000])], ["cell", "lp"])

    return dealt.mapInArrow(score, "cell long, lp double")


def token_scores(vocab: DataFrame) -> DataFrame:
    """(key, head, n, lp) of every head and word."""
    symbols = stored(_symbols(vocab), "symbols")
    cells = symbols.filter("cell is not null").groupBy("cell").agg(F.sum("n").alias("n"))
    return (symbols.join(cell_scores(cells), "cell", "left").groupBy("key", "head")
            .agg(F.first("n").alias("n"), F.coalesce(F.sum("lp"), F.lit(0.0)).alias("lp")))


# ---- scores ------------------------------------------------------------------

def _head(known: DataFrame) -> pd.DataFrame:
    """The most frequent of the given heads or words, at most HEAD, in order of key."""
    power = F.floor(F.log2(F.greatest("n", F.lit(1)))).cast("int")
    by = {r[0]: r[1] for r in known.groupBy(power.alias("b")).count().collect()}
    total, least = 0, None
    for b in sorted(by, reverse=True):
        total += by[b]
        if total > HEAD:
            break
        least = b
    if least is None:
        return pd.DataFrame({"key": np.zeros(0, np.int64), "n": np.zeros(0), "lp": np.zeros(0)})
    return known.filter(power >= least).toPandas().sort_values("key")


def scores(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    prepare(spark)
    known = stored(token_scores(vocabulary(docs)), "token-scores")
    listed = known.filter("not head")
    n_all, n_words = listed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    floor = math.log10(n_all + 0.1 * (n_words + 1))
    lookup = spark.sparkContext.broadcast([
        tuple(top[c].to_numpy(t) for c, t in (("key", np.int64), ("n", np.int64), ("lp", np.float64)))
        for top in (_head(listed), _head(known.filter("head")))])
    end = listed.filter(F.col("key") == END_WORD).first()
    c_end = end["n"] if end else 0

    def found(keys, table):
        """Which keys the table holds, and where."""
        if not len(table) or not len(keys):
            return np.zeros(len(keys), bool), np.zeros(0, np.int64)
        u, inv = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(table, u), len(table) - 1)
        hit = (table[at] == u)[inv]
        return hit, at[inv][hit]

    def run(batches):
        (keys, n, lp), (codes, _, code_lp) = lookup.value
        gain = np.log10(n + 0.1)
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            w, first, data, starts, ends = words(b.column(2))
            code, code_first = heads(data, first, starts, ends)

            def rows(hit, first):  # row offsets among the hits
                return np.concatenate([[0], np.cumsum(hit)])[first]

            def total(x, ptr):
                return np.diff(np.concatenate([[0], np.cumsum(x)])[ptr])

            hit, place = found(w, keys)
            code_hit, code_place = found(code, codes)
            ptr, code_ptr = rows(hit, first), rows(code_hit, code_first)
            yield pa.RecordBatch.from_arrays([
                pa.array(uid + np.arange(len(b))), b.column(0), b.column(1), pa.array(np.diff(first) + 1),
                pa.array(total((n[place] > 0).astype(np.int64), ptr) + int(c_end > 0)),
                pa.array(total(gain[place], ptr) + math.log10(c_end + 0.1)),
                pa.array(total(lp[place], ptr) + total(code_lp[code_place], code_ptr)),
                pa.ListArray.from_arrays(pa.array(first - ptr, pa.int32()), pa.array(w[~hit], pa.int64())),
                pa.ListArray.from_arrays(pa.array(code_first - code_ptr, pa.int32()),
                                         pa.array(code[~code_hit], pa.int64()))],
                ["uid", "doc_id", "held_out", "n_tokens", "known", "gain", "score", "rare", "rare_heads"])
            uid += len(b)

    held = F.coalesce(crc_mod(F.col("doc_id"), 10) == HELD, F.lit(False))
    main = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(
        run, "uid long, doc_id long, held_out boolean, n_tokens long, known long, gain double, score double, "
             "rare array<long>, rare_heads array<long>"), "scores")
    # The words and heads that were not looked up, each joined with its count and score.
    m, word = F.col("m"), ~F.col("head")
    rare = (main.select("uid", F.lit(False).alias("head"), F.explode("rare").alias("key"))
            .unionByName(main.select("uid", F.lit(True).alias("head"), F.explode("rare_heads").alias("key")))
            .groupBy("uid", "head", "key").agg(F.count("*").alias("m"))
            .join(known, ["key", "head"])
            .groupBy("uid").agg(F.sum(F.when(word & (F.col("n") > 0), m).otherwise(0)).alias("more"),
                                F.sum(F.when(word, m * F.log10(F.col("n") + 0.1)).otherwise(0.0)).alias("rest"),
                                F.sum(m * F.col("lp")).alias("lp")))
    zero = F.lit(0.0)
    return main.join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("gain") + F.coalesce("rest", zero) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("score") + F.coalesce("lp", zero)).alias("score"))


def op7_context_tree(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
