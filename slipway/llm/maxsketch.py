"""Ranked lexical search: hashed max-sketches give upper bounds, exact rescoring goes down them to a threshold.

Index, built once and free of the queries: per document the number of its terms
and a sketch. Terms are hashed to 64 bits; the sketch has ``2**bits`` coordinates,
at least ``LOAD`` times the document's distinct terms, and keeps for each coordinate
the greatest frequency of the terms that fall on it (rounded up to one of 256 steps),
zeros left out. A term's impact in a given document grows with its frequency alone,
so the greatest frequency is the greatest impact. Document frequencies of all terms
are counted in the same pass and kept as partial counts.

Query, in blocks of about ``BLOCK`` items: each item looks up its terms' coordinates
in every sketch; the weighted sum is never below the document's score.
1. The ``TOP`` documents of the highest bounds of each item are scored exactly; the
   last of their scores is the item's threshold. These seeds are at most
   ``TOP`` x items rows, which bounds the broadcast that fetches their texts.
2. Every task goes through its documents from the highest bound down and scores
   exactly those whose bound still reaches the threshold, which rises as scores come
   in. A document below it cannot be among the best, so nothing is lost.
All sums are integers below 2**53 and so exact in doubles. Two different terms are
taken as one if all 64 bits of their hashes agree.

Long texts are split into terms in pieces of about ``PIECE`` bytes.

Defined cases: null and empty texts, and texts without terms, have no terms and are
not counted in N; an item without terms returns no rows; the terms of all rows of an
item_id (a null one included) count once; repeated document rows are documents each and
rank in any order among themselves; a null doc_id comes last among equal scores; without
documents or items the result is empty; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipway.llm.common import (
    BYTE_VALUES_LOWER, PIECE, byte_set, pieces, prepare, span_hashes, spans, stored, table, utf8_arrays)

TOP = 50
LOAD = 16
LEAST_BITS = 6
BLOCK = 256  # items of a pass
ENTRIES = 1 << 17  # sketch entries looked up at a time
ROWS = 64  # documents scored between two looks at the threshold
HELD = 1 << 16  # scores held before they are cut to the best
# Fixed values of the contract: bytes of a term (digits, letters, anything outside ASCII).
TERM = byte_set([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def _steps() -> np.ndarray:
    out = [1]
    while len(out) < 256:
        out.append(max(out[-1] + 1, out[-1] * 115 // 100))
    return np.array(out, np.int64)


STEPS = _steps()


def _reduce(row, h, tf):
    order = np.lexsort((h, row))
    row, h, tf = row[order], h[order], tf[order]
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))) if len(row) else np.zeros(0, int)
    return row[new], h[new], np.add.reduceat(tf, new) if len(new) else tf


def term_counts(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term hash, frequency) of the distinct terms of each row, sorted."""
    data, offs = utf8_arrays(col)
    out, split = [], set()
    for r0, d, o in pieces(data, offs, TERM, PIECE):
        starts, ends, first = spans(d, o, TERM)
        row = r0 + np.repeat(np.arange(len(o) - 1), np.diff(first))
        out.append(_reduce(row, span_hashes(d, starts, ends, BYTE_VALUES_LOWER), np.ones(len(row), np.int64)))
        if len(out) > 1:
            split.add(r0)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row, h, tf = (np.concatenate(x) for x in zip(*out))
    return _reduce(row, h, tf) if split else (row, h, tf)


def _binaries(values: np.ndarray, ptr: np.ndarray) -> pa.Array:
    """Binary array of the stretches ``ptr`` of ``values``."""
    return pa.Array.from_buffers(pa.binary(), len(ptr) - 1, [
        None, pa.py_buffer((ptr * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _values(col: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column and the offsets of its rows among them."""
    data, offs = utf8_arrays(col)
    return np.frombuffer(data.tobytes(), kind), offs // np.dtype(kind).itemsize


def sketches(row, h, tf, n_rows: int):
    """(bits per row, coordinates, steps, offsets): coordinatewise greatest frequencies of each row."""
    distinct = np.bincount(row, minlength=n_rows)
    bits = np.maximum(np.ceil(np.log2(np.maximum(LOAD * distinct, 1))), LEAST_BITS).astype(np.int64)
    at = h & ((np.uint64(1) << bits[row].astype(np.uint64)) - np.uint64(1))
    key = (row.astype(np.uint64) << np.uint64(32)) | at
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    top = np.maximum.reduceat(tf[order], new) if len(new) else np.zeros(0, np.int64)
    key = key[new]
    ptr = np.searchsorted(key >> np.uint64(32), np.arange(n_rows + 1).astype(np.uint64))
    return bits, (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(STEPS, top).astype(np.uint8), ptr


INDEX = T.StructType([T.StructField(*f) for f in (
    ("doc_id", T.LongType()), ("digest", T.LongType()), ("text", T.StringType()), ("n", T.LongType()),
    ("bits", T.IntegerType()), ("coords", T.BinaryType()), ("steps", T.BinaryType()),
    ("terms", T.BinaryType()), ("counts", T.BinaryType()))])


def build(docs: DataFrame) -> DataFrame:
    """The index: a row per document with terms, and rows of partial document frequencies (terms, counts)."""

    def read(batches):
        held, size = [], 0

        def counted():
            h, c = (np.concatenate(x) for x in zip(*held))
            _, h, c = _reduce(np.zeros(len(h), np.int64), h, c)
            return h, c

        def rows(h, c):
            for a in range(0, len(h), 1 << 16):
                x, y = h[a:a + (1 << 16)], c[a:a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([
                    *[pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(),
                                               pa.binary())],
                    pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], INDEX.names)

        for b in batches:
            row, h, tf = term_counts(b.column(2))
            n = np.bincount(row, tf, len(b)).astype(np.int64)
            bits, at, step, ptr = sketches(row, h, tf, len(b))
            full = pa.RecordBatch.from_arrays([
                *b.columns, pa.array(n), pa.array(bits.astype(np.int32)), _binaries(at, ptr), _binaries(step, ptr),
                pa.nulls(len(b), pa.binary()), pa.nulls(len(b), pa.binary())], INDEX.names)
            yield full.filter(pa.array(n > 0))
            held.append(_reduce(np.zeros(len(h), np.int64), h, np.ones(len(h), np.int64))[1:])
            size += len(held[-1][0])
            if size > 1 << 20:
                held = [counted()]
                size = len(held[0][0])
                if size > 1 << 19:  # memory stays bounded: partial counts are added up later
                    yield from rows(*held[0])
                    held, size = [], 0
        if held:
            yield from rows(*counted())

    spark = docs.sparkSession
    prepare(spark)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"),
                        F.col("text").cast("string").alias("text"))
    return stored(named.mapInArrow(read, INDEX), "sketches")


class Queries:
    """A block of items: sorted term hashes, weights, and the items of each term."""

    def __init__(self, terms: list[np.ndarray], total: int, length: int):
        self.size, self.total, self.length = len(terms), total, length
        self.hash = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)
        self.item = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        self.term = np.searchsorted(self.hash, np.concatenate(terms)) if terms else np.zeros(0, np.int64)
        self.weight = np.zeros(len(self.hash), np.int64)
        self._lookups: dict[int, tuple] = {}

    def weigh(self, df: dict[int, int]) -> None:
        n = np.array([df.get(int(h), 0) for h in self.hash.astype(np.int64)], np.float64)
        self.weight = np.floor(1000 * np.log((2.0 * self.total + 2) / (2 * n + 1))).astype(np.int64)

    def impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 50 + 50 * n * self.total // self.length
        return 1000000000 * tf // (1000 * tf + 20 * m)

    def lookup(self, bits: int) -> tuple:
        """(coordinates, offsets, items, weights): what falls on each coordinate of a sketch of that width."""
        if bits not in self._lookups:
            at = self.hash[self.term] & np.uint64((1 << bits) - 1)
            order = np.argsort(at, kind="stable")
            place, first = np.unique(at[order], return_index=True)
            self._lookups[bits] = (place, np.append(first, len(order)), self.item[order],
                                   self.weight[self.term][order].astype(np.float64))
        return self._lookups[bits]

    def sums(self, row, at, impact, bits: int, n_rows: int) -> np.ndarray:
        """(rows, items): weighted impacts of the entries added up."""
        place, ptr, item, weight = self.lookup(bits)
        if not len(place) or not len(at):
            return np.zeros((n_rows, self.size))
        k = np.minimum(np.searchsorted(place, at), len(place) - 1)
        on = place[k] == at
        k, row, impact = k[on], row[on], impact[on].astype(np.float64)
        many = ptr[k + 1] - ptr[k]
        own = np.repeat(np.arange(len(k)), many)
        pos = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + ptr[k][own]
        return np.bincount(row[own] * self.size + item[pos], impact[own] * weight[pos],
                           n_rows * self.size).reshape(n_rows, self.size)

    def scores(self, col: pa.Array, n: np.ndarray) -> np.ndarray:
        """(rows, items): exact scores of whole texts."""
        row, h, tf = term_counts(col)
        return self.sums(row, h, self.impact(tf, n[row]), 64, len(n))

    def bounds(self, b: pa.RecordBatch):
        """(row numbers, (rows, items) upper bounds) of the sketches of a batch, in parts."""
        n, bits = b.column("n").to_numpy(), b.column("bits").to_numpy()
        coords, ptr = _values(b.column("coords"), np.uint32)
        steps, _ = _values(b.column("steps"), np.uint8)
        for w in np.unique(bits):
            rows = np.flatnonzero(bits == w)
            ends = np.cumsum(ptr[rows + 1] - ptr[rows])
            at = 0
            while at < len(rows):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ENTRIES, "right")))
                some = rows[at:to]
                entry = np.concatenate([np.arange(ptr[r], ptr[r + 1]) for r in some])
                own = np.repeat(np.arange(len(some)), ptr[some + 1] - ptr[some])
                impact = self.impact(STEPS[steps[entry]], n[some][own])
                yield some, self.sums(own, coords[entry].astype(np.uint64), impact, int(w), len(some))
                at = to


def _highest(index: DataFrame, queries: Queries, top: int) -> DataFrame:
    """(item, doc_id, digest, bound): the documents of each task with the highest bounds for each item."""

    def read(batches):
        bound = np.zeros((0, queries.size))
        ref = np.zeros((0, queries.size), np.int64)
        ids: list = []
        for b in batches:
            doc, dig = b.column("doc_id").to_pylist(), b.column("digest").to_pylist()
            for some, got in queries.bounds(b):
                own = np.arange(len(ids), len(ids) + len(some))
                ids += [(doc[i], dig[i]) for i in some]
                bound = np.concatenate([bound, got])
                ref = np.concatenate([ref, np.broadcast_to(own[:, None], got.shape)])
                if len(bound) > top:
                    keep = np.argpartition(-bound, top - 1, axis=0)[:top]
                    bound, ref = np.take_along_axis(bound, keep, 0), np.take_along_axis(ref, keep, 0)
                if len(ids) > 1 << 18:  # forget documents that no item keeps
                    used, ref = np.unique(ref, return_inverse=True)
                    ref = ref.reshape(bound.shape)
                    ids = [ids[i] for i in used]
        r, q = np.nonzero(bound > 0)
        at = ref[r, q]
        yield pa.RecordBatch.from_arrays([
            pa.array(q, pa.int32()), pa.array([ids[i][0] for i in at], pa.int64()),
            pa.array([ids[i][1] for i in at], pa.int64()), pa.array(bound[r, q])], ["item", "doc_id", "digest", "bound"])

    return (index.select("doc_id", "digest", "n", "bits", "coords", "steps")
            .mapInArrow(read, "item int, doc_id long, digest long, bound double"))


def _best(df: DataFrame, by: str, top: int) -> DataFrame:
    """The ``top`` rows of each item, with their rank."""
    order = Window.partitionBy("item").orderBy(F.desc(by), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _thresholds(index: DataFrame, queries: Queries, top: int) -> np.ndarray:
    """Per item, the ``top``-th exact score among the documents of the highest bounds; 0 if there are fewer."""

    def read(batches):
        for b in batches:
            got = queries.scores(b.column("text"), b.column("n").to_numpy())
            r, q = np.nonzero(got > 0)
            doc = b.column("doc_id").take(pa.array(r))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), doc, pa.array(got[r, q].astype(np.int64))],
                                             ["item", "doc_id", "score"])

    seeds = _best(_highest(index, queries, top), "bound", top).select(
        F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).distinct()
    texts = index.join(F.broadcast(seeds), F.col("doc_id").eqNullSafe(F.col("_doc"))
                       & F.col("digest").eqNullSafe(F.col("_digest")), "left_semi").select("doc_id", "n", "text")
    scored = texts.mapInArrow(read, "item int, doc_id long, score long")
    out = np.zeros(queries.size)
    for r in _best(scored, "score", top).filter(F.col("rank") == top).collect():
        out[r["item"]] = r["score"]
    return out


def _descend(index: DataFrame, queries: Queries, least: np.ndarray, top: int) -> DataFrame:
    """(item, doc_id, score): exact scores, from the highest bound down to the threshold, best ``top`` a task."""

    def read(batches):
        floor = np.maximum(least, 1)
        held = [np.zeros((3, 0), np.int64)]  # item, score, doc_id (null: the largest)
        size = 0

        def cut():
            nonlocal held, size
            x = np.concatenate(held, axis=1)
            x = x[:, np.lexsort((x[2], -x[1], x[0]))]
            first = np.searchsorted(x[0], np.arange(queries.size))
            rank = np.arange(x.shape[1]) - first[x[0]]
            last = rank == top - 1
            floor[x[0, last]] = np.maximum(floor[x[0, last]], x[1, last])
            held, size = [x[:, rank < top]], 0

        for b in batches:
            n, text = b.column("n").to_numpy(), b.column("text")
            doc = b.column("doc_id").fill_null(NULL_LAST).to_numpy()
            for some, bound in queries.bounds(b):
                over = (bound - floor).max(axis=1)
                order = np.argsort(-over, kind="stable")
                order = order[over[order] >= 0]
                for a in range(0, len(order), ROWS):
                    at = order[a:a + ROWS]
                    at = at[(bound[at] >= floor).any(axis=1)]
                    if not len(at):
                        continue
                    got = queries.scores(text.take(pa.array(some[at])), n[some[at]])
                    r, q = np.nonzero(got >= floor)
                    held.append(np.stack([q, got[r, q].astype(np.int64), doc[some[at[r]]]]))
                    size += len(r)
                    if size > HELD:
                        cut()
        cut()
        x = held[0]
        yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.int32()), pa.array(x[2], pa.int64()),
                                          pa.array(x[1], pa.int64())], ["item", "doc_id", "score"])

    return (index.select("doc_id", "text", "n", "bits", "coords", "steps")
            .mapInArrow(read, "item int, doc_id long, score long")
            .withColumn("doc_id", F.when(F.col("doc_id") != NULL_LAST, F.col("doc_id"))))


NULL_LAST = (1 << 63) - 1


def _frequencies(index: DataFrame, hashes: np.ndarray) -> dict[int, int]:
    """Document frequency of the given terms, from the partial counts of all tasks."""

    def read(batches):
        for b in batches:
            for h, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, c = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)
                on = np.isin(h, hashes, assume_unique=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[on].view(np.int64)), pa.array(c[on])], ["term", "df"])

    found = (index.filter("terms is not null").select("terms", "counts").mapInArrow(read, "term long, df long")
             .groupBy("term").agg(F.sum("df").alias("df")))
    return {r["term"]: r["df"] for r in found.collect()}  # at most the terms of a block of items


def _item_terms(benchmark: DataFrame) -> DataFrame:
    """(item_id, terms): sorted term hashes of each row that has terms."""
    kind = T.StructType([benchmark.schema["item_id"], T.StructField("terms", T.BinaryType())])

    def read(batches):
        for b in batches:
            row, h, _ = term_counts(b.column(1))
            ptr = np.searchsorted(row, np.arange(len(b) + 1))
            full = pa.RecordBatch.from_arrays([b.column(0), _binaries(h, ptr)], ["item_id", "terms"])
            yield full.filter(pa.array(np.diff(ptr) > 0))

    return stored(benchmark.select("item_id", F.col("text").cast("string")).mapInArrow(read, kind), "item-terms")


def search(index: DataFrame, benchmark: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The ``top`` highest-scoring documents of each item: item_id, rank, doc_id, score."""
    spark = index.sparkSession
    prepare(spark)
    docs = index.filter("n is not null")
    total, length = docs.agg(F.count("*"), F.sum("n")).first()
    items = _item_terms(benchmark)
    kind = T.StructType([T.StructField("item", T.IntegerType()), benchmark.schema["item_id"]])
    out = spark.createDataFrame([], T.StructType([benchmark.schema["item_id"], T.StructField("rank", T.IntegerType()),
                                                  T.StructField("doc_id", T.LongType()),
                                                  T.StructField("score", T.LongType())]))
    blocks = -(-items.select("item_id").distinct().count() // block) if total else 0
    for at in range(blocks):
        merged: dict = {}
        for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == at).collect():
            merged.setdefault(r["item_id"], []).append(np.frombuffer(r["terms"], np.uint64))
        if not merged:
            continue
        queries = Queries([np.unique(np.concatenate(t)) for t in merged.values()], total, length)
        queries.weigh(_frequencies(index, queries.hash))
        least = _thresholds(docs, queries, top)
        found = _best(_descend(docs, queries, least, top), "score", top)
        names = spark.createDataFrame(list(enumerate(merged)), kind)  # at most the items of a block
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op11_max_sketch(spark, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
s as (select count(*) filter (len(w) > 0) as n_docs, sum(len(w))::bigint as n_terms from d),
q as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
  from benchmark),
tf as (
  select r, doc_id, len, t, count(*) as tf
  from (select r, doc_id, len(w) as len, unnest(w) as t from d) where t in (select t from q) group by all),
df as (select t, count(*) as df from tf group by t),
w as (
  select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from df, s),
i as (
  select r, doc_id, t, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len * n_docs) // n_terms)) as impact
  from tf, s),
x as (
  select item_id, r, doc_id, sum(w * impact)::bigint as score
  from q join w using (t) join i using (t) group by item_id, r, doc_id),
k as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
  from x where score > 0)
select item_id, rank::int as rank, doc_id, score from k where rank <= 50
"""
