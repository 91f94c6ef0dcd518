"""N-gram Jaccard join: blocked sparse product of documents by n-grams, with size bounds.

A document is the set of its distinct 5-word shingles; two link when
``100 * |x & y| >= 75 * |x | y|``. The incidence matrix A (documents by
shingles) is never multiplied in full. Entry (x, y) of A * A' matters only if
it reaches the bound that the two sizes give,

    overlap(x, y) >= ceil(75 * (|x| + |y|) / 175),   75 * max <= 100 * min,

and under any fixed order of the shingles a pair that reaches it shares a
shingle among the first ``|x| - ceil(0.75 * |x|) + 1`` of x and of y. So:

1. ``digests``: one pass over the texts gives every document's size and a
   128-bit digest of its set, and a fixed-size table of shingles that repeat,
   which orders shingles from rare to common. Equal sets become one class;
   only its smallest id goes on.
2. The first columns of each row (the rare shingles) are dealt by shingle:
   the blocks of the product. A column held by one class gives nothing. In
   the others every class is paired with the first class of its size range,
   not with every class: rows grow with the column, not with its square.
3. ``overlaps`` accumulates the exact counts of the candidate pairs and
   discards those below the bound. Links make components.
4. Within a column, classes still in different components are compared as
   well, except where the overlaps already known rule a link out (Jaccard
   distance obeys the triangle inequality). Columns whose classes lie in one
   component - all columns of a group of near copies - give nothing more.

The components are exact, and no group is expanded into its pairs for them;
``links`` returns links that connect every component, not all. The order in
step 1 affects speed only.

``counted`` adds the number of links of every document, all of them: within a
component the full sets are multiplied in blocks of rows, so that work grows
with the square of a component (of its different texts, not of its copies),
spread over the pairs of blocks. Counts are handed on, pairs are not.

Defined cases: null, empty or blank text has an empty set, size 0, and is its
own component; a text of fewer than five words is one shingle; a null doc_id
is treated as the smallest id and returned as null; rows repeating a doc_id
with equal texts are one document, with other texts they are linked through
the id; an empty table gives an empty result; other columns are not read. The
links of a row are the other texts (distinct doc_id and shingle set) that link
with its own; an empty set has none.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipway.llm.common import (
    BYTE_VALUES_LOWER, NO_ID, SPACE, free_name, mix64, pieces, prepare, span_hashes, spans, stored, table, utf8_arrays)

WORDS = 5
PERCENT = 75
# Rounds in which a class meets one hub each, before all remaining pairs are compared.
STARS = 2
# Ids that are sent to the texts, at most; more are joined by a shuffle.
ID_ROWS = 1 << 19
# Cells of the table that orders shingles: a fixed size, sent to all tasks.
ORDER_BITS = 20

# Pairs that a task adds up before it hands them on.
PAIR_BLOCK = 1 << 18
# Shingles among which a task looks for repeats at a time.
STRETCH = 1_000_000

# Classes and shingles in a block of rows of the product within a component, about.
BLOCK_CLASSES = 256
BLOCK_SHINGLES = 1 << 17
# Columns that give more pairs of two blocks than this are multiplied as dense ones.
DENSE_PAIRS = 1024
KEY = ["size", "d1", "d2"]  # of a class

ENTRY = "h long, id long, size int"

_MULT = mix64(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)


def min_overlap(a, b):
    """Smallest overlap that links sets of the given sizes."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def shingle_sets(col) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, concatenated, and row offsets."""
    data, offs = utf8_arrays(col)
    hashed, n = [np.zeros(0, np.uint64)], np.zeros(len(offs) - 1, np.int64)
    for r0, d, o in pieces(data, offs, ~SPACE):  # the bytes of a long text are never all at work at once
        starts, ends, at = spans(d, o, ~SPACE)
        hashed.append(span_hashes(d, starts, ends, BYTE_VALUES_LOWER))
        n[r0:r0 + len(o) - 1] += np.diff(at)
    words = np.concatenate(hashed)
    first = np.concatenate([[0], np.cumsum(n)])
    m = len(words)
    sh = np.zeros(m, np.uint64)
    for j in range(WORDS):
        if m > j:
            sh[:m - j] += words[j:] * _MULT[j]
    for i in np.flatnonzero((n > 0) & (n < WORDS)):  # too short: the whole sequence
        a, b = first[i], first[i + 1]
        sh[a] = (words[a:b] * _MULT[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
    sh = mix64(sh)
    out, size = [], np.zeros(len(n), np.int64)
    for i in np.flatnonzero(n):
        a, b = first[i], first[i + 1]
        u = np.unique(sh[a:max(a + 1, b - WORDS + 1)])
        out.append(u)
        size[i] = len(u)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(size)])


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Wrapping sum per row."""
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return s[ptr[1:]] - s[ptr[:-1]]


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text"))


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents in ``ids``: the ids go to the texts while their
    number, which is counted, stays below ``ID_ROWS``; above it both are shuffled."""
    if ids.count() <= ID_ROWS:
        ids = F.broadcast(ids)
    return _base(docs).join(ids, "id", "left_semi")


def digests(docs: DataFrame) -> DataFrame:
    """Rows (id, size, d1, d2, cells): a row per document, and rows of null id whose
    ``cells`` count shingles that repeat within a stretch of the input."""

    def run(batches):
        held: list[np.ndarray] = []
        n_held = 0

        def repeats():
            u, c = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            u, c = u[c > 1], c[c > 1]
            cells = (u >> np.uint64(64 - ORDER_BITS)).astype(np.int64)
            n = np.bincount(cells, c, 1 << ORDER_BITS).astype(np.int32) if len(cells) else np.zeros(0, np.int32)
            at = np.flatnonzero(n).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64()),
                 pa.array([None], pa.int64()), pa.array([at.tobytes()], pa.binary()),
                 pa.array([n[at].tobytes()], pa.binary())], ["id", "size", "d1", "d2", "cells", "n"])

        for b in batches:
            sets, ptr = shingle_sets(b.column(1))
            held.append(sets)
            n_held += len(sets)
            d1 = _sums(mix64(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), ptr)
            d2 = _sums(mix64(sets + np.uint64(0x1234567)), ptr)
            none = pa.nulls(len(b), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(ptr), pa.int64()), pa.array(d1.view(np.int64)),
                 pa.array(d2.view(np.int64)), none, none], ["id", "size", "d1", "d2", "cells", "n"])
            if n_held > STRETCH:
                yield repeats()
                held, n_held = [], 0
        if held:
            yield repeats()

    return _base(docs).mapInArrow(run, "id long, size long, d1 long, d2 long, cells binary, n binary")


def _order(marked: DataFrame) -> np.ndarray:
    """Table of ``2**ORDER_BITS`` ranks: how common the shingles of a cell are.

    Counts are added up per block of cells before one array leaves Spark.
    """
    def unpack(batches):
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for b in batches:
            for at, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int32)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["cell", "n"])

    def pack(batches):  # a task's cells in one row: the driver gets few
        at, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in batches:
            at.append(b.column(0).to_numpy())
            n.append(b.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in (at, n)],
                                         ["cell", "n"])

    rows = (marked.filter("cells is not null").select("cells", "n")
            .mapInArrow(unpack, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")))
    out = np.zeros(1 << ORDER_BITS, np.int64)
    for r in rows.mapInArrow(pack, "cell binary, n binary").toLocalIterator():
        out[np.frombuffer(r["cell"], np.int64)] = np.frombuffer(r["n"], np.int64)
    return np.minimum(out, (1 << 31) - 1).astype(np.int32)


def _entries(docs: DataFrame, classes: DataFrame, order: np.ndarray) -> DataFrame:
    """(shingle, id, size) for the first columns of every class, rare shingles first."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        rank = shared.value
        for b in batches:
            sets, ptr = shingle_sets(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            keep, own, size = [], [], []
            for i in range(len(ids)):
                s = sets[ptr[i]:ptr[i + 1]]
                k = len(s) - (PERCENT * len(s) + 99) // 100 + 1
                if len(s):
                    # by (rank, hash): sets are sorted, so a stable sort by rank is enough
                    keep.append(s[np.argsort(rank[(s >> np.uint64(64 - ORDER_BITS)).astype(np.int64)],
                                             kind="stable")[:k]])
                    own.append(np.full(k, ids[i], np.int64))
                    size.append(np.full(k, len(s), np.int32))
            if keep:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keep).view(np.int64)), pa.array(np.concatenate(own)),
                     pa.array(np.concatenate(size))], ["h", "id", "size"])

    return _only(docs, classes.select(F.col("rep").alias("id"))).mapInArrow(run, ENTRY)


def _columns(entries: DataFrame) -> DataFrame:
    """Entries of columns that more than one class holds."""

    def run(batches):
        last = None  # the latest row, while nothing of its column has gone out
        last_h = None
        for b in batches:
            if not len(b):
                continue
            h = b.column(0).to_numpy()
            same = np.empty(len(h), bool)  # as the row before
            same[1:] = h[1:] == h[:-1]
            same[0] = h[0] == last_h
            keep = same.copy()
            keep[:-1] |= same[1:]
            if same[0] and last is not None:
                yield last
            last_h, last = h[-1], None if keep[-1] else b.slice(len(b) - 1)
            yield b.filter(pa.array(keep))

    dealt = entries.repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, ENTRY)


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents in ``ids`` (column id)."""

    def run(batches):
        for b in batches:
            sets, ptr = shingle_sets(b.column(1))
            raw = sets.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([raw[8 * a:8 * c] for a, c in zip(ptr[:-1], ptr[1:])], pa.binary())],
                ["id", "shingles"])

    return _only(docs, ids).mapInArrow(run, "id long, shingles binary")


def overlaps(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, size_a, size_b, overlap) of the pairs (a, b), counted exactly."""
    pairs = stored(pairs, "pairs")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = stored(_sets_of(docs, ids), "sets")

    def run(batches):
        for b in batches:
            out = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                at[at == len(v)] = 0
                out.append((len(x) // 8, len(y) // 8, int((v[at] == u).sum())))
            arrays = [pa.array([o[k] for o in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), *arrays],
                                             ["a", "b", "size_a", "size_b", "overlap"])

    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return (pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
            .mapInArrow(run, "a long, b long, size_a long, size_b long, overlap long"))


def linked(size_a, size_b, overlap):
    return 100 * overlap >= PERCENT * (size_a + size_b - overlap)


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): smallest id reachable, for every id in ``edges`` (a, b).

    Alternating star contraction: each round joins every vertex to the
    smallest vertex it knows, until the edges form stars. Rounds grow with
    the logarithm of the longest path, and every step is an aggregation
    or a join by vertex.
    """
    e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v").distinct()
    e = stored(e, "edges")
    while True:
        # large star: greater neighbours of v move to the least vertex v knows
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = (both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")))
        large = large.distinct()
        # small star: smaller neighbours of v, and v, move to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(low, "v").filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        nxt = stored(moved.unionByName(low.select("v", F.col("m").alias("u"))).distinct(), "edges")
        # stars: every v has one u, and no u is itself a v
        many = nxt.groupBy("v").count().filter("count > 1").limit(1).count()
        if not many and not nxt.join(nxt.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            break
        e = nxt
    roots = nxt.select(F.col("u").alias("id")).distinct().select("id", F.col("id").alias("comp"))
    return nxt.select(F.col("v").alias("id"), F.col("u").alias("comp")).unionByName(roots)


def _least_shared(a, b):
    """Columns that linked sets of sizes a and b share among their first ones, at least."""
    need = F.ceil(PERCENT * (a + b) / (100 + PERCENT))
    return F.least(*(need - F.ceil(PERCENT * x / 100) + 1 for x in (a, b)))


def _open(columns: DataFrame, comps: DataFrame) -> DataFrame:
    """Entries with their component, of the columns that lie in more than one."""
    e = columns.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = e.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("h")
    return e.join(mixed, "h", "left_semi")


def _may_link(size_a, size_b, deg_a, deg_b):
    """False where one of two sets shares too few columns with any other to link."""
    return ((F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * PERCENT)
            & (F.least(deg_a, deg_b) >= _least_shared(size_a, size_b)))


def _star(entries: DataFrame, weight) -> DataFrame:
    """Pairs (a, b): each class b and the hub a with which it shares most columns.

    A column's hub is its entry of the largest ``weight``; one pair a class,
    whatever the width of the columns.
    """
    hubs = entries.groupBy("h").agg(F.max_by(F.struct("id", "size", "comp", "deg"), F.struct(weight, "id")).alias("hub"))
    return (entries.join(hubs, "h").filter("comp <> hub.comp")
            .filter(_may_link(F.col("size"), F.col("hub.size"), F.col("deg"), F.col("hub.deg")))
            .groupBy("id", "hub").agg(F.count("*").alias("n"))
            .groupBy("id").agg(F.max_by("hub.id", F.struct("n", "hub.id")).alias("a"))
            .select("a", F.col("id").alias("b")))


def _rest(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) in different components that may still link: they share as many
    of the columns as their sizes demand, and no known overlap rules them out."""
    star = (known.select(F.col("a").alias("hub"), F.col("b").alias("id"),
                         (1 - F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))).alias("dist"))
            .groupBy("id").agg(F.min_by(F.struct("hub", "dist"), "dist").alias("near")))
    # No pair of a class shares more columns than the class has open ones.
    deg = entries.groupBy("id").agg(F.count("*").cast("int").alias("deg"))
    e = (entries.join(deg, "id").join(star, "id", "left")
         .select("h", "id", "size", "comp", "deg", F.coalesce("near.hub", "id").alias("hub"),
                 F.coalesce("near.dist", F.lit(0.0)).alias("dist")))
    reach = 1 - PERCENT / 100 + 1e-9

    def pairs(g):
        """Pairs of whole columns: the rows at distance 1, then 2, ... of each other."""
        h, ids, size, comp, deg, hub = (g[c].to_numpy(np.int64) for c in ("h", "id", "size", "comp", "deg", "hub"))
        dist = g["dist"].to_numpy(np.float64)
        # columns that a pair of overlap o has in common, at least: o - less
        less = -(-PERCENT * size // 100) - 1
        i, step = np.arange(len(h)), 0
        while len(i):
            step += 1
            i = i[i + step < len(h)]
            j = i + step
            near = (h[j] == h[i]) & (PERCENT * size[j] <= 100 * size[i])  # rows are in order of size
            i, j = i[near], j[near]
            need = min_overlap(size[i], size[j])
            on = ((comp[j] != comp[i])
                  & (np.minimum(deg[i], deg[j]) >= need - np.maximum(less[i], less[j]))
                  & ~((hub[j] == hub[i]) & (np.abs(dist[j] - dist[i]) > reach)))
            if on.any():
                x, y = i[on], j[on]
                swap = ids[y] < ids[x]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                yield np.stack([ids[x], ids[y], size[x], size[y]])

    def summed(parts):
        """The task's share of the product as sparse rows: per a, its b's and their counts."""
        rows = np.concatenate(parts, axis=1)
        rows = rows[:, np.lexsort(rows[1::-1])]
        first = np.flatnonzero(np.append(True, (np.diff(rows[:2], axis=1) != 0).any(axis=0)))
        n = np.diff(np.append(first, rows.shape[1]))
        a, b, size_a, size_b = rows[:, first]
        at = np.flatnonzero(np.append(True, np.diff(a) != 0))
        cut = lambda x: [x[u:v].tobytes() for u, v in zip(at, np.append(at[1:], len(a)))]
        return pd.DataFrame({"a": a[at], "size_a": size_a[at], "b": cut(b), "size_b": cut(size_b), "n": cut(n)})

    def merge(frames):
        """Add up the rows of each a; keep the pairs that share enough columns."""
        held = None
        for frame in itertools.chain(frames, [None]):
            if frame is not None:
                frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
                if not len(frame):
                    continue
                last = frame["a"].iloc[-1]
                done, held = frame[frame["a"] != last], frame[frame["a"] == last]
            else:
                done = held if held is not None else []
            out = []
            for a, g in done.groupby("a", sort=False) if len(done) else ():
                b, size, n = (np.frombuffer(b"".join(g[c]), np.int64) for c in ("b", "size_b", "n"))
                u, at, inv = np.unique(b, return_index=True, return_inverse=True)
                n, size, own = np.bincount(inv, n), size[at], int(g["size_a"].iloc[0])
                less = np.maximum(-(-PERCENT * size // 100), -(-PERCENT * own // 100)) - 1
                u = u[n >= min_overlap(own, size) - less]
                if len(u):
                    out.append(pd.DataFrame({"a": a, "b": u}))
            if out:
                yield pd.concat(out)

    def run(frames):
        held, parts, waiting = [], [], 0  # held: rows of the column that is still open
        for frame in itertools.chain(frames, [None]):
            if frame is None:
                done = pd.concat(held) if held else None
            elif not len(frame):
                continue
            else:
                h = frame["h"].to_numpy()
                cut = np.searchsorted(h, h[-1])
                if cut or held and held[-1]["h"].iloc[-1] != h[-1]:
                    done, held = pd.concat([*held, frame.iloc[:cut]]), [frame.iloc[cut:]]
                else:
                    held.append(frame)
                    continue
            for p in pairs(done) if done is not None else ():
                parts.append(p)
                waiting += p.shape[1]
                if waiting > PAIR_BLOCK:
                    yield summed(parts)
                    parts, waiting = [], 0
        if parts:
            yield summed(parts)

    found = (e.repartition("h").sortWithinPartitions("h", "size", "id")
             .mapInPandas(run, "a long, size_a long, b binary, size_b binary, n binary")
             .repartition("a").sortWithinPartitions("a").mapInPandas(merge, "a long, b long"))
    return found.join(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, size, d1, d2, rep) of every document, and links (a, b)
    between class representatives that connect every component."""
    prepare(docs.sparkSession)
    marked = stored(digests(docs), "digests")
    own = marked.filter("size is not null").select("id", "size", "d1", "d2")
    classes = stored(own.filter("size > 0").groupBy("size", "d1", "d2").agg(F.min("id").alias("rep")), "classes")
    members = (own.join(classes, KEY, "left")
               .select("id", *KEY, F.coalesce("rep", "id").alias("rep")))
    columns = stored(_columns(_entries(docs, classes, _order(marked))), "columns")
    # The text that copies were made from has few columns of its own: the larger
    # the share of a class's columns that others hold, the better a hub it is.
    deg = columns.groupBy("id").agg(F.count("*").alias("deg"))
    share = columns.join(deg, "id")
    test = linked(F.col("size_a"), F.col("size_b"), F.col("overlap"))
    known = found = comps = None
    for r in range(STARS):
        e = share.withColumn("comp", F.col("id")) if comps is None else stored(_open(share, comps), "open")
        weight = F.col("deg") / F.col("size") if r == 0 else F.xxhash64("id", F.lit(r))
        more = overlaps(_star(e, weight), docs)
        known = stored(more if known is None else known.unionByName(more), "overlaps")
        found = known.filter(test).select("a", "b")
        comps = stored(components(found), "comps")
    rest = overlaps(_rest(_open(columns, comps), known), docs).filter(test).select("a", "b")
    return members, stored(found.unionByName(rest), "links")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, comps): members as in ``links``, and the component of every class that links or is tied."""
    members, found = links(docs)
    # A row that repeats an id with another text ties its classes together.
    tied = (members.filter("size > 0").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
            .filter("a <> b").select("a", "b"))
    return members, components(found.unionByName(tied)).select(F.col("id").alias("rep"), "comp")


def groups(docs: DataFrame) -> DataFrame:
    """(id, size, comp) of every document: the near-duplicate groups."""
    members, comps = _grouped(docs)
    return members.join(comps, "rep", "left").select("id", "size", F.coalesce("comp", "rep").alias("comp"))


def _blocks(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``classes`` (comp, blk, n_blk, rep, weight, key) in a row per block: the sets as
    a sparse matrix of its own columns."""

    def sets_of(batches):
        for b in batches:
            sets, ptr = shingle_sets(b.column(1))
            raw = sets.tobytes()
            d1 = _sums(mix64(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), ptr)
            d2 = _sums(mix64(sets + np.uint64(0x1234567)), ptr)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(ptr), pa.int64()), pa.array(d1.view(np.int64)),
                 pa.array(d2.view(np.int64)),
                 pa.array([raw[8 * x:8 * y] for x, y in zip(ptr[:-1], ptr[1:])], pa.binary())],
                ["rep", *KEY, "shingles"])

    def packed(key, rows):
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        cols, at = np.unique(np.concatenate(sets), return_inverse=True)
        own = np.array([[r[c] for c in (*KEY, "weight")] for r in rows], np.int64).T
        return dict(zip(("comp", "blk", "n_blk"), key), own=np.ascontiguousarray(own).tobytes(),
                    cols=cols.tobytes(), at=at.astype(np.uint32).tobytes())

    def run(batches):
        last, key, rows = None, None, []
        for b in batches:
            for r in b.to_pylist():
                k, own = tuple(r[c] for c in ("comp", "blk", "n_blk")), tuple(r[c] for c in KEY)
                if rows and k != key:
                    yield pa.RecordBatch.from_pylist([packed(key, rows)], schema=out)
                    rows, last = [], None
                key = k
                if own != last:  # a text may be there in several rows
                    rows.append(r)
                last = own
        if rows:
            yield pa.RecordBatch.from_pylist([packed(key, rows)], schema=out)

    out = pa.schema([("comp", pa.int64()), ("blk", pa.int32()), ("n_blk", pa.int32()), ("own", pa.binary()),
                     ("cols", pa.binary()), ("at", pa.binary())])
    sets = (_only(docs, classes.select(F.col("rep").alias("id")).distinct())
            .mapInArrow(sets_of, "rep long, size long, d1 long, d2 long, shingles binary"))
    return (classes.join(sets, ["rep", *KEY]).repartition("comp", "blk").sortWithinPartitions("comp", "blk", *KEY)
            .mapInArrow(run, "comp long, blk int, n_blk int, own binary, cols binary, at binary"))


def _product(x: tuple, y: tuple) -> np.ndarray:
    """Overlaps of the rows of two blocks, each (sizes, columns, column of every entry)."""
    (size_x, cols_x, at_x), (size_y, cols_y, at_y) = x, y
    _, in_x, in_y = np.intersect1d(cols_x, cols_y, assume_unique=True, return_indices=True)
    m = len(in_x)

    def entries(size, cols, at, used):
        """Row and common column of every entry in a common column, in order of column."""
        new = np.full(len(cols), -1)
        new[used] = np.arange(m)
        col, row = new[at], np.repeat(np.arange(len(size)), size)
        row, col = row[col >= 0], col[col >= 0]
        order = np.argsort(col, kind="stable")
        return row[order], col[order], np.bincount(col, minlength=m)

    row_x, col_x, n_x = entries(size_x, cols_x, at_x, in_x)
    row_y, col_y, n_y = entries(size_y, cols_y, at_y, in_y)
    out = np.zeros((len(size_x), len(size_y)), np.int64)
    dense = np.flatnonzero(n_x * n_y > DENSE_PAIRS)
    place = np.full(m, -1)
    place[dense] = np.arange(len(dense))
    for lo in range(0, len(dense), 4096):
        part = []
        for row, col, size in ((row_x, col_x, size_x), (row_y, col_y, size_y)):
            on = (place[col] >= lo) & (place[col] < lo + 4096)
            a = np.zeros((len(size), min(4096, len(dense) - lo)), np.float32)
            a[row[on], place[col[on]] - lo] = 1
            part.append(a)
        out += np.rint(part[0] @ part[1].T).astype(np.int64)
    # The other columns: every entry of x with all of y in its column.
    rare = place[col_x] < 0
    row, col = row_x[rare], col_x[rare]
    first = np.concatenate([[0], np.cumsum(n_y)])
    upto = np.cumsum(n_y[col])
    flat = out.reshape(-1)
    lo = 0
    while lo < len(col):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + (1 << 22), "right")))
        n = n_y[col[lo:hi]]
        j = np.repeat(first[col[lo:hi]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        flat += np.bincount(np.repeat(row[lo:hi], n) * len(size_y) + row_y[j], minlength=len(flat))
        lo = hi
    return out


def _link_numbers(blocks: DataFrame) -> DataFrame:
    """(size, d1, d2, n): the documents of other classes that link with the class."""
    schema = "size long, d1 long, d2 long, n long"

    def block(b, k, names):
        own, cols, at = (b.column(c)[k].as_py() for c in names)
        own = np.frombuffer(own, np.int64).reshape(4, -1)
        return own, (own[0], np.frombuffer(cols, np.uint64), np.frombuffer(at, np.uint32))

    def batch(own, n):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*own[:3], n)], [*KEY, "n"])

    def within(batches):
        for b in batches:
            for k in range(len(b)):
                own, x = block(b, k, ("own", "cols", "at"))
                on = linked(x[0][:, None], x[0], _product(x, x))
                np.fill_diagonal(on, False)
                yield batch(own, on @ own[3])

    def across(batches):
        for b in batches:
            for k in range(len(b)):
                own, x = block(b, k, ("own", "cols", "at"))
                other, y = block(b, k, ("own_y", "cols_y", "at_y"))
                on = linked(x[0][:, None], y[0], _product(x, y))
                yield batch(own, on @ other[3])
                yield batch(other, own[3] @ on)

    many = blocks.filter("n_blk > 1")
    x = (many.filter("blk < n_blk - 1")
         .select("comp", F.col("blk").alias("i"), F.expr("explode(sequence(blk + 1, n_blk - 1)) j"), "own", "cols", "at"))
    y = many.filter("blk > 0").select("comp", F.expr("explode(sequence(0, blk - 1)) i"), F.col("blk").alias("j"),
                                      *(F.col(c).alias(f"{c}_y") for c in ("own", "cols", "at")))
    found = (blocks.select("own", "cols", "at").mapInArrow(within, schema)
             .unionByName(x.join(y, ["comp", "i", "j"]).drop("comp", "i", "j").mapInArrow(across, schema)))
    return found.groupBy(*KEY).agg(F.sum("n").alias("n"))


def counted(docs: DataFrame) -> DataFrame:
    """(id, size, comp, n_links) of every document: its group and the number of its links."""
    members, comps = _grouped(docs)
    members, comps = stored(members, "members"), stored(comps, "comps")
    classes = stored(members.filter("size > 0").groupBy(*KEY)
                     .agg(F.min("rep").alias("rep"), F.countDistinct("id").alias("weight")), "weights")
    c = classes.join(comps, "rep")
    n_blk = F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    dealt = (c.join(c.groupBy("comp").agg(n_blk.alias("n_blk")), "comp")
             .withColumn("blk", F.pmod(F.xxhash64(*KEY), F.col("n_blk")).cast("int")))
    numbers = _link_numbers(stored(_blocks(docs, stored(dealt, "dealt")), "blocks"))
    of = classes.join(numbers, KEY, "left").select(*KEY, (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    return (members.join(comps, "rep", "left").join(of, KEY, "left")
            .select("id", "size", F.coalesce("comp", "rep").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links")))


def _null_id(c):
    return F.when(c != NO_ID, c)


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    g = counted(table(spark, sf_dir, "documents"))
    return g.select(_null_id(F.col("id")).alias("doc_id"), F.col("size").alias("n_shingles"),
                    _null_id(F.col("comp")).alias("component_id"), "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for all documents of a group save its smallest id."""
    name = free_name(docs, "gone")
    gone = groups(docs).filter("id <> comp").select(F.col("id").alias(name)).distinct()
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.join(gone, key == F.col(name), "left_anti")
