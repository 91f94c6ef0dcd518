"""Line dedup: sharded cuckoo filters over exact reference-count tables.

A line's key is the line with blanks (space, \\t..\\r) stripped at both ends
and A-Z lower-cased, hashed to 128 bits; keys shorter than ``MIN_CHARS``
code points take no part. The state has two tables, sharded by key:

* ``refs``: exact, one row (shard, key, doc_id) per key and document holding it;
* ``filters``: one row per shard, a cuckoo filter (buckets of 4 fingerprints
  of 32 bits) of the shard's *repeated* keys, those with ``MIN_DOCS`` or more
  references.

``insert`` and ``delete`` change ``refs`` and put into or take out of the
filters the keys that cross the bound, so deleting documents restores the
state that never saw them. ``dropped`` reads texts, asks the filters first
(no false negatives), and joins only the positives with the exact counts,
which remove the false positives.

Filters are broadcast to the tasks while their bytes, known exactly from the
state, stay below ``FILTER_BYTES``; above it every line goes to the exact
join and the result is the same. Counting is a two-step aggregation (distinct
(key, doc), then per key), so a line that a third of all documents hold is
combined before the shuffle.

Defined cases: null or empty text is one empty line; a null doc_id is a
document smaller than all others; rows that repeat a doc_id are one document;
repeated lines of a document count once and all of them stay or go together;
an empty table gives an empty result; other columns pass through ``rewrite``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipway.llm.common import LOWER, NO_ID, SPACE, mix64, prepare, spans, stored, table, utf8_arrays

MIN_CHARS = 20
MIN_DOCS = 3
SHARDS = 32
FILTER_BYTES = 64 << 20
SLOTS = 4
LOAD = 0.8
KICKS = 500

REFS = "shard int, key binary, doc_id long"
FILTERS = "shard int, n_keys long, filter binary"


# ---- the filter of one shard -------------------------------------------------

def _fingerprints(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, hash for the bucket) of 16-byte keys; a fingerprint is never 0."""
    halves = keys.view(np.uint64).reshape(-1, 2)
    fp = (halves[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return np.maximum(fp, np.uint32(1)), halves[:, 0]


class Cuckoo:
    """Cuckoo filter; ``table`` is (buckets, SLOTS) of fingerprints, 0 is free."""

    def __init__(self, table: np.ndarray, n_keys: int = 0):
        self.table, self.n_keys, self.mask = table, n_keys, np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, n_keys: int) -> Cuckoo:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(n_keys, 1) / (SLOTS * LOAD) + 1))))
        return cls(np.zeros((buckets, SLOTS), np.uint32))

    @classmethod
    def load(cls, data: bytes, n_keys: int) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint32).reshape(-1, SLOTS).copy(), n_keys)

    def dump(self) -> bytes:
        return self.table.tobytes()

    def fits(self, more: int) -> bool:
        return self.n_keys + more <= LOAD * self.table.size

    def _other(self, fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return (bucket ^ mix64(fp.astype(np.uint64))) & self.mask

    def _buckets(self, keys: np.ndarray):
        fp, h = _fingerprints(keys)
        one = h & self.mask
        return fp, one, self._other(fp, one)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, one, two = self._buckets(keys)
        return ((self.table[one] == fp[:, None]) | (self.table[two] == fp[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if a key finds no place; the caller then builds a larger filter."""
        for fp, one, two in zip(*self._buckets(keys)):
            for b in (one, two):
                free = np.flatnonzero(self.table[b] == 0)
                if len(free):
                    self.table[b, free[0]] = fp
                    break
            else:
                b = one
                for kick in range(KICKS):
                    slot = (kick + int(fp)) % SLOTS
                    fp, self.table[b, slot] = self.table[b, slot], fp
                    b = self._other(np.array([fp]), np.array([b]))[0]
                    free = np.flatnonzero(self.table[b] == 0)
                    if len(free):
                        self.table[b, free[0]] = fp
                        break
                else:
                    return False
            self.n_keys += 1
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that were inserted before."""
        for fp, one, two in zip(*self._buckets(keys)):
            for b in (one, two):
                at = np.flatnonzero(self.table[b] == fp)
                if len(at):
                    self.table[b, at[0]] = 0
                    self.n_keys -= 1
                    break


# ---- lines of texts ----------------------------------------------------------

def line_keys(col) -> tuple[np.ndarray, np.ndarray]:
    """16-byte keys of all lines of a string column (b"" where the line takes
    no part), and the offset of each row's first line."""
    data, offs = utf8_arrays(col)
    n = len(data)
    nl = np.flatnonzero(data == 10)
    rows = np.searchsorted(offs, nl, side="right") - 1
    n_lines = 1 + np.bincount(rows, minlength=len(offs) - 1)
    first = np.concatenate([[0], np.cumsum(n_lines)]).astype(np.int64)
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    at = np.arange(len(nl)) + rows  # the line that each newline ends
    ends[at], starts[at + 1] = nl, nl + 1
    starts[first[:-1]], ends[first[1:] - 1] = offs[:-1], offs[1:]
    ink = np.flatnonzero(~SPACE[data])
    a, b = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
    some = a < b
    s, e = starts.copy(), starts.copy()
    s[some], e[some] = ink[a[some]], ink[b[some] - 1] + 1
    lead = np.zeros(n + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    long = lead[e] - lead[s] >= MIN_CHARS
    low, out = LOWER[data].tobytes(), np.full(first[-1], b"", object)
    for i in np.flatnonzero(long):
        out[i] = hashlib.blake2b(low[s[i]:e[i]], digest_size=16).digest()
    return out, first


def _shard(key: bytes) -> int:
    return key[15] % SHARDS


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
                       F.col("text").alias("_text"))


def _refs(docs: DataFrame, filters=None) -> DataFrame:
    """Distinct (shard, key, doc_id) of the lines; with ``filters`` only of those they let pass."""

    def split(batches):
        own = None
        if filters is not None:
            own = {s: Cuckoo.load(f, n) for s, n, f in filters.value}
        for b in batches:
            keys, first = line_keys(b.column(1))
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), np.diff(first))
            some = np.array([k != b"" for k in keys], bool)
            keys, ids = keys[some], ids[some]
            shard = np.array([_shard(k) for k in keys], np.int32)
            if own is not None and len(keys):
                hit = np.zeros(len(keys), bool)
                packed = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
                for s in np.unique(shard):
                    if s in own:
                        at = np.flatnonzero(shard == s)
                        hit[at] = own[s].contains(np.ascontiguousarray(packed[at]))
                keys, ids, shard = keys[hit], ids[hit], shard[hit]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(list(keys), pa.binary()),
                                              pa.array(ids, pa.int64())], ["shard", "key", "doc_id"])

    return _ids(docs).mapInArrow(split, REFS).distinct()


# ---- the state ---------------------------------------------------------------

def counts(refs: DataFrame) -> DataFrame:
    """Exact reference counts: (shard, key, n_docs, keeper)."""
    return refs.groupBy("shard", "key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


def _repeated(refs: DataFrame) -> DataFrame:
    return counts(refs).filter(F.col("n_docs") >= MIN_DOCS)


def _change(filters: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Filters after the keys that left ``before`` went out and those new in ``after`` came in."""
    marks = (before.select("shard", "key", F.lit(1).alias("was"), F.lit(0).alias("is"))
             .unionByName(after.select("shard", "key", F.lit(0).alias("was"), F.lit(1).alias("is")))
             .groupBy("shard", "key").agg(F.max("was").alias("was"), F.max("is").alias("is")))

    def change(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        shard = int(old["shard"].iloc[0] if len(old) else keys["shard"].iloc[0])
        pack = lambda x: np.frombuffer(b"".join(map(bytes, x)), np.uint8).reshape(-1, 16)
        now = pack(keys["key"][keys["is"] == 1])
        out = pack(keys["key"][(keys["was"] == 1) & (keys["is"] == 0)])
        new = pack(keys["key"][(keys["was"] == 0) & (keys["is"] == 1)])
        f = Cuckoo.load(old["filter"].iloc[0], int(old["n_keys"].iloc[0])) if len(old) else Cuckoo.sized(len(new))
        f.delete(out)
        size = len(now)
        if not f.fits(len(new)) or not f.insert(new):
            while True:  # from the exact keys, with more room each time
                f = Cuckoo.sized(size)
                if f.insert(now):
                    break
                size = size * 2 + 1
        return pd.DataFrame({"shard": [shard], "n_keys": [f.n_keys], "filter": [f.dump()]})

    return (filters.groupBy("shard").cogroup(marks.groupBy("shard")).applyInPandas(change, FILTERS))


def empty_state(spark) -> dict[str, DataFrame]:
    return {"refs": spark.createDataFrame([], REFS), "filters": spark.createDataFrame([], FILTERS)}


def insert(state: dict[str, DataFrame], docs: DataFrame) -> dict[str, DataFrame]:
    """The state after ``docs`` came in (a document already in it changes nothing)."""
    prepare(docs.sparkSession)
    refs = stored(state["refs"].unionByName(_refs(docs)).distinct(), "line-refs")
    return {"refs": refs, "filters": stored(_change(state["filters"], _repeated(state["refs"]), _repeated(refs)),
                                            "line-filters")}


def delete(state: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """The state without the documents in ``doc_ids`` (column doc_id)."""
    ids = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct()
    refs = stored(state["refs"].join(ids, "doc_id", "left_anti").select("shard", "key", "doc_id"), "line-refs")
    return {"refs": refs, "filters": stored(_change(state["filters"], _repeated(state["refs"]), _repeated(refs)),
                                            "line-filters")}


def dropped(state: dict[str, DataFrame], docs: DataFrame) -> DataFrame:
    """(_id, _keys): per document of ``docs`` the keys whose lines it loses."""
    size = state["filters"].agg(F.sum(F.length("filter"))).first()[0] or 0
    filters = None
    if size <= FILTER_BYTES:
        rows = [(r["shard"], r["n_keys"], bytes(r["filter"])) for r in state["filters"].collect()]
        filters = docs.sparkSession.sparkContext.broadcast(rows)
    maybe = _refs(docs, filters)
    known = _repeated(state["refs"]).select("key", "keeper")
    return (maybe.join(known, "key").filter(F.col("doc_id") != F.col("keeper"))
            .groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("key").alias("_keys")))


def _apply(docs: DataFrame, drops: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with _text replaced by the kept lines, _n_lines and _n_dropped."""
    d = docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
                    F.col("text").alias("_text"))
    joined = d.join(drops, "_id", "left").select(*columns, "_text", "_keys")
    schema = d.select(*columns).schema.add("_kept", "string").add("_n_lines", "long").add("_n_dropped", "long")

    def cut(batches):
        for b in batches:
            texts, lose = b.column("_text").to_pylist(), b.column("_keys").to_pylist()
            keys, first = None, None
            kept, n_lines, n_dropped = [], [], []
            for i, (t, gone) in enumerate(zip(texts, lose)):
                t = t or ""
                if not gone:
                    kept.append(t)
                    n_lines.append(t.count("\n") + 1)
                    n_dropped.append(0)
                    continue
                if keys is None:
                    keys, first = line_keys(b.column("_text"))
                gone, lines = set(gone), t.split("\n")
                stay = [x for x, k in zip(lines, keys[first[i]:first[i + 1]]) if k not in gone]
                kept.append("\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in columns), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()),
                 pa.array(n_dropped, pa.int64())], [*columns, "_kept", "_n_lines", "_n_dropped"])

    return joined.mapInArrow(cut, schema)


def dedup(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Line dedup of a whole table; returns ``columns``, _kept, _n_lines, _n_dropped."""
    prepare(docs.sparkSession)
    state = insert(empty_state(docs.sparkSession), docs)
    return _apply(docs, dropped(state, docs), columns)


def rewrite(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, each text cut to its kept lines."""
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    i, t = names.index("doc_id"), names.index("text")
    rest = [f"_c{k}" for k in range(len(names)) if k != t]
    out = dedup(plain.withColumns({"doc_id": F.col(f"_c{i}"), "text": F.col(f"_c{t}")}), rest)
    kept = F.col("_kept")
    return out.select(*[(kept if k == t else F.col(f"_c{k}")).alias(n) for k, n in enumerate(names)])


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                      F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
l as (select r, doc_id, unnest(string_split(t, chr(10))) as line,
             unnest(range(len(string_split(t, chr(10))))) as pos from d),
k as (select *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key, max(doc_id) as keeper from k where length(key) >= 20
      group by key having count(distinct doc_id) >= 3),
m as (select k.*, c.key is not null and k.doc_id <> c.keeper as gone from k left join c using (key))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by r
"""
