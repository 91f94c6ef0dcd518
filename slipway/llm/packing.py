"""Best-two-fit packing of tokenized documents into sequences.

A document is the ids of its text by a public tokenizer file, then id 0.
Documents longer than a sequence are cut into pieces of ``SEQ`` tokens, the
last may be shorter; others stay whole. Pieces are then packed: each bin is
filled greedily with the longest piece that fits, and if room is left, its
smallest piece is exchanged for the two unpacked pieces that together fill
the widened gap best, if they fill it better than the piece did.

Packing looks at lengths alone. Groups of at most about ``GROUP`` pieces (by
a hash of the piece, so the number of groups follows the data) are packed
independently; each wastes at most its last few bins. A full piece is a
sequence of its own and is dealt among the groups as well.

Defined cases: null and empty texts are a single id 0; the order of repeated
rows is immaterial, each is packed; an empty table gives an empty result;
other columns are not read. Texts are encoded whole: chunks between blanks
are encoded once and remembered, which the tokenizer's rules allow because
none of its tokens contains a blank or a newline.
"""

from __future__ import annotations

import bisect
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipway.llm.common import prepare, stored, table

SEQ = 2048
GROUP = 200_000
END = b"\0\0\0\0"
CACHE = 400_000


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder(dict):
    """Chunk of text -> its ids as little-endian bytes; remembers up to CACHE chunks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)

    def __missing__(self, chunk: str) -> bytes:
        # A trailing comma or full stop after an ASCII letter is a token of its own,
        # and ASCII letters are lower-cased: both reuse what is known. Other letters
        # may be normalized into a letter and a mark, and mark and sign are one piece.
        if len(chunk) > 1 and chunk[-1] in ",." and chunk[-2].isascii() and chunk[-2].isalpha():
            ids = self[chunk[:-1]] + self[chunk[-1]]
        elif chunk.isascii() and chunk.isalpha() and not chunk.islower():
            ids = self[chunk.lower()]
        elif chunk.isascii() and chunk.isalpha():  # one word as it is: no rule but the merges applies
            ids = np.array([t.id for t in self.tok.model.tokenize(chunk)], "<u4").tobytes()
        else:
            ids = np.array(self.tok.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < CACHE:
            self[chunk] = ids
        return ids

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) + END


_ENCODERS: dict[str, Encoder] = {}  # one per worker process and file


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, columns: list[str], path: str | None = None, seq: int = SEQ,
           with_ids: bool = False) -> DataFrame:
    """``columns`` of each document and, per piece: piece, start, length, ids_crc32 (and ids)."""
    prepare(docs.sparkSession)
    path = path or tokenizer_path()
    src = docs.select(*columns, F.col("text").alias("_text"))
    schema = T.StructType([*src.select(*columns).schema.fields, T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema = schema.add("ids", "binary")

    def run(batches):
        enc = encoder(path)
        step = 4 * seq
        for b in batches:
            row, piece, length, crc, ids = [], [], [], [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                raw = enc.text(t) if t else END
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at:at + step]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            take = pa.array(row, pa.int64())
            p = np.array(piece, np.int64)
            arrays = [*(b.column(c).take(take) for c in columns), pa.array(p, pa.int32()), pa.array(p * seq),
                      pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                arrays.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return src.mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, seq: int = SEQ) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece of the given lengths (1 to ``seq``)."""
    order = np.argsort(lengths, kind="stable")
    sizes, first, count = np.unique(lengths[order], return_index=True, return_counts=True)
    stock = {int(s): order[f:f + c].tolist() for s, f, c in zip(sizes, first, count)}
    avail = sizes.tolist()  # lengths of which pieces are left, ascending
    bins, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(size):
        left = stock[size]
        piece = left.pop()
        if not left:
            del avail[bisect.bisect_left(avail, size)]
        return piece

    n = 0
    while avail:
        room, inside = seq, []
        while room and avail and avail[0] <= room:
            size = avail[bisect.bisect_right(avail, room) - 1]
            inside.append((size, take(size)))
            room -= size
        if room and avail:
            size, piece = inside[-1]  # filled in descending order: the smallest
            two = _two(avail, stock, room + size, size)
            if two:
                inside[-1:] = [(s, take(s)) for s in two]
                if size not in avail:
                    bisect.insort(avail, size)
                stock[size].append(piece)
        at = 0
        for size, piece in inside:
            bins[piece], offset[piece] = n, at
            at += size
        n += 1
    return bins, offset


def _two(avail: list[int], stock: dict, gap: int, more_than: int) -> tuple[int, int] | None:
    """Two available lengths with the largest sum within ``gap`` and above ``more_than``."""
    best, found = more_than, None
    lo, hi = 0, bisect.bisect_right(avail, gap) - 1
    while lo <= hi:
        total = avail[lo] + avail[hi]
        if total > gap:
            hi -= 1
            continue
        if total > best and (lo < hi or len(stock[avail[lo]]) > 1):
            best, found = total, (avail[hi], avail[lo])
            if best == gap:
                break
        lo += 1
    return found


def pack(parts: DataFrame, seq: int = SEQ, group: int = GROUP) -> DataFrame:
    """``parts`` (with a column length) and their sequence_id and offset."""
    parts = stored(parts, "pieces")
    n = max(1, -(-parts.count() // group))
    names = parts.columns
    # Rows are dealt by all their columns, so copies of a document spread as far as their ids do.
    dealt = parts.withColumn("_group", F.pmod(F.xxhash64(*names), F.lit(n)).cast("int"))
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = int(frame["_group"].iloc[0])
        frame = frame.sort_values([c for c in ("length", "doc_id", "piece") if c in names], kind="stable")
        bins, offset = best_two_fit(frame["length"].to_numpy(np.int64), seq)
        return frame[names].assign(sequence_id=bins * n + own, offset=offset)

    return dealt.groupBy("_group").applyInPandas(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_starts): the packed ids of pieces made ``with_ids``."""
    s = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return s.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
                    F.col("p.offset").alias("doc_starts"))


def op9_two_fit(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), ["doc_id"]))
