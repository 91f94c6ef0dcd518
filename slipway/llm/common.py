"""Shared helpers: table reads, stored intermediates, and array views of Arrow text."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipway.session import ensure_checkpoint_dir

# Rows in one Arrow batch. A batch is the unit of memory of every Python
# step here, and documents can be long, so it is far below Spark's default.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20

# Bytes of text that are split into words and hashed at a time.
PIECE = 1 << 20

# Stands for a null id where a key must not be null.
NO_ID = -(1 << 63)

U64 = np.uint64


def prepare(spark: SparkSession) -> None:
    """Session settings the Python steps rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once into the shared checkpoint folder and read back.

    Cuts lineage and survives lost executors; the folder is the one the
    session names in ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text modulo ``m``; a null id gives null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(m))


def utf8_arrays(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    _, off, data = col.buffers()
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    o = np.frombuffer(off, width)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    if data is None or o[-1] == o[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0]:o[-1]], o - o[0]


def byte_set(spec) -> np.ndarray:
    """bool[256] that is true at the given byte values."""
    out = np.zeros(256, bool)
    out[list(spec)] = True
    return out


SPACE = byte_set([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray):
    """Maximal runs of bytes in ``inside`` (bool[256]) that do not cross rows.

    Returns starts, ends and, per row, the offset of its first run.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[offs] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:n]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def pieces(data: np.ndarray, offs: np.ndarray, inside: np.ndarray, limit: int = PIECE):
    """(first row, bytes, row offsets) of stretches of about ``limit`` bytes that cut no run of ``inside``."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + limit)
        if b < n:
            free = np.flatnonzero(~inside[data[a:b]])
            c = max(a + int(free[-1]) + 1 if len(free) else a, int(offs[np.searchsorted(offs, b, "right") - 1]))
            while c <= a:  # one run longer than the limit
                to = min(n, b + limit)
                free = np.flatnonzero(~inside[data[b:to]])
                ends = [b + int(free[0]) + 1] if len(free) else []
                border = int(offs[np.searchsorted(offs, b, "left")])
                c = min([*ends, border]) if ends or border <= to or to == n else a
                b = to
            b = c
        r0, r1 = int(np.searchsorted(offs, a, "right")) - 1, int(np.searchsorted(offs, b, "left"))
        yield r0, data[a:b], np.clip(offs[r0:r1 + 1], a, b) - a
        a = b


def mix64(h: np.ndarray) -> np.ndarray:
    """Bit mixer over uint64 (wraps)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        m = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(m, base, U64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=U64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=U64))
BYTE_VALUES = _BYTE_VALUES
BYTE_VALUES_LOWER = _BYTE_VALUES[LOWER]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, from one running sum over the bytes.

    ``values`` gives each byte's number, so folding case is a matter of the
    table. Equal spans get equal hashes wherever they lie.
    """
    n = len(data)
    up, down = _powers(max(n, 1))
    s = np.zeros(n + 1, U64)
    np.cumsum(values[data] * up[:n], out=s[1:])
    h = (s[ends] - s[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def row_of(offs: np.ndarray) -> np.ndarray:
    """Row number of each element under row offsets."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))
