"""Resharding by minimum-cost flow: the fewest bytes move, affected files are rewritten.

The rows of each old shard are cut into at most ``BLOCKS`` blocks by a hash
of the row. Old shard sizes supply, the new capacities demand; a byte that
stays where it is costs nothing, one that moves costs one. A minimum-cost
flow (successive shortest paths over the shards, whose number is a
parameter) says how many bytes go from each old shard to each new one, and
the blocks of an old shard are dealt to its targets, largest first, to meet
those amounts. Only block totals reach the driver: shards x BLOCKS rows.

``rewrite`` then writes the shards that gain or lose rows, removes those that
end up empty and leaves the files of all others as they are. The query writes
its affected shards into the shared folder and reads its figures back from them.

Defined cases: null text has no bytes (size 1, crc of nothing); an empty
table gives an empty plan; rows are told apart by all of (doc_id, size, crc),
so repeated rows share a block and keep their own slots; a null doc_id is a
value like any other; other columns pass through ``assign``.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipway.llm.common import table
from slipway.session import ensure_checkpoint_dir

SHARDS = 16
OLD = 12
BLOCKS = 4096
# Rows of a file of a new shard, about.
FILE_ROWS = 1 << 13


def min_cost_flow(supply: list[int], demand: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j: cost 0 where i = j, else 1; total supply = total demand.

    Successive shortest paths (Bellman-Ford on the residual graph).
    """
    n, m = len(supply), len(demand)
    flow: dict[tuple[int, int], int] = {}
    left, need = list(supply), list(demand)
    cost = lambda i, j: 0 if i == j else 1
    while any(left) and any(need):
        far = 1 << 60
        dist = [0 if x else far for x in left] + [far] * m
        back: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] < far and dist[i] + cost(i, j) < dist[n + j]:
                        dist[n + j], back[n + j], changed = dist[i] + cost(i, j), i, True
                    if flow.get((i, j)) and dist[n + j] < far and dist[n + j] - cost(i, j) < dist[i]:
                        dist[i], back[i], changed = dist[n + j] - cost(i, j), n + j, True
        end = min((j for j in range(m) if need[j]), key=lambda j: dist[n + j])
        path, v = [], n + end
        while back[v] is not None:
            path.append((back[v], v))
            v = back[v]
        amount = min([left[v], need[end], *(flow[(b, a - n)] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[(a, b - n)] = flow.get((a, b - n), 0) + amount
            else:
                flow[(b, a - n)] -= amount
        left[v] -= amount
        need[end] -= amount
    return {k: f for k, f in flow.items() if f}


def _digest() -> tuple:
    """Size and crc of the column text."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return F.octet_length(raw).cast("long") + 1, F.crc32(raw)


def sized(docs: DataFrame, old) -> DataFrame:
    """``docs`` with _old, _size, _crc and _block."""
    size, crc = _digest()
    return (docs.withColumn("_old", old.cast("int")).withColumn("_size", size).withColumn("_crc", crc)
            .withColumn("_block", F.pmod(F.xxhash64("doc_id", "_size", "_crc"), F.lit(BLOCKS)).cast("int")))


def plan(rows: DataFrame, n_old: int, shares: list[float]) -> list[tuple[int, int, int, int, int]]:
    """(old shard, block, new shard, first slot, rows) of every block of ``sized`` rows."""
    got = rows.groupBy("_old", "_block").agg(F.sum("_size").alias("b"), F.count("*").alias("n")).collect()
    blocks: dict[int, list] = {i: [] for i in range(n_old)}
    for r in got:
        blocks[r["_old"]].append((r["b"], r["_block"], r["n"]))
    supply = [sum(b for b, _, _ in blocks[i]) for i in range(n_old)]
    total = sum(supply)
    edges = [round(total * sum(shares[:j]) / sum(shares)) for j in range(len(shares) + 1)]
    flow = min_cost_flow(supply, [b - a for a, b in zip(edges, edges[1:])])
    out, slots = [], [0] * len(shares)
    behind = [0.0] * len(shares)  # what a shard has got less than planned so far
    for i in range(n_old):
        targets = [(-(f + behind[j]), j) for (a, j), f in flow.items() if a == i]
        heapq.heapify(targets)
        for b, block, n in sorted(blocks[i], reverse=True):
            rest, j = heapq.heappop(targets)
            out.append((i, block, j, slots[j], n))
            slots[j] += n
            heapq.heappush(targets, (rest + b, j))
        for rest, j in targets:
            behind[j] = -rest
    return out


def assign(docs: DataFrame, old, n_old: int, shares: list[float]) -> DataFrame:
    """``docs`` with _old, _size, _crc, _shard and _slot (gapless from 0 in each new shard)."""
    rows = sized(docs, old)
    spark = docs.sparkSession
    moves = spark.createDataFrame([m[:4] for m in plan(rows, n_old, shares)],
                                  "_old int, _block int, _shard int, _first long")
    # Rows meet by new shard and file, each of whole blocks, so that a text is sent once and written there.
    place = Window.partitionBy("_shard", "_file", "_old", "_block").orderBy("doc_id", "_crc", "_size")
    # The plan has at most n_old * BLOCKS rows, hence the broadcast.
    return (rows.join(F.broadcast(moves), ["_old", "_block"])
            .withColumn("_file", F.expr(f"_first div {FILE_ROWS}")).repartition("_shard", "_file")
            .withColumn("_slot", F.col("_first") + F.row_number().over(place) - 1).drop("_first", "_block", "_file"))


def rewrite(assigned: DataFrame, path: str, names: list[str]) -> list[int]:
    """Write the shards under ``path`` (folders shard=N) that gain or lose rows; returns them.

    Shards that keep just their rows are not touched. New files are complete
    before old ones of a shard are replaced (dynamic partition overwrite), and
    before the folders of shards that lose all their rows are removed.
    """
    ways = [tuple(r) for r in assigned.select("_old", "_shard").distinct().collect()]
    hit = sorted({x for old, new in ways if old != new for x in (old, new)})
    rows = assigned.filter(F.col("_shard").isin(hit)) if hit else assigned.limit(0)
    (rows.select(*names, F.col("_shard").alias("shard")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path))
    # The overwrite replaces folders that receive rows only.
    sc = assigned.sparkSession.sparkContext
    for x in set(hit) - {new for _, new in ways}:
        folder = sc._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/shard={x}")
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
    return hit


def op4_mincost_reshard(spark, sf_dir: str) -> DataFrame:
    """From shards by source (as many as ``OLD``, of very unequal size) to 16 of equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(OLD))
    out = assign(docs, old, OLD, [1.0] * SHARDS)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/shards-{uuid.uuid4().hex}"
    hit = rewrite(out, path, ["doc_id", "text", "_old", "_slot"])
    now = spark.read.schema("doc_id long, text string, _old int, _slot long, shard int").parquet(path)
    if set(range(SHARDS)) - set(hit):  # shards that keep just their rows are where they were
        now = now.unionByName(out.filter(~F.col("_shard").isin(hit)).select(
            "doc_id", "text", "_old", "_slot", F.col("_shard").alias("shard")))
    size, crc = _digest()
    return now.select("doc_id", size.alias("size"), crc.alias("text_crc32"),
                      F.lit("bytes").alias("law"), "shard", F.col("_slot").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"), F.col("_old").alias("old_shard"))
