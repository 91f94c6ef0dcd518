"""Nearest neighbours by inner product: vantage-point trees per shard.

Vectors are lifted to one more dimension so that all have the length of the
longest: the largest inner product with a query is then the smallest
Euclidean distance, and the triangle inequality holds. Each shard (about
``SHARD_ROWS`` distinct vectors, by a hash) has one tree: a node holds a
vantage point and halves the other vectors by their distance to it, with the
range of distances on either side; leaves hold up to ``LEAF`` vectors, each
with its distances to all vantage points above it. A query is compared with
the vantage points it passes, enters the nearer side first, and skips a side,
or a vector of a leaf, if a distance bound times ``factor`` exceeds its k-th
best distance so far; for a vector the greatest bound of all its vantage
points counts. Factor 1 is exact search; larger factors skip more. How much a
factor costs depends on the vectors, so unless one is given each tree gets its
own when it is built: the largest of ``FACTORS`` at which ``TUNE_QUERIES`` of
its vectors find at least ``RECALL`` of what brute force over the shard finds.

Equal vectors are one entry that keeps its k + 1 smallest ids, which is all
that any answer can use, so a large group of copies costs one row. Queries
meet the shards in blocks of ``QUERY_ROWS``; every shard answers every block.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
numbers take no part, as queries or candidates; shorter vectors count as
padded with zeros; a null vec_id takes no part; rows repeating an id with the
same vector are one; with fewer candidates than k all are returned; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipway.llm.common import prepare, stored, table

K = 20
EVERY = 20
SHARD_ROWS = 8192
QUERY_ROWS = 4096
LEAF = 32
FACTORS = (5.0, 4.5, 4.0, 3.5, 3.0, 2.5, 2.0, 1.6, 1.3)  # then 1, the exact search
TUNE_QUERIES = 128  # a sample: at most so many vectors of a shard set its factor
RECALL = 0.96
SLACK = 1e-7  # of rounding, as a share of the lengths, so that ties are not skipped
SPARSE = 0.25  # below this share of a leaf's block its pairs are compared one by one


# ---- the tree of one shard ---------------------------------------------------

def build(ids: np.ndarray, x: np.ndarray, seed: int = 5) -> dict:
    """Tree over the rows of ``x``; rows are reordered so that a leaf is a stretch."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    norm = np.einsum("ij,ij->i", x, x)
    top = float(norm.max()) if len(x) else 0.0
    lifted = np.hstack([x, np.sqrt(np.maximum(top - norm, 0))[:, None]])
    rng = np.random.default_rng(seed)
    perm, nodes = [], []

    def grow(rows, above):
        """Node over ``rows``; ``above`` has their distances to each vantage point passed."""
        if len(rows) <= LEAF:
            nodes.append(("leaf", len(perm), len(perm) + len(rows), above))
            perm.extend(rows.tolist())
            return len(nodes) - 1
        pick = rng.integers(len(rows))
        point, place = lifted[rows[pick]], len(perm)
        perm.append(rows[pick])
        rows, above = np.delete(rows, pick), np.delete(above, pick, axis=1)
        d = np.sqrt(np.maximum(((lifted[rows] - point) ** 2).sum(axis=1), 0))
        half = np.argsort(d, kind="stable")
        near, far = half[:len(rows) // 2], half[len(rows) // 2:]
        at = len(nodes)
        nodes.append(None)
        above = np.vstack([above, d])
        nodes[at] = ("node", place, point, (d[near].min(), d[near].max()), (d[far].min(), d[far].max()),
                     grow(rows[near], above[:, near]), grow(rows[far], above[:, far]))
        return at

    if len(x):
        grow(np.arange(len(x)), np.zeros((0, len(x))))
    p = np.array(perm, np.int64)
    return {"ids": ids[p], "x": x[p], "top": top, "nodes": nodes}


def search(tree: dict, q: np.ndarray, k: int, factor: float, tally: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best rows for every row of ``q``; -inf and -1 where there are fewer.
    ``tally[0]`` grows by the pairs that no bound excluded."""
    score, ids = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
    if not tree["nodes"] or not len(q):
        return score, ids
    qn = np.einsum("ij,ij->i", q, q)
    slack = SLACK * np.sqrt(qn + tree["top"])
    worst = np.full(len(q), np.inf)  # distance of the k-th best, with the slack

    def offer(at, s, own):
        """Let scores ``s`` of the vectors ``own`` compete for the k best of the queries ``at``."""
        beats = (s >= score[at, k - 1][:, None]) & (s > -np.inf)
        some = beats.any(axis=1)
        if not some.any():
            return
        at, s = at[some], np.where(beats[some], s[some], -np.inf)
        both = np.hstack([score[at], s])
        own = np.hstack([ids[at], np.where(s > -np.inf, own[None, :], -1)])
        if both.shape[1] > 4 * k:  # all that may be among the k best, ties included
            edge = -np.partition(-both, k - 1, axis=1)[:, k - 1:k]
            width = int(((both >= edge) & (both > -np.inf)).sum(axis=1).max())
            pick = np.argpartition(-both, min(max(width, k), both.shape[1] - 1), axis=1)[:, :max(width, k)]
            both, own = np.take_along_axis(both, pick, 1), np.take_along_axis(own, pick, 1)
        best = np.lexsort((own, -both), axis=1)[:, :k]
        score[at], ids[at] = np.take_along_axis(both, best, 1), np.take_along_axis(own, best, 1)
        last = score[at, k - 1]
        far = np.sqrt(np.maximum(qn[at] + tree["top"] - 2 * np.where(np.isfinite(last), last, 0), 0))
        worst[at] = np.where(np.isfinite(last), far + slack[at], np.inf)

    def leaf(a, b, above, at, passed):
        bound = np.zeros((len(at), b - a))
        for mine, theirs in zip(passed, above):
            np.maximum(bound, np.abs(mine[:, None] - theirs), out=bound)
        open_ = bound * factor <= worst[at][:, None]
        n = int(open_.sum())
        if tally is not None:
            tally[0] += n
        if n < SPARSE * open_.size:
            row, col = np.nonzero(open_)
            s = np.full(open_.shape, -np.inf)
            s[row, col] = np.einsum("ij,ij->i", q[at[row]], tree["x"][a + col])
        else:
            s = np.where(open_, q[at] @ tree["x"][a:b].T, -np.inf)
        offer(at, s, tree["ids"][a:b])

    def visit(node, at, passed):
        if not len(at):
            return
        n = tree["nodes"][node]
        if n[0] == "leaf":
            leaf(n[1], n[2], n[3], at, passed)
            return
        _, place, point, (lo0, hi0), (lo1, hi1), near, far = n
        s = q[at] @ point[:-1]
        d = np.sqrt(np.maximum(qn[at] + point @ point - 2 * s, 0))
        if tally is not None:
            tally[0] += len(at)
        offer(at, s[:, None], tree["ids"][place:place + 1])
        passed = [*passed, d]
        inner = d <= (hi0 + lo1) / 2

        def enter(side, mask):
            visit(side, at[mask], [p[mask] for p in passed])

        enter(near, inner)
        enter(far, ~inner | (np.maximum(np.maximum(lo1 - d, d - hi1), 0) * factor <= worst[at]))
        enter(near, ~inner & (np.maximum(np.maximum(lo0 - d, d - hi0), 0) * factor <= worst[at]))

    visit(0, np.arange(len(q)), [])
    return score, ids


def tuned(tree: dict, k: int) -> float:
    """The largest factor at which a sample of the tree's own vectors reaches ``RECALL``."""
    x = tree["x"]
    q = x[np.argsort(tree["ids"])][::max(1, -(-len(x) // TUNE_QUERIES))]
    want = search(tree, q, k, 0.0)[0]  # factor 0 excludes nothing
    for factor in FACTORS:
        found = search(tree, q, k, factor)[0]
        # a row's found scores are among the wanted ones or below the last of them
        if (found >= want[:, -1:] - 1e-12).sum() >= RECALL * want.size:
            return factor
    return 1.0


# ---- on Spark ----------------------------------------------------------------

def vectors(df: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, in double precision."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .filter(~bad & F.exists("v", lambda x: x != 0)).distinct())


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def neighbours(df: DataFrame, is_query, k: int = K, factor: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of every query row.
    Without ``factor`` each shard's tree is searched with the factor tuned for it."""
    spark = df.sparkSession
    prepare(spark)
    rows = vectors(df)
    one = Window.partitionBy("v").orderBy("vec_id")
    heads = rows.withColumn("r", F.row_number().over(one)).filter(F.col("r") <= k + 1)
    classes = stored(heads.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                     .withColumn("cid", F.col("ids")[0]), "vectors")
    queries = stored(rows.filter(is_query).join(classes.select("v", "cid"), "v").select("vec_id", "cid"), "queries")
    asked = classes.join(queries.select("cid").distinct(), "cid", "left_semi").select("cid", "v")

    n, dim = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    n_shards = max(1, -(-n // SHARD_ROWS))
    n_blocks = max(1, -(-asked.count() // QUERY_ROWS))

    def index(frame: pd.DataFrame) -> pd.DataFrame:
        tree = build(frame["cid"].to_numpy(np.int64), _matrix(frame["v"], dim))
        own = tuned(tree, k + 1) if factor is None else factor
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "factor": [own], "tree": [pickle.dumps(tree)]})

    trees = stored(classes.select(F.pmod(F.xxhash64("cid"), F.lit(n_shards)).cast("int").alias("shard"), "cid", "v")
                   .groupBy("shard").applyInPandas(index, "shard int, factor double, tree binary"), "trees")

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"cid": [], "near": [], "score": []})
        score, ids = search(pickle.loads(left["tree"].iloc[0]), _matrix(right["v"], dim), k + 1,
                            float(left["factor"].iloc[0]))
        some = np.isfinite(score.ravel())
        return pd.DataFrame({"cid": np.repeat(right["cid"].to_numpy(np.int64), k + 1)[some],
                             "near": ids.ravel()[some], "score": score.ravel()[some]})

    by_block = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    by_shard = (asked.withColumn("block", F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(n_blocks)).cast("int"))
                .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))))
    found = (by_block.groupBy("shard", "block").cogroup(by_shard.groupBy("shard", "block"))
             .applyInPandas(answer, "cid long, near long, score double"))

    # k + 1 ids per asked vector answer all its queries, each without itself.
    best = (found.join(classes.select(F.col("cid").alias("near"), "ids"), "near")
            .select("cid", "score", F.explode("ids").alias("vec_id")))
    order = Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    answers = best.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    out = (queries.join(answers, "cid")
           .select(F.col("vec_id").alias("query_id"),
                   F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("vec_id")), 1, k).alias("best"))
           .select("query_id", F.posexplode("best").alias("at", "b")))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"),
                      F.col("b.score").alias("score"))


def op10_vantage_point(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP10_SQL = r"""
with v as (select distinct vec_id, embedding::double[] as e from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, x -> x is null or not isfinite(x))) = 0
             and len(list_filter(embedding, x -> x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e) as score
      from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""
