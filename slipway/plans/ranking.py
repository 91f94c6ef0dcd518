"""Exact global ranks, running sums and quantiles without a single-task window.

A plain ``Window.orderBy(x)`` (no partition) moves every row into one task.
The primitives here keep the work distributed and the result exact:

1. ``prefix_sums``: bucket rows by ~``n_buckets`` approximate quantile
   boundaries of the leading sort column, total each bucket, turn the
   <= n_buckets totals into offsets, and run the window inside
   ``partitionBy(bucket)``. Bucket order is monotone in the sort column, so
   offset + in-bucket running sum is the exact global running sum.
   Without a grouping key the input is checkpointed once (reliable, to the
   shared checkpoint folder) and the boundaries and offsets are two bounded
   1-row / <= n_buckets-row results inlined as literals, so the final plan
   reads the checkpoint once (no join, no duplicated lineage). With a grouping
   key (``part``, e.g. one curve per model) they are small joined tables.
2. ``row_numbers``: exact global row number by (score, id). Rows are dealt to range
   partitions of (group, score, id) and numbered where they lie; the partitions' counts
   become offsets. The id is part of the range key, so one score that all rows
   hold is spread over as many tasks as any other; ids may be of any type that sorts.
3. ``quantiles_linear`` / ``quantile_nearest``: exact order statistics from
   prefix sums over value counts (heavy duplicates collapse in the partial
   aggregation); only the bucket holding a target rank is scanned for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipway.session import cut_lineage

N_BUCKETS = 64
MAX_BUCKETS = 4096
BUCKET_ROWS = 500_000  # rows of a bucket aimed at
NEAR = 1e-3  # how far from a place approximate quantiles (error a tenth of that) bound it


# ------------------------------------------------------------------ bucketing
def _bound_values(df: DataFrame, key: str, n_buckets: int) -> list[float]:
    qs = [i / n_buckets for i in range(1, n_buckets)]
    row = df.agg(F.percentile_approx(F.col(key).cast("double"), F.array(*[F.lit(q) for q in qs]), 10000)).first()
    return sorted(set(v for v in (row[0] or []) if v is not None))


def _bucket_expr(key: str, bounds: list[float], desc: bool):
    v = F.col(key).cast("double")
    arr = F.array(*[F.lit(float(b)) for b in bounds]) if bounds else F.array().cast("array<double>")
    return F.size(F.filter(arr, (lambda x: x > v) if desc else (lambda x: x < v)))


def _bucket_grouped(df: DataFrame, key: str, desc: bool, part: list[str], n_buckets: int) -> DataFrame:
    qs = [i / n_buckets for i in range(1, n_buckets)]
    b = df.groupBy(*part).agg(F.percentile_approx(F.col(key).cast("double"),
                                                  F.array(*[F.lit(q) for q in qs]), 10000).alias("_b"))
    v = F.col(key).cast("double")
    j = df.join(b, part, "inner")
    bucket = F.size(F.filter(F.col("_b"), (lambda x: x > v) if desc else (lambda x: x < v)))
    return j.withColumn("_bucket", bucket).drop("_b")


def prefix_sums(df: DataFrame, order: Sequence[tuple[str, bool]], sums: Sequence[str],
                part: Sequence[str] = (), n_buckets: int = N_BUCKETS,
                inclusive: bool = True, cut: bool = True) -> DataFrame:
    """Exact running sums of ``sums`` in the total order ``order``.

    ``order`` is [(column, descending), ...] and must be unique within
    ``part`` (callers collapse ties first). Adds ``cum_<c>`` columns and
    keeps ``_bucket``.
    """
    part = list(part)
    lead, lead_desc = order[0]
    ocols = [F.col(c).desc() if d else F.col(c).asc() for c, d in order]
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    if not part:
        src = cut_lineage(df) if cut else df
        n_buckets = max(n_buckets, min(MAX_BUCKETS, src.count() // BUCKET_ROWS))
        bounds = _bound_values(src, lead, n_buckets)
        b = src.withColumn("_bucket", _bucket_expr(lead, bounds, lead_desc))
        tot = {r["_bucket"]: r for r in b.groupBy("_bucket").agg(*[F.sum(c).alias(c) for c in sums]).collect()}
        nb = len(bounds) + 1
        offs = {c: [] for c in sums}
        for c in sums:
            run = 0
            for i in range(nb):
                offs[c].append(run)
                run += (tot[i][c] or 0) if i in tot else 0
        w = Window.partitionBy("_bucket").orderBy(*ocols).rowsBetween(*frame)
        out = b.select("*", *[(F.element_at(F.array(*[F.lit(o) for o in offs[c]]), F.col("_bucket") + 1)
                               + F.coalesce(F.sum(c).over(w), F.lit(0))).alias(f"cum_{c}") for c in sums])
        return out
    b = _bucket_grouped(df, lead, lead_desc, part, n_buckets)
    tot = b.groupBy(*part, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    wo = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*part, "_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}")
                                         for c in sums])
    j = b.join(off, part + ["_bucket"], "inner")
    w = Window.partitionBy(*part, "_bucket").orderBy(*ocols).rowsBetween(*frame)
    out = j.select("*", *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0))).alias(f"cum_{c}")
                          for c in sums])
    return out.drop(*[f"_o_{c}" for c in sums])


def row_numbers(df: DataFrame, score: str, id_col: str, desc: bool = True,
                part: Sequence[str] = (), block: int | None = None, name: str = "rn") -> DataFrame:
    """Exact 1-based row number over (score desc|asc, id asc) within ``part``; null scores come last.

    The rows are sorted into range partitions once, written to the checkpoint folder with
    their place, and read back: the partitions stay as they are however often they are read. ``block``: rows
    of a partition aimed at; without it the session's shuffle partitions decide. A group's rows in one
    partition are a cell; what lies before a cell is a sum over the group's earlier cells, so a
    group that holds most rows is joined in as many cells as it has partitions."""
    part = list(part)
    order = [*[F.col(c) for c in part], F.col(score).desc_nulls_last() if desc else F.col(score).asc_nulls_last(), F.col(id_col).asc()]
    n = [max(1, -(-df.count() // block))] if block else []
    sorted_ = df.repartitionByRange(*n, *order).sortWithinPartitions(*order)
    marked = cut_lineage(sorted_.withColumn("_at", F.monotonically_increasing_id()))  # partition number << 33 | place
    pid, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    if not part:
        counts = {r["p"]: r["n"] for r in marked.groupBy(pid.alias("p")).agg(F.count("*").alias("n")).collect()}  # partitions
        before, run = [], 0
        for i in range(max(counts, default=-1) + 1):
            before.append(run)
            run += counts.get(i, 0)
        offsets = F.array(*[F.lit(x).cast("long") for x in before]) if before else F.array().cast("array<bigint>")
        return marked.withColumn(name, F.get(offsets, pid.cast("int")) + place + 1).drop("_at")
    cells = marked.groupBy(*part, pid.alias("_pid")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # a row per group and partition
    earlier = Window.partitionBy(*part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*part, "_pid", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    j = marked.withColumn("_pid", pid).join(cells, [*part, "_pid"])
    return j.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_at", "_pid", "_first", "_before")


# ------------------------------------------------------------------ quantiles (driver scalars)
def _values_at_ranks(vc: DataFrame, col: str, ranks: list[int]) -> dict[int, float]:
    """vc = (col, _n) value counts, ranks 0-based -> {rank: value}. Only the buckets that hold a rank are dealt and sorted."""
    n_buckets = max(N_BUCKETS, min(MAX_BUCKETS, vc.count() // BUCKET_ROWS))
    b = vc.withColumn("_bucket", _bucket_expr(col, _bound_values(vc, col, n_buckets), False))
    totals = {r["_bucket"]: r["n"] for r in b.groupBy("_bucket").agg(F.sum("_n").alias("n")).collect()}  # <= n_buckets rows
    need = _buckets_of_ranks(totals, ranks)
    if not need:
        return {}
    before = F.element_at(F.create_map(*[F.lit(x) for kv in need.items() for x in kv]), F.col("_bucket"))
    w = Window.partitionBy("_bucket").orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    cum = b.filter(F.col("_bucket").isin(list(need))).select(col, "_n", (before + F.sum("_n").over(w)).alias("cum"))
    wanted = F.array(*[F.lit(k).cast("long") for k in sorted(set(ranks))])
    hit = cum.filter(F.exists(wanted, lambda k: (k >= F.col("cum") - F.col("_n")) & (k < F.col("cum"))))
    rows = hit.select(col, (F.col("cum") - F.col("_n")).alias("lo"), F.col("cum").alias("hi")).collect()
    return {k: r[col] for k in ranks for r in rows if r["lo"] <= k < r["hi"]}


def _buckets_of_ranks(totals: dict[int, int], ranks: Sequence[int]) -> dict[int, int]:
    """Buckets that hold one of the 0-based ranks, and how many rows lie before each."""
    need, run = {}, 0
    for i in sorted(totals):
        if any(run <= k < run + totals[i] for k in ranks):
            need[i] = run
        run += totals[i]
    return need


def _vc(df: DataFrame, col: str) -> DataFrame:
    return cut_lineage(df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n")))


def quantile_values(df: DataFrame, col: str, qs: Sequence[float]) -> list[float | None]:
    """Exact linear-interpolation quantiles (numpy default) as driver scalars.

    Distributed: value counts -> bucketed prefix sums -> only the buckets
    holding the 2*len(qs) target ranks are read back (<= 2*len(qs) rows).
    """
    vc = _vc(df, col)
    n = vc.agg(F.sum("_n")).first()[0] or 0
    if n == 0:
        return [None for _ in qs]
    hs = [(n - 1) * float(q) for q in qs]
    ranks = sorted({int(h // 1) for h in hs} | {int(-(-h // 1)) for h in hs})
    vals = _values_at_ranks(vc, col, ranks)
    out = []
    for h in hs:
        lo, hi = int(h // 1), int(-(-h // 1))
        a, b = float(vals[lo]), float(vals[hi])
        out.append(a + (b - a) * (h - lo))
    return out


def column_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact linear quantiles of several numeric columns.

    One pass takes approximate quantiles a little below and above each place; a second counts what lies below them, and
    only values in between are dealt and sorted (two in a thousand, or one heavy value that is counted
    before the shuffle). A place that the approximate bounds miss is looked for again in wider ones, at last in all
    values. The driver reads len(cols) * len(qs) rows. A column without values gives None.
    """
    out: dict = {c: [None for _ in qs] for c in cols}
    todo = [(c, i) for c in cols for i in range(len(qs))]
    for near in (NEAR, 100 * NEAR, 1.0):
        todo = _quantiles_between(df, todo, qs, near, out) if todo else []
    return out


def _quantiles_between(df: DataFrame, todo: list[tuple[str, int]], qs: Sequence[float], near: float, out: dict) -> list:
    """Fills ``out`` where the place lies between the approximate quantiles ``near`` below and above; returns the rest."""
    v = {c: F.col(c).cast("double") for c, _ in todo}
    got = df.agg(*[x for k, (c, i) in enumerate(todo) for x in (
        F.count(v[c]).alias(f"n{k}"), F.percentile_approx(v[c], [max(qs[i] - near, 0.0), min(qs[i] + near, 1.0)], 10000).alias(f"b{k}"))]).first()
    asked = []  # (window, lower, upper, place)
    for k, (c, i) in enumerate(todo):
        if got[f"n{k}"]:
            lo, hi = got[f"b{k}"]
            asked.append((k, lo if near < 1 else None, hi if near < 1 else None, (got[f"n{k}"] - 1) * float(qs[i])))
    if not asked:
        return []
    below = df.agg(*[(F.count_if(v[todo[k][0]] < F.lit(lo)) if lo is not None else F.lit(0)).cast("long").alias(f"w{k}")
                     for k, lo, _, _ in asked]).first()

    def within(k, lo, hi):
        x = v[todo[k][0]]
        return x.isNotNull() & ((x >= F.lit(lo)) & (x <= F.lit(hi)) if lo is not None else F.lit(True))

    cells = F.array(*[F.when(within(k, lo, hi), F.struct(F.lit(k).alias("w"), v[todo[k][0]].alias("v"))) for k, lo, hi, _ in asked])
    counts = cut_lineage(df.select(F.inline(F.filter(cells, lambda x: x.isNotNull()))).groupBy("w", "v").agg(F.count(F.lit(1)).alias("_n")))
    ranks = {k: sorted({int(h // 1), int(-(-h // 1))}) for k, _, _, h in asked}
    want = df.sparkSession.createDataFrame([(k, r - below[f"w{k}"]) for k, rs in ranks.items() for r in rs], "w int, _rank long")
    upto = Window.partitionBy("w").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("_cum", F.sum("_n").over(upto))
    hit = cum.join(F.broadcast(want), "w").filter((F.col("_rank") >= F.col("_cum") - F.col("_n")) & (F.col("_rank") < F.col("_cum")))
    found = {(r["w"], r["_rank"] + below[f"w{r['w']}"]): r["v"] for r in hit.select("w", "_rank", "v").collect()}  # columns x quantiles x 2
    left = []
    for k, _, _, h in asked:
        c, i = todo[k]
        if any((k, r) not in found for r in ranks[k]):
            left.append((c, i))
            continue
        lo, hi = found[k, int(h // 1)], found[k, int(-(-h // 1))]
        out[c][i] = lo + (hi - lo) * (h - int(h // 1))
    return left


def first_rows(df: DataFrame, key, n: int, rest: Sequence, desc: bool = False) -> DataFrame:
    """The ``n`` first rows by ``key`` (a whole number) and then ``rest``, as ``orderBy(key, *rest).limit(n)``.

    A plain limit sends n rows of every partition to one task. Here rows beyond an approximate quantile of the
    key stay out of the sort; if the quantile leaves fewer than n, all rows are sorted."""
    order = [key.desc() if desc else key.asc(), *rest]
    total = df.count()
    share = n / total + NEAR if total else 1.0
    if share < 0.5:
        cut = df.agg(F.percentile_approx(key, 1 - share if desc else share, 10000)).first()[0]
        kept = df.filter(F.coalesce(key >= F.lit(cut), F.lit(False)) if desc else F.coalesce(key <= F.lit(cut), F.lit(True)))
        if cut is not None and kept.count() >= n:
            df = kept
    return df.orderBy(*order).limit(n)


def quantile_nearest_values(df: DataFrame, col: str, qs: Sequence[float], rounding: str = "half_even") -> list:
    """Order statistics at index round_half_even((n-1)*q) (pandas 'nearest'),
    or floor(n*q) with rounding='floor_n', from one count of the values (driver scalars)."""
    vc = _vc(df, col)
    n = vc.agg(F.sum("_n")).first()[0] or 0
    if n == 0:
        return [None for _ in qs]
    if rounding == "half_even":
        ks = [int(round((n - 1) * float(q))) for q in qs]  # Python round is half-even
    else:
        ks = [int((n * float(q)) // 1) for q in qs]
    found = _values_at_ranks(vc, col, ks)
    return [found.get(k) for k in ks]


def quantile_nearest_value(df: DataFrame, col: str, q: float, rounding: str = "half_even"):
    return quantile_nearest_values(df, col, [q], rounding)[0]


def quantiles_linear(df: DataFrame, col: str, qs: Sequence[float], part: Sequence[str] = ()) -> DataFrame:
    """Exact linear quantiles as a DataFrame (part.., q, value).

    Without ``part`` this is a <= len(qs)-row table of driver scalars; with
    ``part`` it is computed per group by joins (no driver round trip).
    """
    part = list(part)
    spark = df.sparkSession
    if not part:
        vals = quantile_values(df, col, qs)
        rows = [(float(q), v) for q, v in zip(qs, vals) if v is not None]
        return spark.createDataFrame(rows, "q double, value double")
    vc = df.filter(F.col(col).isNotNull()).groupBy(*part, col).agg(F.count(F.lit(1)).alias("_n"))
    return quantiles_of_counts(vc, col, qs, part)


def quantiles_of_counts(vc: DataFrame, col: str, qs: Sequence[float], part: list[str]) -> DataFrame:
    """Exact linear quantiles per group from value counts (part.., col, _n)."""
    n = vc.groupBy(*part).agg(F.sum("_n").alias("_N"))
    t = n.select(*part, "_N", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    t = t.withColumn("_h", (F.col("_N") - 1) * F.col("q"))
    t = t.withColumn("_lo", F.floor("_h").cast("long")).withColumn("_hi", F.ceil("_h").cast("long"))
    cum = prefix_sums(vc, [(col, False)], ["_n"], part)

    def at(rank_col):
        j = t.select(*part, "q", F.col(rank_col).alias("_r")).join(cum, part, "inner")
        hit = j.filter((F.col("_r") >= F.col("cum__n") - F.col("_n")) & (F.col("_r") < F.col("cum__n")))
        return hit.select(*part, "q", F.col(col).cast("double").alias(f"_v{rank_col}"))
    j = t.join(at("_lo"), part + ["q"]).join(at("_hi"), part + ["q"])
    val = F.col("_v_lo") + (F.col("_v_hi") - F.col("_v_lo")) * (F.col("_h") - F.col("_lo"))
    return j.select(*part, "q", val.alias("value"))
