"""Spelling variant grouping: dense prefix-suffix tiling of the vocabulary.

Words are the runs of ``A-Za-z`` and U+00C0 to U+00FF of all whole texts, A-Z
lower-cased. A run whose crc32 with its document id is a multiple of 97 loses
one letter (the contract's own misspellings). Words of at least 5 letters
with at least 3 occurrences overall make the vocabulary.

Two words are near if they differ by one inserted, deleted or replaced letter.
With ``L`` the longer length, that is: common prefix plus common suffix reach
``L - 1``. Cut ``L`` into ``PARTS`` parts; the common prefix ends in one of
them, so all before that part and all behind it is equal in both words. Words
are therefore blocked by (L, part, what lies outside the part), once with their
own length and once as the shorter partner of a word one letter longer. Inside a
block, padded matrices of code points (left and right aligned) are compared
whole: every pair gets its common prefix and suffix, column by column. A pair
counts in the one block that its common prefix names, so it is found once.

Blocks of more than ``TILE`` words are cut by a hash of the word into sub-blocks,
and each pair of sub-blocks is a tile of its own: no task holds a large block,
and all pairs are still compared. Small blocks share a tile of ``ROWS`` rows. A
tile hands on, per word, the number of near words and the best one; pairs never
leave it.

A word's form is its near word of largest n (ties: first in code-point order),
if that n is at least twice the word's own; the root follows forms to the last,
by pointer doubling. At most ~100 * (2 * length + 1) words are near a word,
which bounds the rows of a key in that join.

Defined cases: null, empty and letterless texts have no words; a null doc_id
counts as an empty id in the crc; repeated rows count each; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipway.llm.common import prepare, stored, table

PARTS = 3
TILE = 512  # words of a sub-block
ROWS = 64  # rows of a tile of small blocks
BROADCAST_ROWS = 1 << 18
# Fixed values of the contract: what lies between words, the letters that fold, the misspellings, the bounds.
BETWEEN = "[^A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MISSPELT = 97
LENGTH, COUNT, TIMES = 5, 3, 2


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""
    runs = (docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                        F.explode(F.split(F.translate("text", UPPER, LOWER), BETWEEN)).alias("run"))
            .filter(F.length("run") >= LENGTH)  # a run only gets shorter
            .select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h")))
    gone = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % MISSPELT == 0, F.concat(
        F.substr("run", F.lit(1), gone), F.substr("run", gone + 2, F.length("run")))).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).filter(F.length("word") >= LENGTH)
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= COUNT))


def _cut(longer: Column, part: Column) -> Column:
    return F.floor(longer * part / PARTS).cast("int")


def blocked(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(longer, part, key, lo, hi, block, word, n): every word in the blocks where its partners can be."""
    size = F.length("word")
    at = (words.select("word", "n", F.explode(F.array(size, size + 1)).alias("longer"))
          .select("*", F.explode(F.array(*[F.lit(p) for p in range(PARTS)])).alias("part")))
    tail = F.col("longer") - _cut(F.col("longer"), F.col("part") + 1)
    outside = F.concat(F.substr("word", F.lit(1), _cut(F.col("longer"), F.col("part"))),
                       F.substr("word", F.length("word") - tail + 1, tail))
    keyed = at.select("*", F.xxhash64("longer", "part", outside).alias("key"))
    large = stored(keyed.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > tile), "large-blocks")
    n = large.count()
    if not n:
        return keyed.select("longer", "part", "key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("block"),
                            "word", "n")
    cuts = large.select("key", F.ceil(F.col("size") / tile).cast("int").alias("cuts"))
    joined = keyed.join(F.broadcast(cuts) if n <= BROADCAST_ROWS else cuts, "key", "left")
    n_cuts = F.coalesce("cuts", F.lit(1))
    own = joined.select("*", F.pmod(F.xxhash64("word"), n_cuts).cast("int").alias("block"),
                        F.explode(F.sequence(F.lit(0), n_cuts - 1)).alias("other"))
    return own.select("longer", "part", "key", F.least("block", "other").alias("lo"),
                      F.greatest("block", "other").alias("hi"), "block", "word", "n")


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words, left aligned and right aligned, and their lengths."""
    size = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    width = int(size.max())
    row = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    left, right = np.zeros((width, len(words)), np.uint32), np.zeros((width, len(words)), np.uint32)
    left[place, row] = flat
    right[np.repeat(size, size) - 1 - place, row] = flat
    return left, right, size


def _common(columns: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Number of leading columns in which the rows of a pair agree, for the pairs in ``alive``."""
    alive, out = alive.copy(), np.zeros(alive.shape, np.int32)
    for c in columns:
        alive &= c[:, None] == c[None, :]
        if not alive.any():
            break
        out += alive
    return out


def compare(words: list[str], longer: np.ndarray, part: np.ndarray, group: np.ndarray,
            cross: np.ndarray) -> np.ndarray:
    """Near pairs of a tile as a symmetric matrix. Rows are compared within their ``group``;
    where ``cross`` is 0 or above, only with rows of another ``cross``."""
    left, right, size = _matrices(words)
    low = np.minimum(size[:, None], size[None, :])
    pair = (group[:, None] == group[None, :]) & (np.maximum(size[:, None], size[None, :]) == longer[:, None])
    pair &= (cross[:, None] < 0) | (cross[:, None] != cross[None, :])
    np.fill_diagonal(pair, False)
    prefix = np.minimum(_common(left, pair), low)
    suffix = np.minimum(_common(right, pair), low)
    pair &= prefix + suffix >= longer[:, None] - 1
    pair &= prefix >= (longer * part // PARTS)[:, None]
    pair &= prefix < (longer * (part + 1) // PARTS)[:, None]
    return pair


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows in runs of whole (key, lo, hi) groups of at least ROWS rows together."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if len(held) < ROWS:
            continue
        ids = [held.column(c).to_numpy() for c in ("key", "lo", "hi", "longer", "part")]
        new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1  # first rows of groups
        at = 0
        while True:
            k = int(np.searchsorted(new, at + ROWS))
            if k == len(new):
                break
            yield held.slice(at, int(new[k]) - at)
            at = int(new[k])
        held = held.slice(at)
    if held is not None and len(held):
        yield held


def near(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, best): best is a struct (minus n, word) of the near word of largest n."""

    def search(batches):
        for t in _tiles(batches):
            word = t.column("word").to_pylist()
            col = {c: t.column(c).to_numpy().astype(np.int64) for c in ("longer", "part", "key", "lo", "hi", "block", "n")}
            ids = [col[c] for c in ("key", "lo", "hi", "longer", "part")]
            group = np.cumsum(np.append(0, np.any([x[1:] != x[:-1] for x in ids], axis=0)))
            cross = np.where(col["lo"] == col["hi"], -1, col["block"])
            pair = compare(word, col["longer"], col["part"], group, cross)
            hit = np.flatnonzero(pair.any(axis=1))
            if not len(hit):
                continue
            order = np.array(sorted(range(len(word)), key=lambda i: (-col["n"][i], word[i])))
            rank = np.empty(len(word), np.int64)
            rank[order] = np.arange(len(word))
            best = order[np.where(pair[hit], rank[None, :], len(word)).min(axis=1)]
            yield pa.RecordBatch.from_arrays([
                pa.array([word[i] for i in hit], pa.string()), pa.array(pair[hit].sum(axis=1), pa.int64()),
                pa.array(-col["n"][best], pa.int64()), pa.array([word[i] for i in best], pa.string())],
                ["word", "n_near", "less", "best"])

    dealt = (blocked(words, tile).repartition("key", "lo", "hi")
             .sortWithinPartitions("longer", "part", "key", "lo", "hi"))
    found = dealt.mapInArrow(search, "word string, n_near long, less long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "best")).alias("best"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, two hops becoming four, eight ..."""
    hops = stored(forms.select("word", F.col("form").alias("root")), "hops")
    while True:
        onward = hops.select(F.col("word").alias("root"), F.col("root").alias("then"))
        step = stored(hops.join(onward, "root", "left").select(
            "word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "hops")
        hops = step.select("word", "root")
        if not step.filter("moved").head(1):
            return hops


def group_variants(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """A row per word: word, form, root, n, n_near, form_n."""
    prepare(docs.sparkSession)
    words = stored(vocabulary(docs), "vocabulary")
    best_n = -F.col("best.less")
    known = words.join(near(words, tile), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(best_n >= TIMES * F.col("n"), F.struct(F.col("best.best").alias("form"), best_n.alias("n"))).alias("to"))
    known = stored(known, "near")
    roots = follow(known.filter("to is not null").select("word", F.col("to.form").alias("form")))
    return known.join(roots, "word", "left").select(
        "word", F.col("to.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near",
        F.col("to.n").alias("form_n"))


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


# Independent of the tiling: crc32 from its polynomial, and neighbours through equal words after one deletion.
OP13_SQL = r"""
with recursive poly as (
  select i as b, i::bigint as c, 0 as k from range(256) t(i)
  union all
  select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from poly where k < 8),
tab as materialized (select list(c order by b) as t from poly where k = 8),
runs as (
  select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as w
  from documents),
tf as (select id, w, count(*) as n from runs where length(w) >= 5 group by all),
bytes as (
  select id, w, n, [ord(x) for x in string_split(id || ':' || w, '')] as cp from tf),
utf as (
  select id, w, n, flatten([case when c < 128 then [c] else [192 + (c >> 6), 128 + (c & 63)] end for c in cp]) as u
  from bytes),
crc as (
  select w, n, xor(list_reduce(list_prepend(4294967295, u::bigint[]),
         lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) as h from utf, tab),
cut as (
  select case when h % 97 = 0 then substring(w, 1, (h % length(w))::int) || substring(w, (h % length(w))::int + 2)
         else w end as word, n from crc),
words as materialized (
  select word, sum(n)::bigint as n from cut where length(word) >= 5 group by word having sum(n) >= 3),
less as materialized (
  select word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) as rest
  from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
pairs as (
  select a.word, b.word as other, b.n as other_n from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from less a join words b on a.rest = b.word
  union select b.word, a.word, a.n from less a join words b on a.rest = b.word),
best as (
  select word, count(*) as n_near, min({'less': -other_n, 'other': other}) as b from pairs group by word),
known as materialized (
  select words.word, n, coalesce(n_near, 0) as n_near, case when -b.less >= 2 * n then b.other end as form,
         case when -b.less >= 2 * n then -b.less end as form_n
  from words left join best using (word)),
climb as (
  select word, form, word as root, form as next from known
  union all
  select c.word, c.form, k.word, k.form from climb c join known k on c.next = k.word)
select known.word, known.form, climb.root, n, n_near::bigint as n_near, form_n::bigint as form_n
from known join climb on known.word = climb.word and climb.next is null
"""
