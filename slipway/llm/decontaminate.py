"""Benchmark decontamination by winnowing, in DataFrame and SQL functions only.

Texts become words: A-Z lower-cased, runs of letters, digits and any
non-ASCII characters. Every run of ``GRAM`` words is hashed and from each
``PICK`` consecutive hashes the least (the first of equals) is a fingerprint.
Two texts that share ``GRAM + PICK - 1 = WINDOW`` words in a row share the
hashes of that stretch, hence its fingerprint and its place in it: no shared
window can be missed. Fingerprints of documents are joined with those of the
benchmark items; a match says at which shift the two texts may agree. At each
such (document, item, shift) the hit is extended: the words are compared in
place and every item window that agrees in full marks its words.

Fingerprints and the extension compare words with A-Z lower-cased. Full Unicode
lower-casing would lose hits: it depends on what surrounds a word (final sigma).

A window that occurs more than once in an item counts once: an item is cut into
sections, stretches of words whose windows are all new, and these stand for it.
An item of one word repeated is a section of ``WINDOW`` words, so a page that
repeats the word too has a shift per word and each is compared with that section
alone. Words are compared by index into both arrays, all shifts of a (document,
section) in one row, so no array is copied for each shift.

An item of fewer than ``WINDOW`` words is a single window. Its first
``min(GRAM, length)`` words are looked up among the documents' runs of that
length and extended alike.

The benchmark side is broadcast while its fingerprints, which are counted,
stay below ``BROADCAST_ROWS``; above that the same join runs as a shuffle.

Defined cases: null, empty or blank texts have no words, no hits and match
nothing; rows of an equal (doc_id, text) get equal results each, a null
doc_id included; repeated item rows count once per item_id; an empty
benchmark contaminates nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipway.llm.common import free_name, stored, table

WINDOW = 10
GRAM = 5
PICK = WINDOW - GRAM + 1
BROADCAST_ROWS = 1 << 20
# Fixed values of the contract: what lies between words, and the letters that fold.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column, exact: bool = True) -> Column:
    """Words of a text; ``exact`` folds A-Z alone, else all letters (as many words, to be counted only)."""
    low = F.translate(text, UPPER, LOWER) if exact else F.lower(text)
    # A-Z lie between words, so folding comes first. Splitting is far cheaper
    # than extracting, which copies the text for every match.
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BETWEEN), "")


def _grams(w: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order."""
    # by get(), not slice(), which reads the whole array each time
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k),
                                              lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))) \
            .otherwise(F.array().cast("array<bigint>"))


def _fingerprints(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, fp, pos (0-based place of the run) for every stretch of PICK hashes in ``g``."""
    # No filter on "g": it would be pushed below and hash the text anew for each word.
    starts = F.when(F.size("g") >= PICK, F.sequence(F.lit(0), F.size("g") - PICK)).otherwise(F.array().cast("array<int>"))
    at = df.select(*keys, "g", F.explode(starts).alias("i"))
    hash_at = [F.get("g", F.col("i") + j) for j in range(PICK)]
    least = at.select(*keys, "i", F.least(*hash_at).alias("fp"), *[h.alias(f"h{j}") for j, h in enumerate(hash_at)])
    place = F.coalesce(*[F.when(F.col(f"h{j}") == F.col("fp"), F.lit(j)) for j in range(PICK)])
    return least.select(*keys, "fp", (F.col("i") + place).alias("pos"))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, w): words of every item text.
    ``item`` is the item_id as text with a digest, for ids that come with several texts."""
    item = F.struct(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("x"))
    return (benchmark.select(item.alias("item"), words(F.col("text")).alias("w")).distinct())


def _sections(items: DataFrame) -> DataFrame:
    """(item, at, w): the stretches of each item's words that hold all its windows, each window once."""
    span = F.least(F.size("w"), F.lit(WINDOW))
    starts = (items.select("item", "w", F.explode(F.sequence(F.lit(0), F.size("w") - span)).alias("i"))
              .select("item", "i", F.slice("w", F.col("i") + 1, span).alias("window")))
    first = starts.groupBy("item", "window").agg(F.min("i").alias("i")).select("item", "i")
    run = F.col("i") - F.row_number().over(Window.partitionBy("item").orderBy("i"))
    stretch = (first.withColumn("run", run).groupBy("item", "run")
               .agg(F.min("i").alias("at"), F.max("i").alias("to")))
    return (stretch.join(items, "item")
            .select("item", "at", F.slice("w", F.col("at") + 1, F.col("to") - F.col("at") + span).alias("w")))


def _key() -> Column:
    """A document: its id and a digest of its text, for ids that come with several texts."""
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("x"), F.hash("text").alias("y")).alias("key")


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Extended hits: (key, item, place), a row per document word (0-based) that an
    occurrence of an item window covers."""
    items = stored(_sections(_items(benchmark).filter(F.size("w") > 0)), "items")
    text = docs.select(_key(), words(F.col("text")).alias("w"))

    long_items = items.filter(F.size("w") >= WINDOW).select("item", "at", _grams(F.col("w"), GRAM).alias("g"))
    bench = _fingerprints(long_items, ["item", "at"]).distinct()
    found = [_candidates(_fingerprints(text.select("key", _grams(F.col("w"), GRAM).alias("g")), ["key"]), bench)]

    short = items.filter(F.size("w") < WINDOW)
    for k in sorted(r[0] for r in short.select(F.least(F.size("w"), F.lit(GRAM))).distinct().collect()):
        own = (short.filter(F.least(F.size("w"), F.lit(GRAM)) == k)
               .select("item", "at", F.get(_grams(F.col("w"), k), F.lit(0)).alias("fp"), F.lit(0).alias("pos")))
        runs = text.select("key", F.posexplode(_grams(F.col("w"), k)).alias("pos", "fp"))
        found.append(_candidates(runs, own))

    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    return _extend(stored(pairs.distinct(), "shifts"), docs.select(_key(), "text"), items)


def _candidates(fingerprints: DataFrame, bench: DataFrame) -> DataFrame:
    """Distinct (key, item, at, shift) at which a fingerprint agrees."""
    side = bench.withColumnRenamed("pos", "item_pos")
    if side.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return (fingerprints.join(side, "fp")
            .select("key", "item", "at", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct())


def _extend(pairs: DataFrame, texts: DataFrame, sections: DataFrame) -> DataFrame:
    """Compare the words in place; runs of equal words as long as a window are hits."""
    near = (texts.join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
            .select("key", words(F.col("text")).alias("d")))
    # A section's shifts in one document are fewer than the words of both.
    both = (pairs.groupBy("key", "item", "at").agg(F.collect_list("shift").alias("shifts"))
            .join(sections, ["item", "at"]).join(near, "key"))
    w, d = F.col("w"), F.col("d")

    def equal(shift):
        """Places in the document that hold the section's word there."""
        lo, hi = F.greatest(shift, F.lit(0)), F.least(shift + F.size(w), F.size(d)) - 1
        return F.filter(F.sequence(lo, hi), lambda p: F.get(d, p) == F.get(w, p - shift))

    found = F.transform("shifts", lambda s: F.struct(s.alias("shift"), equal(s).alias("places")))
    same = (both.select("key", "item", "at", F.least(F.size(w), F.lit(WINDOW)).alias("span"),
                        F.explode(found).alias("f"))
            .select("key", "item", "at", "span", F.col("f.shift").alias("shift"), F.explode("f.places").alias("place")))
    one = ["key", "item", "at", "shift"]
    run = same.withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy(*one).orderBy("place")))
    long = run.withColumn("n", F.count("*").over(Window.partitionBy(*one, "run")))
    return long.filter("n >= span").select("key", "item", "place")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = stored(hits(docs, benchmark), "hits")
    n_hit = found.select("key", "place").distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    items = (found.select("key", F.col("item.id").alias("item")).distinct()
             .groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items")))
    base = docs.select(_key(), F.size(words(F.col("text"), False)).cast("long").alias("n_words"))
    hit = n_hit.join(items, "key").withColumnRenamed("key", "k")
    out = base.join(hit, F.col("key").eqNullSafe(F.col("k")), "left")
    n = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(F.col("key.doc_id").alias("doc_id"), "n_words", n.alias("n_hit"),
                      F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")).cast("binary"), 256).alias("items_sha256"),
                      (n > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item window occurs, all their columns kept."""
    name = free_name(docs, "key")
    bad = hits(docs, benchmark).select(F.col("key").alias(name)).distinct()
    return docs.join(bad, _key().eqNullSafe(F.col(name)), "left_anti")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
with dw as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
iw as (
  select distinct item_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
iv as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from iw where len(w) > 0)),
dv as (
  select r, i, n, array_to_string(w[i:i + n - 1], ' ') as g
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i
        from dw, (select distinct n from iv) where len(w) >= n)),
h as (select r, i, n, item_id from dv join iv using (n, g)),
p as (select r, count(distinct q) as n_hit from (select r, unnest(range(i, i + n)) as q from h) group by r),
t as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items
      from (select distinct r, cast(item_id as varchar) as item from h) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join p using (r) left join t using (r)
"""
