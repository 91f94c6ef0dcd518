"""Text documents, chunking, TF-IDF vectors and top-k retrieval.

Whole texts are processed (no prefixes). Chunking is an array expression
per row; TF-IDF is tokens -> (doc, term) counts -> document frequencies ->
a bounded vocabulary (top ``max_features`` terms, a broadcast of at most
that many rows) -> weights; nearest-neighbour search keeps the k best per
query inside each task and merges those.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipway.session import cut_lineage

# Chunking and retrieval defaults, TF-IDF settings, token rule.
CHUNK_SIZE, CHUNK_OVERLAP, TOP_K = 512, 50, 4
MAX_FEATURES, MAX_DF, MIN_DF = 4096, 0.6, 2
# "two or more word characters" with Unicode letters/digits (the default
# token rule of the usual TF-IDF vectorizer, which is Unicode-aware).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
BROADCAST_MAX_QUERIES = 10_000
QUERY_POSTINGS = 1 << 20  # terms of all queries that are sent at once


def chunk_text(text_col: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """Array of chunks: the text itself if len <= size, else windows
    starting at 0, size-overlap, ... while start < len (a last chunk may lie
    inside the previous one: kept)."""
    if overlap >= size:
        raise ValueError("chunk overlap must be smaller than the chunk size")
    t = F.col(text_col)
    n = F.length(t)
    starts = F.sequence(F.lit(0), n - 1, F.lit(size - overlap))
    windows = F.transform(starts, lambda s: F.substring(t, s + 1, size))
    return F.when(n <= size, F.array(t)).otherwise(windows)


def chunks(docs: DataFrame, id_col: str, text_col: str = "text", size: int = CHUNK_SIZE,
           overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk with id ``{doc}_chunk{i}``."""
    x = docs.select(id_col, F.posexplode(chunk_text(text_col, size, overlap)).alias("chunk_idx", "chunk"))
    return x.select(id_col, "chunk_idx",
                    F.format_string("%s_chunk%d", F.col(id_col).cast("string"), F.col("chunk_idx")).alias("chunk_id"),
                    F.col("chunk").alias("text"))


def review_documents(reviews: DataFrame, items: DataFrame, sellers: DataFrame, limit: int = 2000) -> DataFrame:
    """T03 + J03 + K04: newest ``limit`` commented reviews as documents."""
    r = reviews.filter(F.col("comment").isNotNull() & (F.col("comment") != ""))
    j = (r.join(items.select("order_id", "seller_id"), "order_id")
          .join(sellers.select("seller_id", "seller_state"), "seller_id"))
    top = j.orderBy(F.desc("created"), F.asc("order_id"), F.asc("seller_id")).limit(limit)
    # row index of the newest-first list: a window over <= limit rows
    w = Window.orderBy(F.desc("created"), F.asc("order_id"), F.asc("seller_id"))
    top = top.withColumn("i", F.row_number().over(w) - 1)
    s = F.col("review_score")
    sentiment = F.when(s <= 2, "negative").when(s >= 4, "positive").otherwise("neutral")
    text = F.format_string("Customer review for seller %s (state %s) on %s: %s/5 stars (%s). Comment: %s",
                           F.col("seller_id").cast("string"), F.col("seller_state"),
                           F.date_format(F.to_date("created"), "yyyy-MM-dd"), s.cast("string"), sentiment,
                           F.substring("comment", 1, 300))
    return top.select(F.format_string("review_%d_%s", F.col("i"), F.col("seller_id").cast("string")).alias("id"),
                      text.alias("text"), F.col("seller_id").cast("string").alias("seller_id"),
                      F.lit("customer_review").alias("source"))


def prediction_documents(preds: DataFrame, sellers: DataFrame, drivers: DataFrame | None = None) -> DataFrame:
    """One sentence document per ranked seller, with its top drivers
    ("raises/lowers risk, impact x.xx"). ``drivers``: (seller_id,
    top_features array<struct<feature, contribution>>)."""
    p = preds.join(sellers.select("seller_id", "seller_state", "seller_zip"), "seller_id", "left")
    if drivers is not None:
        p = p.join(drivers, "seller_id", "left")
    else:
        p = p.withColumn("top_features", F.array().cast("array<struct<feature:string,contribution:double>>"))
    items = F.transform(F.coalesce("top_features", F.array().cast("array<struct<feature:string,contribution:double>>")),
                        lambda f: F.format_string("%s (%s risk, impact %.2f)", f["feature"],
                                                  F.when(f["contribution"] > 0, "raises").otherwise("lowers"),
                                                  F.abs(f["contribution"])))
    text = F.format_string("Seller %s in zip %s, state %s, has a current delivery-risk score of %.2f (%s risk). "
                           "Model used: %s. Key contributing factors: %s.",
                           F.col("seller_id").cast("string"), F.col("seller_zip").cast("string"), F.col("seller_state"),
                           F.col("risk_score"), F.col("risk_band"), F.col("model_name"), F.array_join(items, "; "))
    return p.select(F.format_string("prediction_%s", F.col("seller_id").cast("string")).alias("id"), text.alias("text"),
                    F.col("seller_id").cast("string").alias("seller_id"), F.lit("prediction").alias("source"))


# ------------------------------------------------------------------ TF-IDF
def term_counts(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    toks = docs.select(id_col, F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN_PATTERN), 0)).alias("term"))
    return toks.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_vocabulary(tc: DataFrame, id_col: str, n_docs: int, max_features: int = MAX_FEATURES,
                   max_df: float = MAX_DF, min_df: int = MIN_DF) -> DataFrame:
    """Terms with min_df <= df <= max_df * n_docs; the ``max_features`` most
    frequent (total count, ties by term); idf = ln((1+n)/(1+df)) + 1."""
    st = tc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf"))
    st = st.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n_docs)))
    vocab = st.orderBy(F.desc("ttf"), F.asc("term")).limit(max_features)
    return vocab.select("term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tfidf_long(docs: DataFrame, id_col: str, text_col: str = "text", vocab: DataFrame | None = None) -> DataFrame:
    """L2-normalised tf * idf in long form (doc, term, weight). The
    vocabulary is fitted on ``docs`` unless given (reuse on queries)."""
    tc = term_counts(docs, id_col, text_col)
    if vocab is None:
        # the (doc, term) counts feed both the vocabulary and the weights:
        # tokenize the corpus once
        tc = cut_lineage(tc)
        n_docs = docs.select(id_col).distinct().count()  # documents without a token count as well
        vocab = fit_vocabulary(tc, id_col, n_docs)
    return tfidf_from_counts(tc, id_col, vocab)


def tfidf_from_counts(tc: DataFrame, id_col: str, vocab: DataFrame) -> DataFrame:
    """Weights from precomputed (doc, term, tf) counts and a vocabulary."""
    v = tc.join(F.broadcast(vocab.select("term", "idf")), "term")  # <= max_features rows
    v = v.withColumn("w", F.col("tf") * F.col("idf"))
    norm = v.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return v.join(norm, id_col).select(id_col, "term", (F.col("w") / F.col("_norm")).alias("weight"))


# ------------------------------------------------------------------ retrieval
def sq_l2(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
                       F.lit(0.0), lambda acc, x: acc + x)


def _in_batches(queries: DataFrame, n: int, search) -> DataFrame:
    """``search`` over batches of the queries, each small enough to broadcast.

    The hash of the id deals queries out; a batch that still is too large is
    split again by the search itself, under another hash.
    """
    parts = -(-2 * n // BROADCAST_MAX_QUERIES)
    batch = F.pmod(F.xxhash64("query_id", F.lit(n)), F.lit(parts))
    return functools.reduce(DataFrame.unionByName, [search(queries.filter(batch == i)) for i in range(parts)])


class _Best:
    """The k least distances of each query so far, ties by id; memory stays near queries x k."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.floor = k, np.full(n_queries, np.inf)
        self.held: list[tuple] = []
        self.size = 0

    def add(self, ids: np.ndarray, distance: np.ndarray, first_query: int = 0) -> None:
        """``distance`` (rows, queries); infinite where a row is no candidate."""
        at = slice(first_query, first_query + distance.shape[1])
        r, q = np.nonzero((distance <= self.floor[at]) & np.isfinite(distance))
        self.held.append((q + first_query, distance[r, q], ids[r]))
        self.size += len(r)
        if self.size > 4 * len(self.floor) * self.k + (1 << 16):
            self.cut()

    def cut(self) -> tuple:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        q, d, ids = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, d, q))
        q, d, ids = q[order], d[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, np.arange(len(self.floor)))[q]
        last = rank == self.k - 1
        self.floor[q[last]] = d[last]
        keep = rank < self.k
        self.held, self.size = [(q[keep], d[keep], ids[keep])], int(keep.sum())
        return self.held[0]


def _merged(found: DataFrame, query_ids: list, queries: DataFrame, id_col: str, k: int) -> DataFrame:
    """The k best of all tasks' best: query_id, the id, distance, rank."""
    kind = T.StructType([T.StructField("q", T.IntegerType()), queries.schema["query_id"]])
    names = found.sparkSession.createDataFrame(list(enumerate(query_ids)), kind)  # at most BROADCAST_MAX_QUERIES rows
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    return (found.join(F.broadcast(names), "q").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", id_col, "distance", "rank"))


def _found(best: _Best, id_col: str, kind: pa.DataType) -> pa.RecordBatch:
    q, d, ids = best.cut()
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids.tolist(), kind), pa.array(d)], ["q", id_col, "distance"])


def top_k_nearest(index: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = TOP_K,
                  filter_eq: dict | None = None, n_salt: int | None = None) -> DataFrame:
    """Per query, the k nearest index rows by squared L2 (id breaks
    ties), after an optional metadata equality filter.

    Exact: a task compares its rows with all queries in blocks and hands on its k best of each, so no pair leaves
    it and the shuffle holds k rows a query and task. Queries are sent to all tasks only below
    ``BROADCAST_MAX_QUERIES`` (checked count), more of them in batches. Rows without an id, or whose vector is null
    or of another length, take no part. ``n_salt`` has no use any more."""
    idx = index
    for c, v in (filter_eq or {}).items():
        idx = idx.filter(F.col(c) == v)
    asked = queries.select("query_id", F.col("query_vec").cast("array<double>").alias("v"))
    nq = asked.count()
    if nq > BROADCAST_MAX_QUERIES:
        return _in_batches(queries, nq, lambda q: top_k_nearest(idx, q, id_col, vec_col, k))
    rows = [r for r in asked.collect() if r["v"] is not None]
    q = np.array([r["v"] for r in rows], float) if rows else np.zeros((0, 1))
    kind = T.StructType([T.StructField("q", T.IntegerType()), T.StructField(id_col, index.schema[id_col].dataType),
                         T.StructField("distance", T.DoubleType())])

    def read(batches):
        best, ids_kind = _Best(len(q), k), None
        for b in batches:
            ids_kind = b.schema.field(0).type
            b = b.filter(pc.and_(pc.is_valid(b.column(0)), pc.equal(pc.fill_null(pc.list_value_length(b.column(1)), -1), q.shape[1])))
            if not len(b) or not len(q):
                continue
            ids = np.array(b.column(0).to_pylist())
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            step = max(1, (1 << 22) // max(1, v.size))
            for a in range(0, len(q), step):
                best.add(ids, ((v[:, None, :] - q[None, a:a + step]) ** 2).sum(axis=2), a)
        if ids_kind is not None:
            yield _found(best, id_col, ids_kind)

    found = idx.select(id_col, F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(read, kind)
    return _merged(found, [r["query_id"] for r in rows], queries, id_col, k)


def label_centroids(emb: DataFrame, vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Query vectors derived from the data: the mean vector per label."""
    dim = emb.select(F.max(F.size(vec_col))).first()[0]
    return emb.groupBy(label_col).agg(F.array(*[F.avg(F.col(vec_col)[i]) for i in range(dim)]).alias("query_vec")) \
              .withColumnRenamed(label_col, "query_id")


def assemble_answers(hits: DataFrame, texts: DataFrame, id_col: str, questions: DataFrame) -> DataFrame:
    """Per question, context bullets of the retrieved passages in
    distance order ("- text", blank-line separated); no hit -> the
    "nothing found" answer. Each group holds at most k passages."""
    h = hits.join(texts.select(id_col, F.col("text")), id_col)
    ctx = (h.groupBy("query_id")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_p"))
            .select("query_id", F.array_join(F.transform("_p", lambda x: F.concat(F.lit("- "), x["text"])), "\n\n")
                    .alias("context"), F.size("_p").alias("n_sources")))
    out = questions.join(ctx, "query_id", "left")
    none = "No relevant information found in the knowledge base for this question."
    return out.select("query_id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
                      F.when(F.col("context").isNull(), F.lit(none))
                       .otherwise(F.concat(F.lit("Retrieved context:\n\n"), F.col("context"))).alias("answer"),
                      F.col("context").isNotNull().cast("int").alias("grounded"))


# The instruction above the context, and the answer without one.
PROMPT = ("Answer the question about supplier risk from the context below only. "
          "If the context does not answer it, say so.")
NOTHING = "No relevant information found in the knowledge base for this question."


def grounded_prompts(hits: DataFrame, texts: DataFrame, id_col: str, questions: DataFrame) -> DataFrame:
    """(query_id, prompt, n_sources, grounded). The prompt holds the retrieved passages as bullets in order of
    rank and the question; a question without a hit gets the "nothing found" answer instead."""
    h = hits.join(texts.select(id_col, "text"), id_col)
    ctx = h.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("p"))  # k passages
    context = F.array_join(F.transform("p", lambda x: F.concat(F.lit("- "), x["text"])), "\n\n")
    prompt = F.concat(F.lit(f"{PROMPT}\n\nContext:\n"), context, F.lit("\n\nQuestion: "), F.col("question"))
    return questions.join(ctx, "query_id", "left").select(
        "query_id", F.when(F.col("p").isNotNull(), prompt).otherwise(F.lit(NOTHING)).alias("prompt"),
        F.coalesce(F.size("p"), F.lit(0)).alias("n_sources"), F.col("p").isNotNull().cast("int").alias("grounded"))



# ------------------------------------------------------------------ index build + sparse retrieval
def build_index(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """T04 + U02: documents (id, text, seller_id, source) -> chunk table
    (chunk_id, text, metadata map); ids ``{doc}_chunk{i}``."""
    c = docs.select("id", "seller_id", "source", F.posexplode(chunk_text("text", size, overlap)).alias("i", "text"))
    return c.select(F.format_string("%s_chunk%d", F.col("id"), F.col("i")).alias("chunk_id"), "text",
                    F.create_map(F.lit("seller_id"), F.col("seller_id"), F.lit("source"), F.col("source")).alias("metadata"))


def query_vectors(queries: DataFrame, vocab: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """Query texts in the index's TF-IDF space (vocabulary and idf reused)."""
    return tfidf_long(queries, id_col, text_col, vocab=vocab)


def top_k_sparse(index_long: DataFrame, query_long: DataFrame, doc_col: str, k: int = TOP_K,
                 n_salt: int | None = None) -> DataFrame:
    """T06 over sparse vectors: squared L2 between unit TF-IDF vectors is 2 - 2 * dot. The queries' terms are
    numbered and sent to the postings (behind a checked bound), each chunk's postings on them are gathered, and a
    task multiplies its chunks with all queries in blocks and hands on its k best of each: dots never leave it.
    Candidates are the chunks sharing at least one term. Distances are compared at 1e-9, so exact copies tie
    and the chunk id decides. ``n_salt`` has no use any more."""
    counts = query_long.agg(F.count_distinct("query_id"), F.count("*")).first()
    if counts[0] > 1 and (counts[0] > BROADCAST_MAX_QUERIES or counts[1] > QUERY_POSTINGS):
        parts = max(counts[0], -(-counts[1] * BROADCAST_MAX_QUERIES // QUERY_POSTINGS))
        return _in_batches(query_long, parts, lambda q: top_k_sparse(index_long, q, doc_col, k))
    rows = query_long.select("query_id", "term", "weight").collect()  # bounded as above
    names = sorted({r["query_id"] for r in rows})
    terms = sorted({r["term"] for r in rows})
    number, name_at = {t: i for i, t in enumerate(terms)}, {n: i for i, n in enumerate(names)}
    t = np.array([number[r["term"]] for r in rows], np.int64)
    order = np.argsort(t, kind="stable")
    own = np.array([name_at[r["query_id"]] for r in rows], np.int64)[order]
    weight = np.array([r["weight"] for r in rows], float)[order]
    ptr = np.searchsorted(t[order], np.arange(len(terms) + 1))
    numbered = index_long.sparkSession.createDataFrame(list(enumerate(terms)), "t int, term string")
    asked = index_long.select(doc_col, F.col("term").cast("string").alias("term"), "weight").join(F.broadcast(numbered), "term")
    # a chunk has at most as many postings as the vocabulary has terms
    vectors = asked.groupBy(doc_col).agg(F.collect_list(F.struct("t", F.col("weight").cast("double").alias("w"))).alias("p"))
    kind = T.StructType([T.StructField("q", T.IntegerType()), T.StructField(doc_col, index_long.schema[doc_col].dataType),
                         T.StructField("distance", T.DoubleType())])
    n = len(names)

    def read(batches):
        best, ids_kind = _Best(n, k), None
        for b in batches:
            ids_kind = b.schema.field(0).type
            step = max(1, (1 << 22) // max(1, n))
            for a in range(0, len(b), step):
                some = b.slice(a, step)
                p = some.column(1)
                flat = p.flatten()
                row = np.repeat(np.arange(len(some)), pc.list_value_length(p).to_numpy(zero_copy_only=False))
                term, w = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
                many = ptr[term + 1] - ptr[term]
                at = np.repeat(np.arange(len(term)), many)
                pos = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + ptr[term][at]
                cell = row[at] * n + own[pos]
                dot = np.bincount(cell, w[at] * weight[pos], len(some) * n)
                seen = np.bincount(cell, minlength=len(some) * n) > 0
                d = np.where(seen, np.round(2.0 - 2.0 * dot, 9), np.inf).reshape(len(some), n)
                best.add(np.array(some.column(0).to_pylist()), d)
        if ids_kind is not None:
            yield _found(best, doc_col, ids_kind)

    return _merged(vectors.mapInArrow(read, kind), names, query_long, doc_col, k)
