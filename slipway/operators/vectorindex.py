"""A stored index of text chunks with their vectors.

The index is a versioned table (``sources.tables``): chunk_id, text, metadata and the chunk's
TF-IDF vector as (term number, weight) pairs in order of term number, of unit length. Beside it lies the
vocabulary it was built with. Every commit of the index carries a manifest: backend, dimension and a
digest of the vocabulary. A build with ``reset`` fits the vocabulary and replaces both; an append vectorises
new chunks in the recorded space; a query or an append from another space is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipway.operators import text as tx
from slipway.session import cut_lineage
from slipway.sources.tables import Tables

BACKEND = "tfidf"


class VectorIndex:
    def __init__(self, tables: Tables, name: str = "chunks"):
        self.tables, self.name, self.vocabulary = tables, name, f"{name}_vocabulary"

    # ------------------------------------------------------------- T07
    def manifest(self) -> dict | None:
        """{backend, dim, digest} of the newest version; None without an index."""
        c = self.tables.commit_of(self.name)
        return c["notes"] if c else None

    def check(self, backend: str = BACKEND, dim: int | None = None) -> dict:
        """The manifest, if it is of that space; else an error that says what to do."""
        m = self.manifest()
        if m is None:
            raise LookupError(f"there is no index {self.name}: build it with reset")
        if m["backend"] != backend or (dim is not None and m["dim"] != dim):
            raise ValueError(f"the index holds {m['backend']} vectors of {m['dim']} dimensions, not {backend} of {dim}: "
                             "build it again with reset")
        if self._digest(self._vocabulary()) != m["digest"]:
            raise ValueError(f"the vocabulary beside {self.name} is not the one it was built with: build it again with reset")
        return m

    def _vocabulary(self) -> DataFrame:
        return self.tables.read(self.vocabulary)

    @staticmethod
    def _digest(vocab: DataFrame) -> str:
        n, h = vocab.agg(F.count("*"), F.sum(F.xxhash64("term", "at").cast("decimal(38,0)"))).first()
        return f"{n}:{h}"

    # ------------------------------------------------------------- T04
    def build(self, docs: DataFrame, reset: bool = True, size: int = tx.CHUNK_SIZE, overlap: int = tx.CHUNK_OVERLAP) -> int:
        """Index documents (id, text, then columns that become metadata); returns the version."""
        meta = [c for c in docs.columns if c not in ("id", "text")]
        chunks = cut_lineage(
            docs.select("id", *meta, F.posexplode(tx.chunk_text("text", size, overlap)).alias("i", "text"))
            .select(F.format_string("%s_chunk%d", F.col("id"), F.col("i")).alias("chunk_id"), "text",
                    F.map_filter(F.create_map(*[x for c in meta for x in (F.lit(c), F.col(c).cast("string"))]),
                                 lambda k, v: v.isNotNull()).alias("metadata")))
        counts = cut_lineage(tx.term_counts(chunks, "chunk_id"))
        if reset:
            vocab = tx.fit_vocabulary(counts, "chunk_id", chunks.count())
            terms = sorted((r["term"], r["df"], r["idf"]) for r in vocab.collect())  # at most MAX_FEATURES rows
            numbered = docs.sparkSession.createDataFrame([(t, i, d, f) for i, (t, d, f) in enumerate(terms)],
                                                         "term string, at int, df long, idf double")
            self.tables.replace(numbered, self.vocabulary)
            notes = {"backend": BACKEND, "dim": len(terms), "digest": self._digest(self._vocabulary())}
        else:
            notes = self.check()
        rows = self._vectors(chunks, counts)
        return self.tables.replace(rows, self.name, notes) if reset else self.tables.append(rows, self.name, notes)

    def _vectors(self, chunks: DataFrame, counts: DataFrame, id_col: str = "chunk_id") -> DataFrame:
        vocab = self._vocabulary()
        weights = tx.tfidf_from_counts(counts, id_col, vocab).join(F.broadcast(vocab.select("term", "at")), "term")
        # a vector has at most as many entries as the vocabulary
        vectors = weights.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("vector"))
        empty = F.array().cast("array<struct<at:int,weight:double>>")
        return chunks.join(vectors, id_col, "left").withColumn("vector", F.coalesce("vector", empty))

    def chunks(self) -> DataFrame:
        return self.tables.read(self.name)

    # ------------------------------------------------------------- T06
    def query(self, questions: DataFrame, k: int = tx.TOP_K, where: dict[str, str] | None = None) -> DataFrame:
        """The k nearest chunks of each question (query_id, text): query_id, chunk_id, rank, distance.

        Always k of them if the index holds k (of the chunks that ``where`` lets through): chunks without
        a common term are at squared distance 2, as is a question without known terms.
        """
        self.check()
        index = self.chunks()
        for key, value in (where or {}).items():
            index = index.filter(F.col("metadata")[key] == value)
        long = index.select("chunk_id", F.explode("vector").alias("v")).select("chunk_id", "v.at", "v.weight")
        vocab = self._vocabulary()
        asked = tx.query_vectors(questions.select("query_id", "text"), vocab).join(
            F.broadcast(vocab.select("term", "at")), "term").select("query_id", F.col("at").cast("string").alias("term"), "weight")
        near = tx.top_k_sparse(long.withColumn("term", F.col("at").cast("string")), asked, "chunk_id", k)
        # whatever is missing: the first chunks by id that a question has not got yet, all at distance 2
        fill = [r["chunk_id"] for r in index.select("chunk_id").orderBy("chunk_id").limit(2 * k).collect()]
        have = near.groupBy("query_id").agg(F.collect_set("chunk_id").alias("got"))
        rest = (questions.select("query_id").join(have, "query_id", "left")
                .withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
                .filter(F.size("got") < k)
                .select("query_id", F.size("got").alias("n"), F.posexplode(
                    F.slice(F.array_except(F.array(*[F.lit(c) for c in fill]).cast("array<string>"), F.col("got")),
                            F.lit(1), F.lit(k) - F.size("got"))).alias("i", "chunk_id")))
        more = rest.select("query_id", "chunk_id", F.lit(2.0).alias("distance"), (F.col("n") + F.col("i") + 1).cast("int").alias("rank"))
        return near.select("query_id", "chunk_id", "distance", "rank").unionByName(more)
