"""The corpus pipeline: five stages from ``documents`` to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and is the next one's ``docs``. All but the last return the
columns of ``docs``.

1. toxicity: documents that the classifier rejects go.
2. line dedup: lines of 20 or more characters in three or more documents stay in
   the largest id alone; other text stays as it is.
3. near duplicates: one document of each group stays, the smallest id.
4. decontamination: documents that hold a window of a benchmark item go.
5. packing: sequences of at most 2048 tokens.

Defined cases: nulls, empty texts, repeated rows, empty tables and extra columns
as the operators state them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slipway.llm import decontaminate, linededup, ngramjoin, packing, toxicity
from slipway.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.rewrite(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, ["doc_id"]))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("two_fit_packing", pack),
]

# The classifier and the packing order cannot be put in SQL; tests run the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
