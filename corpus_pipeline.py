"""A corpus from raw documents: rules, lines, near-duplicates, mix, sequences.

Rows without a doc_id, or with one that others have too, are documents of their
own in every stage. Null and empty texts fail the rules. An empty table passes
through as one. Extra columns, whatever their names, are kept by all stages but
the last. Ties and repeated rows: see each operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.llm import line_dedup, minhash, mixing, packing, quality
from prosewright.llm.shared import drop_path, remember, scope, shared_dir


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.select_clean(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line but the first of its component goes; documents that lose all their words with them go."""
    out, _, gone = line_dedup.dedup_lines(docs)
    return out.filter((F.size(gone) == 0) | F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: one row per part of a document."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_clean),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", one_of_each),
    ("mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: Similarities of all pairs and best-fit packing aren't SQL's to express on whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = remember(spark, f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}")
        with scope():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(before)
        docs, before = spark.read.parquet(path), path
    return docs
