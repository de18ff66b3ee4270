"""Structured Streaming: stateless projections, folds for sections, windowed rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import segments as G
from ..operators import stylometry as S


def section_fold(text: Column) -> Column:
    """Blocks of a document with their section, as an array: the window of the batch form, as a fold."""
    blocks = F.transform(G.blocks(text), lambda b: F.struct(b.alias("text"), G.heading_title(b).alias("title")))
    item = "struct<text:string,heading:boolean,section:string>"
    start = F.array().cast(f"array<{item}>")

    def step(done: Column, b: Column) -> Column:
        before = F.get(done, F.size(done) - 1)["section"]
        section = F.when(b["title"].isNotNull(), G.canonical_section(b["title"])).otherwise(before)
        return F.concat(done, F.array(F.struct(b["text"].alias("text"), b["title"].isNotNull().alias("heading"), section.alias("section")).cast(item)))

    return F.aggregate(blocks, start, step)


def segment_stream(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per block of a stream of documents; no state."""
    keys = [c for c in docs.columns if c != text]
    return docs.select(*keys, F.posexplode_outer(section_fold(F.col(text))).alias("seg_idx", "_s")).filter("seg_idx is not null").select(*keys, "seg_idx", "_s.*")


def style_stream(docs: DataFrame, text: str = "text") -> DataFrame:
    """The style report of each document of a stream; no state."""
    return S.style_report(docs, text).drop(text)


def rollup_stream(docs: DataFrame, ts: str, by: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Documents and words per window and key; rows later than the watermark are dropped."""
    sized = docs.withColumn("_n", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z][A-Za-z'-]*"), F.lit(0))))
    return sized.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.count("*").alias("n_docs"), F.sum("_n").alias("n_words"))
