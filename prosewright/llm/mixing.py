"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Each source has a weight; the whole mix has a size; a source's target stops at
``max_epochs`` times its own size, and what it cannot take is shared among the
others by weight until none is above. The fixed point is found at once: sources
sorted by the level at which they fill up, with prefix sums of capacity and
weight. A document is taken whole ``floor(epochs)`` times; the fraction is a
seeded sample: documents in the order of a hash of seed and doc_id are taken
once more as long as the middle of the document lies below the source's share.
The order is cut by histograms of the hash, so no source is sorted in one task.

Null texts have size 0; rows without a doc_id are ordered by a hash of the text;
repeated rows count as often as they stand there, and each has copies of its own.
A text of any length is a document like others. Sources of size 0 take nothing.
An empty table gives an empty result. The levels are found in one task, which
has a row for each source: there can be millions. Other columns are ignored by
``mix`` and kept by ``repeated``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Cuts, row_ids, small_side

MAX_EPOCHS = 3
SEED = 7
#: Buckets of each of the two histograms of the sampling hash.
BUCKETS = 1024
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE_BEFORE = Window.unboundedPreceding


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rotating_weights(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) with a weight: sources by code point, null last, weigh by turns."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), F.pmod(rank, F.lit(len(cycle))) + 1).cast("double"))


def water_fill(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): the level times the weight, or the capacity."""
    cap = (F.col("source_size") * max_epochs).cast("double")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # the level if this source and all after it are below their capacity
    level = (F.sum("source_size").over(every).cast("double") - full) / rest
    s = sizes.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col("weight") <= cap)
    # the first that fits; sources may tie
    s = s.withColumn("_place", F.row_number().over(order))
    found = F.min(F.when(F.col("_fits"), F.struct("_place", "_level"))).over(every)
    s = s.withColumn("_level", found["_level"])
    return s.withColumn("target", F.coalesce(F.least(F.col("_level") * F.col("weight"), cap), cap)).drop("_level", "_fits", "_place")


def bits(seed: int) -> Column:
    """40 bits of a hash of seed and doc_id (without one, of the text) that any engine can compute."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    return F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("long")


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of each document."""
    return _mix(Cuts(docs.sparkSession), docs, F.lit(0), max_epochs, seed).drop("row")


def _mix(cut: Cuts, docs: DataFrame, row: Column, max_epochs: int, seed: int) -> DataFrame:
    """``mix``, with the rows' numbers."""
    rows = docs.select(row.cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = rows.select("row", "doc_id", "source", n_words(F.col("text")).alias("size"), bits(seed).alias("u"))
    coarse, fine = F.shiftright("u", 30).cast("int"), F.shiftright("u", 20).bitwiseAND(BUCKETS - 1).cast("int")
    rows = cut(rows.withColumn("b1", coarse).withColumn("b2", fine))
    hist = cut(rows.groupBy("source", "b1").agg(F.sum("size").alias("size")))
    sizes = hist.groupBy("source").agg(F.sum("size").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = water_fill(rotating_weights(sizes), max_epochs).withColumn("whole", F.floor(epochs))
    # words that the fractional repetition is to take
    plan = plan.withColumn("want", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("sk", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    plan = cut(plan)
    small = small_side(plan.select("sk", "want"))  # one row per source
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))

    def boundary(table: DataFrame, group: list[str], bucket: str, base: Column) -> DataFrame:
        """The bucket in which the running size passes what is wanted, and the size before it."""
        run = Window.partitionBy("sk", *group).orderBy(bucket)
        t = table.withColumn("below", base + F.sum("size").over(run.rowsBetween(SPACE_BEFORE, Window.currentRow)) - F.col("size"))
        return t.filter("below <= want and want < below + size").select("sk", *group, bucket, "below")

    top = boundary(hist.withColumn("sk", key).join(small, "sk"), [], "b1", F.lit(0))
    top = cut(top.withColumnRenamed("below", "below1"))
    edge = rows.withColumn("sk", key).join(small_side(top), ["sk", "b1"])  # one bucket per source at most
    hist2 = edge.groupBy("sk", "b1", "below1", "b2").agg(F.sum("size").alias("size")).join(small, "sk")
    low = boundary(hist2, ["b1", "below1"], "b2", F.col("below1"))
    low = cut(low)
    last = edge.join(small_side(low.select("sk", "b1", "b2", "below")), ["sk", "b1", "b2"]).join(small, "sk")
    run = Window.partitionBy("sk").orderBy("u", "doc_id", "size", "row").rowsBetween(SPACE_BEFORE, Window.currentRow)
    last = last.withColumn("_from", F.col("below") + F.sum("size").over(run) - F.col("size"))
    last = last.select("row", "doc_id", "source", "size", (F.col("_from") + F.col("size") / 2 < F.col("want")).cast("int").alias("extra"))

    marks = top.select("sk", F.col("b1").alias("e1")).join(low.select("sk", F.col("b2").alias("e2")), "sk", "left")
    named = rows.withColumn("sk", key).join(small_side(plan.drop("source")), "sk").join(small_side(marks), "sk", "left")
    in_last = F.coalesce((F.col("b1") == F.col("e1")) & (F.col("b2") == F.col("e2")), F.lit(False))
    # without a boundary the sample takes nothing (want 0) or, by rounding, all
    under = F.when(F.col("e1").isNull(), F.col("want") > 0).otherwise((F.col("b1") < F.col("e1")) | ((F.col("b1") == F.col("e1")) & (F.col("b2") < F.coalesce("e2", F.lit(BUCKETS)))))
    main = named.filter(~in_last).select("row", "doc_id", "source", "size", under.cast("int").alias("extra"))
    both = main.unionByName(last).withColumn("sk", key).join(small_side(plan.drop("source", "want", "weight")), "sk")
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return both.select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The documents as often as the mix takes them, with the columns of ``docs``."""
    cut = Cuts(docs.sparkSession)
    named, row, _ = row_ids(cut, docs)
    taken = _mix(cut, named, F.col(row), max_epochs, seed).filter("copies > 0")
    times = f"{row}_times"
    out = named.join(taken.select(F.col("row").alias(row), F.col("copies").cast("int").alias(times)), row)
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         ('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 10))::BIGINT AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
      FROM d GROUP BY source),
l AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
             (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
             row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source) AS place
      FROM s),
f AS (SELECT arg_min(level, place) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(f.level * weight, cap) AS target FROM l, f),
r AS (SELECT d.*, t.source_size, t.target, floor(t.target / t.source_size) AS whole,
             sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS below
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN below + size / 2.0 < target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
