"""Contiguous shards of near-equal bytes, by global prefix sums. DataFrame functions only.

Documents are ordered by (doc_id, crc32 of the text, size), nulls first. A range
shuffle sorts slim rows, without texts; each partition's totals give its offset,
and a document belongs to the shard in whose equal share of all bytes the middle
of the document lies. Equal rows may lie in any order among themselves, which
gives the same result. A null doc_id stands before all others; a text of any
length is one row of one shard. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Cuts

SHARDS = 24
#: Bytes of a row beside its text.
HEADER = 8
ORDER = ["doc_id", "text_crc32", "size"]


def shards(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, byte_start) of each document.

    A null text has size HEADER and the checksum of no bytes, 0.
    """
    cut = Cuts(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + HEADER).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    # written down, so that totals and rows see the same partitions
    part = cut(slim.repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id()))
    ends = part.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"), F.sum("bytes").over(whole).alias("total"))
    inside = Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = part.withColumn("bytes_in", F.sum("size").over(inside)).withColumn("row_in", F.count("*").over(inside))
    rows = rows.join(ends, "part").withColumn("byte_start", F.col("bytes0") + F.col("bytes_in") - F.col("size"))
    # whole numbers: twice the middle of the document, times shards, over twice the total
    wide = "decimal(30,0)"
    middle = (F.col("byte_start").cast(wide) * 2 + F.col("size")) * F.lit(n_shards).cast("decimal(6,0)")
    rows = rows.withColumn("_middle", middle.cast("decimal(38,0)")).withColumn("_twice", F.col("total").cast(wide) * 2)
    rows = rows.withColumn("shard", F.expr("cast(_middle div _twice as int)"))
    rows = rows.withColumn("row", F.col("rows0") + F.col("row_in") - 1)
    rows = cut(rows.select(*ORDER, "shard", "row", "byte_start"))
    first = rows.groupBy("shard").agg(F.min("row").alias("first"))
    return rows.join(F.broadcast(first), "shard").select(  # n_shards rows at most
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("byte_start").cast("long").alias("byte_start"),
    )


#: CRC-32 by its table of 256 entries, folded over the bytes; whole-number division.
ORACLE = """
WITH RECURSIVE steps AS (
  SELECT i::BIGINT AS i, 0 AS n, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, n + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END FROM steps WHERE n < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE n = 8),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, size, list_transform(range(strlen(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) AS b FROM d),
c AS (SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a // 256, t[(xor(a, x) % 256) + 1])))::BIGINT AS text_crc32 FROM b, crc),
r AS (SELECT *, row_number() OVER o AS row, CAST(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS HUGEINT) AS start, CAST(sum(size) OVER () AS HUGEINT) AS total
      FROM c WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)),
s AS (SELECT *, CAST(((2 * start + size) * 24) // (2 * total) AS INT) AS shard FROM r)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY row) - 1 AS slot, CAST(NULL AS INT) AS grown_shard, CAST(start AS BIGINT) AS byte_start
FROM s
"""
