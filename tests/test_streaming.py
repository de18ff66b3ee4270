from pyspark.sql import functions as F

from prosewright.operators import segments as G
from prosewright.streaming import streams

TEXT = "# Methods\n\nWe did it well.\n\nResults\n\nIt worked."


def test_streams_equal_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, TEXT, "a"), (2, "No heading here.", "b")], "doc_id long, text string, source string").withColumn("ts", F.lit("2024-01-01 00:05:00").cast("timestamp"))
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name)

    got = run(streams.segment_stream(stream.select("doc_id", "text")), "segs").select("doc_id", "seg_idx", "text", "section", "heading")
    want = G.segments(docs).select("doc_id", "seg_idx", "text", "section", "heading")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert run(streams.style_stream(stream.select("doc_id", "text")), "style").count() == 2
    rows = run(streams.rollup_stream(stream, "ts", "source"), "roll", "update").collect()
    assert {(r["source"], r["n_docs"]) for r in rows} == {("a", 1), ("b", 1)}
