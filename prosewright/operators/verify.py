"""Fidelity checks of a rewrite: hard gates and soft flags, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from .claims import claim_array
from .protection import TOKEN, missing_spans, protect, substring_count

DRIFT = "array<struct<kind:string,before:string,after:string,before_hedge:int,after_hedge:int>>"


def pair_segments(original: DataFrame, rewritten: DataFrame, key: str = "doc_id") -> DataFrame:
    """Segments side by side, by place; ``mismatch`` where a document's counts differ."""
    o = original.select(key, "seg_idx", "section", F.col("frozen").alias("_fo"), F.col("text").alias("original"))
    r = rewritten.select(key, "seg_idx", F.col("frozen").alias("_fr"), F.col("text").alias("rewritten"))
    both = o.join(r, [key, "seg_idx"], "full_outer").withColumn("frozen", F.coalesce("_fo", F.lit(False)) | F.coalesce("_fr", F.lit(False)))
    lone = F.max(F.col("_fo").isNull() | F.col("_fr").isNull())
    bad = both.groupBy(key).agg(lone.alias("mismatch"))
    return both.drop("_fo", "_fr").join(bad, key)


def tokens(claim: Column) -> Column:
    """Distinct lower-case words of a claim's subject and object; a comma is a blank."""
    joined = F.replace(F.lower(F.concat_ws(" ", claim["subject"], claim["object"])), F.lit(","), F.lit(" "))
    return F.array_distinct(F.filter(F.split(joined, r"(?U)\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.when(union > 0, union))


def tagged(text: Column) -> Column:
    """The claims of a text with their place, hedge, sentence and tokens."""
    return F.transform(claim_array(text), lambda c, i: F.struct(i.alias("i"), c["hedge"].alias("h"), c["sentence"].alias("s"), tokens(c).alias("t")))


def claim_drift(df: DataFrame, original: str = "original", rewritten: str = "rewritten") -> DataFrame:
    """Adds ``drift``, an array DRIFT. Each claim takes its most similar unused claim of the rewrite (first on ties), in order."""
    keep = df.columns
    df = df.withColumn("_before", tagged(F.coalesce(original, F.lit("")))).withColumn("_after", tagged(F.coalesce(rewritten, F.lit(""))))
    before, after = F.col("_before"), F.col("_after")
    start = F.array().cast("array<struct<i:int,j:int,s:double>>")
    none = F.struct(F.lit(-1).alias("j"), F.lit(0.0).alias("s"))

    def take(done: Column, b: Column) -> Column:
        free = F.filter(after, lambda a: ~F.exists(done, lambda d: d["j"] == a["i"]))
        scored = F.transform(free, lambda a: F.struct(a["i"].alias("j"), jaccard(b["t"], a["t"]).alias("s")))
        best = F.aggregate(scored, none, lambda m, a: F.when(a["s"] > m["s"], a).otherwise(m))
        put = lambda m: F.struct(b["i"].alias("i"), F.when(m["s"] >= L.ALIGN_CLAIMS, m["j"]).otherwise(-1).alias("j"), m["s"].alias("s"))
        return F.concat(done, F.array(T.let(best, put)))

    df = df.withColumn("_matched", F.aggregate(before, start, take))
    flag = lambda kind, b, a, hb, ha: F.struct(kind.alias("kind"), b.alias("before"), a.alias("after"), hb.alias("before_hedge"), ha.alias("after_hedge"))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("int")

    def told(m: Column) -> Column:
        b, a = F.get(before, m["i"]), F.get(after, m["j"])
        kind = F.when(m["j"] < 0, "dropped").when(a["h"] > b["h"], "strengthened").when(a["h"] < b["h"], "weakened")
        return flag(kind, b["s"], a["s"], b["h"], a["h"])

    kept = F.filter(F.transform("_matched", told), lambda f: f["kind"].isNotNull())
    extra = F.filter(after, lambda a: ~F.exists("_matched", lambda m: m["j"] == a["i"]))
    extra = F.transform(extra, lambda a: flag(F.lit("added"), text, a["s"], number, a["h"]))
    return df.withColumn("drift", F.concat(kept, extra).cast(DRIFT)).select(*keep, "drift")


def tolerance(section: Column) -> Column:
    return F.when(section.isin(L.TIGHT_SECTIONS), 0.2).otherwise(0.5)


def sentence_flag(original: Column, rewritten: Column, section: Column) -> Column:
    """before, after and tolerance where the number of sentences moved too far, else null."""
    counts = F.struct(F.size(T.sentences(original)).alias("before"), F.size(T.sentences(rewritten)).alias("after"), tolerance(section).alias("tolerance"))
    return T.let(counts, lambda c: F.when((c["before"] > 0) & (F.abs(c["after"] - c["before"]) > c["tolerance"] * c["before"]), c))


def fidelity_failures(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, seg_idx, kind, detail) of every breach of the hard gate."""
    mismatch = pairs.filter("mismatch").select(key).distinct().select(key, F.lit(-1).alias("seg_idx"), F.lit("segment_count_mismatch").alias("kind"), F.lit("segment counts differ").alias("detail"))
    fine = pairs.filter("not mismatch")
    frozen = fine.filter(F.col("frozen") & ~F.col("original").eqNullSafe(F.col("rewritten"))).select(key, "seg_idx", F.lit("frozen_changed").alias("kind"), F.lit("frozen segment was modified").alias("detail"))
    lost = missing_spans(fine.filter("not frozen").select(key, "seg_idx", "original", "rewritten"))
    lost = lost.select(key, "seg_idx", F.lit("missing_protected_span").alias("kind"), F.format_string("'%s' present %dx, expected at least %dx", "span", "present", "expected").alias("detail"))
    return mismatch.unionByName(frozen).unionByName(lost)


def claim_flags(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    prose = pairs.filter("not mismatch and not frozen")
    return T.each(claim_drift(prose), [key, "seg_idx"], F.col("drift"), "flag_idx", "f").select(key, "seg_idx", "flag_idx", "f.*")


def sentence_flags(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    prose = pairs.filter("not mismatch and not frozen")
    flag = sentence_flag(F.col("original"), F.col("rewritten"), F.col("section"))
    rows = T.each(prose, [key, "seg_idx", "section"], F.array_compact(F.array(flag)), "_n", "f")
    return rows.select(key, "seg_idx", "section", "f.*")


def whole_pairs(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of whole texts (key, original, rewritten), each as segment 0 without a section, for texts that have no segments."""
    return texts.select(key, F.lit(0).alias("seg_idx"), F.lit(None).cast("string").alias("section"), "original", "rewritten", F.lit(False).alias("frozen"), F.lit(False).alias("mismatch"))


def verify(original: DataFrame, rewritten: DataFrame, key: str = "doc_id") -> DataFrame:
    """:func:`verify_pairs` of two tables of segments."""
    return verify_pairs(pair_segments(original, rewritten, key), key)


def verify_pairs(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, passed, fidelity_failures, claim_flags, sentence_flags) per document; only the hard gate decides ``passed``.

    One pass over the pairs, which are counted where they stand.
    """
    prose = claim_drift(pairs.filter("not mismatch and not frozen"))
    prose = prose.withColumn("_spans", F.filter(F.transform(protect(F.col("original"))["spans"], lambda s: s["span"]), lambda s: ~s.rlike(TOKEN)))
    lost = F.filter(F.array_distinct("_spans"), lambda s: substring_count(F.col("rewritten"), s) < F.size(F.filter("_spans", lambda x: x == s)))
    flag = sentence_flag(F.col("original"), F.col("rewritten"), F.col("section")).isNotNull()
    rows = prose.select(key, F.lit(False).alias("mismatch"), F.size(lost).alias("f"), F.size("drift").alias("c"), flag.cast("int").alias("s"))
    rest = pairs.filter("mismatch or frozen")
    changed = (F.col("frozen") & ~F.col("mismatch") & ~F.col("original").eqNullSafe(F.col("rewritten"))).cast("int")
    rows = rows.unionByName(rest.select(key, "mismatch", changed.alias("f"), F.lit(0).alias("c"), F.lit(0).alias("s")))
    out = rows.groupBy(key).agg(F.max("mismatch").alias("_m"), F.sum("f").alias("_f"), F.sum("c").alias("claim_flags"), F.sum("s").alias("sentence_flags"))
    return out.select(key, (F.col("_f") + F.col("_m").cast("long")).alias("fidelity_failures"), "claim_flags", "sentence_flags").withColumn("passed", F.col("fidelity_failures") == 0)
