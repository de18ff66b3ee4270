"""End-to-end runs: one model over documents, and many models over the same documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changelog as C
from ..operators import evaluate as E
from ..operators import rewrite as R
from ..operators import segments as G
from ..operators import verify as V


def run_pipeline(docs: DataFrame, make: Callable, intensity: str = "balanced") -> dict[str, DataFrame]:
    """Segment, rewrite, verify and explain (doc_id, text): tables by name; ``audit`` has a row per document and stage."""
    segs = G.segments(docs)
    rows = R.rewrite(segs, make, intensity)
    after = rows.select("doc_id", "seg_idx", "frozen", F.col("rewritten").alias("text"))
    pairs = V.pair_segments(segs, after)
    verdict = V.verify(segs, after)
    report = R.rewrite_report(rows)
    text = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "rewritten"))).alias("s"))  # one document's segments
    stage = lambda df, n, name, ok, items: df.select("doc_id", F.lit(n).alias("stage_idx"), F.lit(name).alias("stage"), ok.alias("ok"), items.cast("long").alias("items"), F.to_json(F.struct(*[c for c in df.columns if c != "doc_id"])).alias("notes"))
    audit = stage(G.segment_report(segs), 1, "segment", F.lit(True), F.col("segments"))
    audit = audit.unionByName(stage(report, 2, "rewrite", F.col("failed") == 0, F.col("rewritten")))
    audit = audit.unionByName(stage(verdict, 3, "verify", F.col("passed"), F.col("fidelity_failures")))
    return {
        "segments": rows, "documents": text.select("doc_id", F.array_join(F.transform("s", lambda x: x["rewritten"]), "\n\n").alias("text")),
        "verdict": verdict, "changelog": C.changelog(pairs.drop("section")), "audit": audit,
    }


def compare(docs: DataFrame, makers: dict[str, Callable], unavailable: dict[str, str] | None = None, voice: DataFrame | None = None, intensity: str = "balanced") -> DataFrame:
    """Candidates of every model for every document, scored and ranked; models that can't run are listed as failed.

    A candidate fails as a whole if one of its segments does.
    """
    segs = G.segments(docs)
    original = docs.select("doc_id", F.col("text").alias("original"))
    out = None
    for n, (model, make) in enumerate(makers.items()):
        rows = R.rewrite(segs, make, intensity)
        per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "rewritten"))).alias("s"), F.bool_or("failed").alias("bad"), F.max("detail").alias("error"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))
        got = per.select("doc_id", F.lit(n).alias("input_pos"), F.lit(model).alias("model_id"), (~F.col("bad")).alias("ok"), "error", F.array_join(F.transform("s", lambda x: x["rewritten"]), "\n\n").alias("rewritten"), "tokens")
        out = got if out is None else out.unionByName(got)
    for n, (model, why) in enumerate((unavailable or {}).items(), len(makers)):
        none = docs.select("doc_id", F.lit(n).alias("input_pos"), F.lit(model).alias("model_id"), F.lit(False).alias("ok"), F.lit(why).alias("error"), F.lit("").alias("rewritten"), F.lit(0).cast("long").alias("tokens"))
        out = none if out is None else out.unionByName(none)
    return E.rank(E.scorecards(out.join(original, "doc_id"), voice))


def console(ranked: DataFrame, doc_id, width: int = 32) -> str:
    """A table of one document's candidates, best first, and the winner's text before and after."""
    rows = ranked.filter(F.col("doc_id") == doc_id).orderBy("rank").collect()  # the models
    line = lambda *cells: "".join(str(c)[: w - 1].ljust(w) for c, w in zip(cells, (5, width, 12, 9, 8, 8), strict=True)).rstrip()
    out = [line("rank", "model", "status", "quality", "tells-", "tokens")]
    for r in rows:
        status = ("best" if r["rank"] == 1 else "passed", "gated", "failed")[r["tier"]]
        quality, less = ("-", "-") if r["tier"] == 2 else (f"{r['quality_rank']:.3f}", r["tells_before"] - r["tells_after"])
        out.append(line(r["rank"], r["model_id"], status, quality, less, r["tokens"]))
        if r["error"]:
            out.append(f"     note: {r['error']}")
    if not rows or rows[0]["tier"]:
        return "\n".join([*out, "", "No candidate passed the fidelity gate."])
    won = rows[0]
    notes = [text for c, text in (("claim_weakened", "note: a claim was weakened"), ("sentence_flag", "note: the number of sentences moved a lot")) if won[c]]
    return "\n".join([*out, "", f"winner: {won['model_id']}", *notes, "", "BEFORE:", won["original"], "", "AFTER:", won["rewritten"]])
