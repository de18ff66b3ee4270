"""The rewriting stage: mask, ask a provider, check, retry, restore.

Frozen rows are split off by a filter and never reach Python. A provider is made
once per partition from a picklable factory. Rows fail on their own: a row whose
output loses a placeholder three times, or whose provider fails, keeps its
original text and says so. Spark may run a task twice, so a provider may be
asked twice; results are written before they are read again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..sources.providers import ProviderError, with_retry
from . import protection as P
from .segments import intensity

RESULT = "output string, attempts int, prompt_tokens int, completion_tokens int, failed boolean, detail string"


def voice_directive(profile: Column, exemplar: Column | None = None) -> Column:
    """Numeric targets of a voice profile (a struct of features), as a line of a prompt, and a paragraph of the author's."""
    line = F.format_string("Aim for sentences of %.1f words, %.0f%% of them passive, %.1f hedges and %.1f nominalisations in 100 words.", profile["mean_length"], profile["passive_ratio"] * 100, profile["hedging_density"], profile["nominalisation_rate"])
    if exemplar is not None:
        line = F.concat(line, F.coalesce(F.concat(F.lit(L.EXEMPLAR_HEAD), T.strip(exemplar)), F.lit("")))
    loose = F.concat(F.lit("The sample is short: take this as loose guidance. "), line)
    return F.when(profile["confidence"] == "ok", line).when(profile["confidence"] == "low", loose).otherwise("")


def corrective(masked: str, tokens: list[str], check: dict) -> str:
    """A second request that names what went wrong."""
    told = [f"{name}: {', '.join(check[name])}" for name in ("missing", "duplicated", "unexpected") if check[name]]
    return f"Placeholders were changed ({'; '.join(told)}). Keep each of {' '.join(tokens)} exactly once.\n{masked}"


def check_tokens(output: str, tokens: list[str]) -> dict:
    import re

    found = re.findall(P.TOKEN, output)
    return {"missing": [t for t in tokens if t not in found], "duplicated": [t for t in tokens if found.count(t) > 1], "unexpected": sorted(set(found) - set(tokens))}


def ask(make: Callable, attempts: int = 3):
    """A partition function over (masked, tokens, prompt) columns beside any others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for rows in batches:
            out = []
            for masked, tokens, system in zip(rows["masked"], rows["tokens"], rows["system"], strict=True):
                tokens, prompt = list(tokens), masked
                sent = got = n = 0
                done, detail = None, ""
                for n in range(1, attempts + 1):
                    try:
                        answer = with_retry(lambda p=prompt, s=system: provider.complete(p, s))
                    except ProviderError as e:
                        detail = str(e)
                        break
                    sent, got = sent + answer.prompt_tokens, got + answer.completion_tokens
                    check = check_tokens(answer.text, tokens)
                    if not any(check.values()):
                        done = answer.text
                        break
                    detail = json.dumps(check, ensure_ascii=False)
                    prompt = corrective(masked, tokens, check)
                out.append((done, n, sent, got, done is None, detail if done is None else ""))
            yield pd.concat([rows.reset_index(drop=True), pd.DataFrame(out, columns=["output", "attempts", "prompt_tokens", "completion_tokens", "failed", "detail"])], axis=1)

    return run


def with_voice(segs: DataFrame, voice: DataFrame, exemplar: str = "exemplar") -> DataFrame:
    """Adds ``voice_confidence`` and ``voice_directive`` of a profile of one row, "none" and empty without a row."""
    has = F.col(exemplar) if exemplar in voice.columns else None
    one = voice.limit(1).select(F.col("confidence").alias("voice_confidence"), voice_directive(F.struct(*voice.columns), has).alias("voice_directive"))
    out = segs.join(F.broadcast(one), F.lit(True), "left")  # one row
    return out.withColumns({"voice_confidence": F.coalesce("voice_confidence", F.lit("none")), "voice_directive": F.coalesce("voice_directive", F.lit(""))})


def rewrite(segs: DataFrame, make: Callable, asked: str = "balanced", system: Column | None = None, attempts: int = 3, voice: DataFrame | None = None, refs: list[str] | None = None) -> DataFrame:
    """Segments with ``rewritten``, ``intensity``, ``attempts``, ``failed``, ``detail`` and token counts.

    ``voice``: a profile of one row, whose directive follows the system prompt, and
    adds ``voice_confidence``. ``refs``: the parts of the system prompt, kept as
    ``prompt_refs`` of the segments that were asked for.
    """
    if voice is not None:
        segs = with_voice(segs, voice)
        told = F.col("voice_directive")
        system = told if system is None else F.concat(system, F.when(told != "", F.concat(F.lit("\n\n"), told)).otherwise(""))
        return rewrite(segs, make, asked, system, attempts, refs=refs).drop("voice_directive")
    if refs is not None:
        shown = F.when(F.col("frozen"), F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, refs)).cast("array<string>"))
        return rewrite(segs, make, asked, system, attempts).withColumn("prompt_refs", shown)
    keys = segs.columns
    segs = segs.withColumn("intensity", intensity(F.col("section"), asked))
    prose = segs.filter("not frozen").withColumn("_p", P.protect(F.col("text")))
    prose = prose.select(*keys, "intensity", F.col("_p.masked").alias("masked"), F.col("_p.spans").alias("spans"), P.top_tokens(F.col("_p.spans")).alias("tokens"), (system if system is not None else F.lit("")).alias("system"))
    carried = prose.withColumn("spans", F.to_json("spans"))  # nested rows are slow to convert
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema) + ", " + RESULT
    done = carried.mapInPandas(ask(make, attempts), schema)
    spans = F.from_json("spans", "array<struct<token:string,kind:string,span:string,top:boolean>>")
    done = done.withColumn("rewritten", F.coalesce(P.restore(F.col("output"), spans), F.col("text")))
    new = ["rewritten", "attempts", "prompt_tokens", "completion_tokens", "failed", "detail"]
    done = done.select(*keys, "intensity", *new)
    zero = F.lit(0)
    kept = segs.filter("frozen").select(*keys, "intensity", F.col("text").alias("rewritten"), zero.alias("attempts"), zero.alias("prompt_tokens"), zero.alias("completion_tokens"), F.lit(False).alias("failed"), F.lit("").alias("detail"))
    return done.unionByName(kept)


def rewrite_report(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: segments, rewritten, frozen, failed, retries and tokens; voice and prompt_refs (each once, in order of use) where the rows have them."""
    more = [F.max("voice_confidence").alias("voice")] if "voice_confidence" in rows.columns else []
    if "prompt_refs" in rows.columns:
        used = F.array_sort(F.collect_list(F.struct("seg_idx", "prompt_refs")))  # a document's own segments
        more.append(F.array_distinct(F.flatten(F.transform(used, lambda x: x["prompt_refs"]))).alias("prompt_refs"))
    return rows.groupBy(key).agg(
        F.count("*").alias("segments"), F.count_if(~F.col("frozen") & ~F.col("failed")).alias("rewritten"), F.count_if("frozen").alias("frozen"), F.count_if("failed").alias("failed"),
        F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), *more,
    )
