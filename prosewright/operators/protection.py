"""Masking of spans that a rewrite must not change, and its checks.

Masking is an Arrow UDF: twelve patterns, each applied to what the ones before
left, with lookarounds. The checks are columns. Unlike a single restoring pass,
:func:`restore` also restores spans that lie inside other masked spans, so a
round trip is always exact. Placeholder-like strings in the input are escaped
first: they are masked as a span of their own kind, ``literal``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L

TOKEN = "⟦P[A-Z]+⟧"
PROTECTED = "masked string, spans array<struct<token:string,kind:string,span:string,top:boolean>>"


def letters(n: int) -> str:
    """A, B, .. Z, AA, AB, ..: names without digits, so that no number pattern sees them."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def mask_text(text: str, patterns: list) -> dict:
    """The masked text and its spans in the order of their making; ``top``: the token is in the masked text itself."""
    spans: list[list] = []

    def put(kind: str):
        def swap(m: re.Match) -> str:
            got = m.group(0)
            if kind == "alnum_token" and not (re.search(r"[^\W\d_]", got) and re.search(r"\d", got)):
                return got
            token = f"⟦P{letters(len(spans))}⟧"
            spans.append([token, kind, got, True])
            return token

        return swap

    for kind, pattern in patterns:
        text = pattern.sub(put(kind), text)
    left = set(re.findall(TOKEN, text))
    return {"masked": text, "spans": [{"token": t, "kind": k, "span": s, "top": t in left} for t, k, s, _ in spans]}


def patterns() -> list:
    return [("literal", re.compile(TOKEN)), *[(k, re.compile(p)) for k, p in L.SPANS]]


def protect(text: Column) -> Column:
    """A struct PROTECTED of a text; null stays null."""

    @F.pandas_udf(PROTECTED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled = patterns()
        for texts in batches:
            rows = [mask_text(t, compiled) if isinstance(t, str) else {"masked": None, "spans": None} for t in texts]
            yield pd.DataFrame(rows, columns=["masked", "spans"])

    return run(text)


def restore(output: Column, spans: Column) -> Column:
    """Tokens replaced by their spans, last made first, as later spans may hold earlier tokens."""
    return F.aggregate(F.reverse(spans), output, lambda t, s: F.replace(t, s["token"], s["span"]))


def found_tokens(output: Column) -> Column:
    return F.regexp_extract_all(output, F.lit(f"({TOKEN})"), F.lit(1))


def integrity(output: Column, tokens: Column) -> Column:
    """ok, and the tokens that are missing, duplicated or unexpected."""
    found = found_tokens(output)
    times = lambda t: F.size(F.filter(found, lambda x: x == t))
    missing, twice = F.filter(tokens, lambda t: times(t) == 0), F.filter(tokens, lambda t: times(t) > 1)
    unexpected = F.array_sort(F.array_except(found, tokens))
    ok = (F.size(missing) == 0) & (F.size(twice) == 0) & (F.size(unexpected) == 0)
    return F.struct(ok.alias("ok"), missing.alias("missing"), twice.alias("duplicated"), unexpected.alias("unexpected"))


def top_tokens(spans: Column) -> Column:
    return F.transform(F.filter(spans, lambda s: s["top"]), lambda s: s["token"])


def restore_verified(output: Column, spans: Column) -> Column:
    """The restored text; an error that names the tokens if the integrity check fails."""
    check = integrity(output, top_tokens(spans))
    said = F.concat(F.lit("placeholder integrity failed: dropped "), F.to_json(check["missing"]), F.lit(", duplicated "), F.to_json(check["duplicated"]), F.lit(", invented "), F.to_json(check["unexpected"]))
    return F.when(check["ok"], restore(output, spans)).otherwise(F.raise_error(said))


def substring_count(text: Column, part: Column) -> Column:
    return F.when(part != "", (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(0).cast("int")


def missing_spans(pairs: DataFrame, original: str = "original", rewritten: str = "rewritten") -> DataFrame:
    """One row per distinct protected span of the original that the rewrite holds fewer times; its other columns are kept."""
    keys = [c for c in pairs.columns if c not in (original, rewritten)]
    spans = F.transform(protect(F.col(original))["spans"], lambda s: s["span"])
    rows = pairs.withColumn("_spans", spans)
    rows = rows.withColumn("span", F.explode(F.array_distinct("_spans")))
    # a span that holds tokens of inner spans stands for its restored text, whose parts are checked on their own
    rows = rows.filter(~F.col("span").rlike(TOKEN)).withColumn("expected", F.size(F.filter("_spans", lambda s: s == F.col("span"))))
    rows = rows.withColumn("present", substring_count(F.col(rewritten), F.col("span")))
    return rows.filter("present < expected").select(*keys, "span", "expected", "present")


def span_counts(text: Column, kinds: list[str]) -> dict[str, Column]:
    """Spans of kinds that no earlier pattern touches, counted without leaving the JVM."""
    return {k: F.regexp_count(text, F.lit("(?U)" + p)) for k, p in L.SPANS if k in kinds}
