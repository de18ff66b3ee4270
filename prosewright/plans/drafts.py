"""Scholarly drafts and rewrites made from relational tables, by SQL that any engine runs alike.

Only whole numbers and strings are put into the text, so the same statement
gives the same bytes everywhere. One draft per customer; four providers rewrite it.
"""

from __future__ import annotations

K = "c_custkey"


def pick(n: int, *texts: str, key: str = K) -> str:
    whens = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts[:-1]))
    return f"CASE {key} % {n} {whens} ELSE {texts[-1]} END"


NUM = f"CAST({K} % 97 + 1 AS STRING)"
NUM2 = f"CAST({K} % 31 + 2 AS STRING)"

BLOCKS = [
    pick(5, "'# Introduction'", "'1. Introduction'", "'INTRODUCTION'", "'Background and Related Work'", "'II. Literature Overview'"),
    "(" + pick(
        7,
        f"'Moreover, the utilisation of compound ' || {NUM} || ' may suggest a benefit on dataset [' || {NUM2} || ']. The cells were counted.'",
        f"'However, treatment ' || {NUM} || ' is associated with a robust response. It is important to note that the effect is small, stable, and real.'",
        f"'The samples were washed, the plates were dried, and the cells were stained. We found ' || {NUM} || ' colonies because the medium was fresh.'",
        f"'Furthermore, recent work by Smith et al. reveals a pivotal role of factor ' || {NUM} || '. This finding might tend to hold.'",
        f"'Although the cohort was small, the treatment clearly demonstrates an improvement (p < 0.0' || {NUM2} || '). Perhaps the dose was low.'",
        f"'In addition, see https://example.org/d/' || {NUM} || ' for data. The analysis suggests a link — possibly causal.'",
        f"'Sample ' || {NUM} || ' was taken. Sample ' || {NUM2} || ' was not. The rest is described, e.g. in Fig. 2.'",
    ) + ")",
    pick(4, "'## Methods'", "'Materials and Methods'", "'2.1 Experimental Setup'", "'III. Approach'"),
    f"'We dosed ' || {NUM} || ' mL of buffer in Section ' || {NUM2} || '. The plates were read twice (p < 0.05). The result is linked to dose [' || {NUM} || ', ' || {NUM2} || '].'",
    "(" + pick(3, f"'Table ' || {NUM2} || '. Counts by group'", f"'$$ x = ' || {NUM} || ' + y $$'", f"'| group | ' || {NUM} || ' |'") + ")",
    pick(3, "'Results'", "'# Results and Findings'", "'EVALUATION'"),
    "(" + pick(
        4,
        f"'Treatment ' || {NUM} || ' clearly confirms the effect [' || {NUM2} || ']. The second group shows no change.'",
        f"'Dose ' || {NUM} || ' could lead to toxicity. Controls were stable.'",
        f"'The model is accurate. The baseline is not. The margin is ' || {NUM} || ' points.'",
        f"'Group ' || {NUM} || ' appears to improve. The utilisation of care is unchanged.'",
    ) + ")",
    "'## References'",
    f"'[' || {NUM2} || '] Smith, J. 2020. A study of factor ' || {NUM} || '.'",
]
#: Two drafts in thirteen have no heading.
PLAIN = [BLOCKS[1], BLOCKS[3], BLOCKS[6]]


def joined(blocks: list[str]) -> str:
    return " || chr(10) || chr(10) || ".join(f"({b})" for b in blocks)


DRAFTS = f"SELECT {K} AS doc_id, CASE WHEN {K} % 13 < 2 THEN {joined(PLAIN)} ELSE {joined(BLOCKS)} END AS text FROM customer"

#: What each provider does to a text.
REWRITES = {
    "clean": "replace(replace(replace({t}, 'Moreover, the', 'The'), 'Furthermore, recent', 'Recent'), 'utilisation', 'use')",
    "echo": "{t}",
    "strengthen": "replace(replace({t}, 'may suggest', 'demonstrates'), 'could lead to', 'leads to')",
    "broken": "replace(replace({t}, 'clearly ', ''), ' (p < 0.05)', '')",
}
PROVIDERS = list(REWRITES)


def rewrites(source: str = "drafts", text: str = "text", keys: str = "doc_id") -> str:
    """(keys, input_pos, model_id, original, rewritten) of each provider."""
    parts = [f"SELECT {keys}, {i} AS input_pos, '{name}' AS model_id, {text} AS original, {how.format(t=text)} AS rewritten FROM {source}" for i, (name, how) in enumerate(REWRITES.items())]
    return " UNION ALL ".join(parts)
