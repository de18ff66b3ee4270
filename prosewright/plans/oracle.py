"""SQL that DuckDB runs, for the registered queries.

Its regular expressions have no lookarounds and ASCII word boundaries, so
sentences are found by a marker and glued again after abbreviations, and words
by lists of letters and digits.
"""

from __future__ import annotations

import re

from ..functions import lexicons as L
from .drafts import DRAFTS, rewrites

ABBR = "|".join(re.escape(a) for a in L.ABBREVIATIONS)
GLUE = rf"(^|[^\p{{L}}\p{{N}}_])({ABBR}|[A-Za-z])\.$"
DRAFT_CTE = f"drafts AS ({DRAFTS})"
PAIR_CTE = f"{DRAFT_CTE}, pairs AS ({rewrites()})"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(entries: list[str]) -> str:
    return "(" + ", ".join(map(quote, entries)) + ")"


def sentences(source: str, keys: str, text: str = "text", name: str = "sents") -> str:
    """CTEs that end in ``name``(keys, sent_idx, s)."""
    return rf"""
{name}_f AS (SELECT {keys}, trim(regexp_replace(coalesce({text}, ''), '\s+', ' ', 'g')) AS t FROM {source}),
{name}_p AS (SELECT {keys}, unnest(p) AS part, generate_subscripts(p, 1) AS i
  FROM (SELECT {keys}, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM {name}_f WHERE t <> '')),
{name}_g AS (SELECT *, coalesce(lag(regexp_matches(part, {quote(GLUE)}, 'i')) OVER (PARTITION BY {keys} ORDER BY i), false) AS glue FROM {name}_p),
{name}_n AS (SELECT *, sum(CASE WHEN glue THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY i) AS grp FROM {name}_g),
{name} AS (SELECT {keys}, CAST(grp - 1 AS BIGINT) AS sent_idx, string_agg(part, ' ' ORDER BY i) AS s FROM {name}_n GROUP BY {keys}, grp)"""


WORDS = "regexp_extract_all({t}, '[A-Za-z][A-Za-z''-]*')"


def words(t: str) -> str:
    return WORDS.format(t=t)


def count_words(t: str, entries: list[str]) -> str:
    """Occurrences of single words as whole words."""
    return f"len(list_filter(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x IN {listed(entries)}))"


def count_phrases(t: str, entries: list[str]) -> str:
    """Occurrences of whole phrases (ASCII letters at their ends)."""
    parts = [f"len(regexp_extract_all(lower({t}), {quote(chr(92) + 'b' + re.escape(e).replace(chr(92) + ' ', ' ') + chr(92) + 'b')}))" for e in entries if " " in e]
    return " + ".join([count_words(t, [e for e in entries if " " not in e]), *parts])


def count_plain(t: str, entries: list[str]) -> str:
    return " + ".join(f"CAST((length(lower({t})) - length(replace(lower({t}), {quote(e)}, ''))) / {len(e)} AS INT)" for e in entries)


NOMINAL = "(" + "|".join(L.NOMINAL_ENDINGS) + ")$"
BE = "|".join(L.BE_FORMS)
PASSIVE = rf"(^|[^\p{{L}}\p{{N}}_])({BE})(\s+[\p{{L}}\p{{N}}_]+){{0,2}}\s+([\p{{L}}\p{{N}}_]+ed|{'|'.join(L.PARTICIPLES)})($|[^\p{{L}}\p{{N}}_])"
TRICOLON = r"[^,.;:!?()\n]+,\s+[^,.;:!?()\n]+,\s+(and|or)\s+[^,.;:!?()\n]+"


def per_document(source: str) -> str:
    """CTEs that end in ``figures``: one row per doc_id with lengths and ratios of its sentences."""
    return f"""{sentences(source, 'doc_id')},
per AS (SELECT doc_id, sent_idx, s, len({words('s')}) AS n, regexp_matches(lower(s), {quote(PASSIVE)}) AS passive,
               1 + len(list_filter({words('lower(s)')}, lambda x: x IN {listed(L.SUBORDINATORS)})) AS depth FROM sents),
agg AS (SELECT doc_id, count(*) AS n_sentences, avg(n) FILTER (n > 0) AS mean_length, min(n) FILTER (n > 0) AS min_length, max(n) FILTER (n > 0) AS max_length,
               var_pop(n) FILTER (n > 0) AS length_variance, count(*) FILTER (passive) AS n_passive, avg(depth) AS clause_depth FROM per GROUP BY doc_id),
figures AS (SELECT d.doc_id, d.text, {words("coalesce(d.text, '')")} AS w, coalesce(n_sentences, 0) AS n_sentences, coalesce(mean_length, 0) AS mean_length,
                   coalesce(min_length, 0) AS min_length, coalesce(max_length, 0) AS max_length, coalesce(length_variance, 0) AS length_variance,
                   coalesce(n_passive, 0) AS n_passive, coalesce(clause_depth, 0) AS clause_depth FROM {source} d LEFT JOIN agg USING (doc_id)),
nom AS (SELECT *, len(w) AS n_words, len(list_filter(w, lambda x: length(x) > 5 AND regexp_matches(lower(x), {quote(NOMINAL)}))) AS n_nominal FROM figures)"""


CUES = [(c, level) for level, cues in L.CUES for c in cues]
CUE_PATTERN = r"\b(" + "|".join(c.replace(" ", r"\s+") for c, _ in sorted(CUES, key=lambda x: -len(x[0]))) + r")\b"
CUE_LEVEL = "CASE " + " ".join(f"WHEN cue IN {listed(cues)} THEN {level}" for level, cues in L.CUES) + " END"


def claims(source: str, keys: str, text: str, name: str = "claims") -> str:
    """CTEs that end in ``name``(keys, sent_idx, subject, relation, object, hedge, sentence), for ASCII texts."""
    return rf"""{sentences(source, keys, text, name + '_s')},
{name}_m AS (SELECT *, regexp_extract(s, '(?is)^(.*?){CUE_PATTERN}(.*)$', 1) AS a, regexp_extract(s, '(?is)^(.*?){CUE_PATTERN}(.*)$', 2) AS r, regexp_extract(s, '(?is)^(.*?){CUE_PATTERN}(.*)$', 3) AS z FROM {name}_s),
{name}_c AS (SELECT *, regexp_replace(lower(r), '\s+', ' ', 'g') AS cue, trim(regexp_replace(trim(z), '[.!?]+$', '')) AS o FROM {name}_m WHERE r <> ''),
{name} AS (SELECT {keys}, sent_idx, trim(a) AS subject, r AS relation, o AS object,
   greatest(1, least(5, {CUE_LEVEL} - CAST(len(list_filter(regexp_extract_all(lower(a || r), '[a-z0-9_]+'), lambda x: x IN {listed(L.DOWNTONERS)})) > 0 AS INT)
                                     + CAST(len(list_filter(regexp_extract_all(lower(a || r), '[a-z0-9_]+'), lambda x: x IN {listed(L.BOOSTERS)})) > 0 AS INT))) AS hedge, s AS sentence
   FROM {name}_c WHERE trim(a) <> '' AND o <> '')"""


SMALL = listed(L.TITLE_SMALL)


def segments(source: str = "drafts", keys: str = "doc_id") -> str:
    """CTEs that end in ``segs``, for ASCII texts."""
    titlelike = "({x} <> '' AND NOT regexp_matches({x}, '^[a-z]') AND NOT regexp_matches({x}, '[.!?;]$') AND len(regexp_extract_all({x}, '\\S+')) <= 8)"
    section = "CASE " + " ".join(f"WHEN regexp_matches(lower(regexp_replace(trim(title), '[:.]+$', '')), {quote(chr(92) + 'b(' + '|'.join(k) + ')' + chr(92) + 'b')}) THEN '{n}'" for n, k in L.SECTIONS) + " ELSE 'other' END"
    return rf"""
seg_b AS (SELECT {keys}, unnest(b) AS text, generate_subscripts(b, 1) - 1 AS seg_idx FROM (SELECT {keys}, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS b FROM {source})),
seg_w AS (SELECT *, regexp_extract_all(text, '\S+') AS w, regexp_extract(text, '^\d+(?:\.\d+)*\.?\s+(.+)$', 1) AS numbered, regexp_extract(text, '^([IVXLCDM]+)\.?\s+(.+)$', 1) AS roman, regexp_extract(text, '^([IVXLCDM]+)\.?\s+(.+)$', 2) AS after FROM seg_b),
seg_t AS (SELECT *, CASE WHEN contains(text, chr(10)) THEN NULL
   WHEN regexp_matches(text, '^#{{1,6}}\s+(.+?)\s*#*$') THEN regexp_extract(text, '^#{{1,6}}\s+(.+?)\s*#*$', 1)
   WHEN numbered <> '' AND {titlelike.format(x='numbered')} THEN numbered
   WHEN roman <> '' AND regexp_matches(roman, '^M{{0,4}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})$') AND {titlelike.format(x='after')} THEN after
   WHEN regexp_matches(text, '^[A-Z][A-Z0-9 &/\-]{{2,}}$') AND len(w) <= 8 THEN text
   WHEN NOT regexp_matches(text, '[.!?;:]$') AND len(w) <= 8 AND regexp_matches(w[1], '^[A-Z]') AND regexp_matches(w[-1], '^[A-Z]')
        AND len(list_filter(w, lambda x: NOT (regexp_matches(x, '^[A-Z]') OR lower(x) IN {SMALL}))) = 0 THEN text END AS title FROM seg_w),
seg_s AS (SELECT *, title IS NOT NULL AS heading, last_value(CASE WHEN title IS NOT NULL THEN {section} END IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) AS section FROM seg_t),
seg_k AS (SELECT *, CASE WHEN heading THEN 'heading' WHEN section = 'references' THEN 'reference' WHEN regexp_matches(text, '(?i)^(Table|Tab\.|Figure|Fig\.)\s*\d+') THEN 'caption'
   WHEN regexp_matches(text, '(?s)^(\$\$.+\$\$|\$[^$]+\$)$') THEN 'equation' WHEN regexp_matches(text, '(?m)^\s*\|.*\|\s*$') THEN 'table' ELSE 'paragraph' END AS kind FROM seg_s),
segs AS (SELECT {keys}, CAST(seg_idx AS BIGINT) AS seg_idx, text, section, heading, kind <> 'paragraph' AS frozen, kind FROM seg_k)"""
