"""Blocks of a document, their headings, sections and frozen kinds.

Which block is a heading depends on the block alone; a running window carries
the section forward; what is frozen depends on both. One shuffle on doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

MOST_WORDS = 8
MARKDOWN = r"^#{1,6}\s+(.+?)\s*#*$"
NUMBERED = r"^\d+(?:\.\d+)*\.?\s+(.+)$"
ROMAN = r"^([IVXLCDM]+)\.?\s+(.+)$"
CANONICAL = r"^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
CAPITALS = r"^[A-Z][A-Z0-9 &/\-]{2,}$"
CAPTION = r"(?i)^(?:Table|Tab\.|Figure|Fig\.)\s*\d+"
MATH = r"(?s)^(?:\$\$.+\$\$|\\\[.+\\\]|\$[^$]+\$|\\begin\{[^}]*\}.*\\end\{[^}]*\})$"
TABLE = r"\\begin\{(?:table|tabular)\*?\}"


def blocks(text: Column) -> Column:
    """Paragraphs between blank lines; CRLF counts as a line feed."""
    return T.paragraphs(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"))


def _words(line: Column) -> Column:
    return F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")


def titlelike(title: Column) -> Column:
    t = T.strip(title)
    return (t != "") & ~t.rlike(r"(?U)^\p{Ll}") & ~t.rlike("[.!?;]$") & (F.size(_words(t)) <= MOST_WORDS)


def title_case(line: Column) -> Column:
    w = _words(line)
    capital = lambda x: x.rlike(r"^\p{Lu}")
    inner = F.forall(w, lambda x: capital(x) | F.lower(x).isin(L.TITLE_SMALL))
    return (line != "") & ~line.rlike("[.!?;:]$") & (F.size(w) <= MOST_WORDS) & capital(F.get(w, F.lit(0))) & capital(F.element_at(w, -1)) & inner


def heading_title(block: Column) -> Column:
    """The title if the block is a heading, else null."""
    b = T.strip(block)
    numbered = F.regexp_extract(b, NUMBERED, 1)
    roman, after = F.regexp_extract(b, ROMAN, 1), F.regexp_extract(b, ROMAN, 2)
    shout = b.rlike(CAPITALS) & (F.size(_words(b)) <= MOST_WORDS)
    return (
        F.when((b == "") | b.contains("\n"), F.lit(None).cast("string"))
        .when(b.rlike(MARKDOWN), F.regexp_extract(b, MARKDOWN, 1))
        .when((numbered != "") & titlelike(numbered), numbered)
        .when((roman != "") & roman.rlike(CANONICAL) & titlelike(after), after)
        .when(shout, b)
        .when(title_case(b), b)
    )


def canonical_section(title: Column) -> Column:
    t = F.lower(F.regexp_replace(T.strip(title), "[:.]+$", ""))
    (name, keys), *rest = L.SECTIONS
    out = F.when(t.rlike(T.any_of(keys, "(?U)")), name)
    for name, keys in rest:
        out = out.when(t.rlike(T.any_of(keys, "(?U)")), name)
    return out.otherwise("other")


def frozen_kind(text: Column, section: Column) -> Column:
    return (
        F.when(section == "references", "reference")
        .when(text.rlike(CAPTION), "caption")
        .when(text.rlike(MATH), "equation")
        .when(text.rlike(TABLE), "table")
        .when(text.rlike(r"(?m)^\s*\|.*\|\s*$"), "table")
    )


def intensity(section: Column, asked: str = "balanced") -> Column:
    """Methods and results are always rewritten conservatively."""
    return F.when(section.isin(L.TIGHT_SECTIONS), "conservative").otherwise(asked)


def segments(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, seg_idx, text, section, heading, frozen, kind); section is null in a document without headings."""
    rows = T.each(docs, [key], blocks(F.col(text)), "seg_idx", "text")
    rows = rows.withColumn("title", heading_title(F.col("text"))).withColumn("heading", F.col("title").isNotNull())
    upto = Window.partitionBy(key).orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("section", F.last(F.when(F.col("heading"), canonical_section(F.col("title"))), ignorenulls=True).over(upto))
    kind = F.when(F.col("heading"), F.lit("heading")).otherwise(F.coalesce(frozen_kind(F.col("text"), F.col("section")), F.lit("paragraph")))
    return rows.withColumn("kind", kind).withColumn("frozen", F.col("kind") != "paragraph").select(key, "seg_idx", "text", "section", "heading", "frozen", "kind")


def with_text(segs: DataFrame, text: Column) -> DataFrame:
    """Segments with another text. Frozen ones refuse to change."""
    held = F.col("frozen") & ~text.eqNullSafe(F.col("text"))
    refuse = F.raise_error(F.format_string("segment %s is frozen and cannot be rewritten", F.col("seg_idx").cast("string")))
    return segs.withColumn("text", F.when(held, refuse.cast("string")).otherwise(text))


def segment_report(segs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts per document, and a message (else null) where no heading gives sections."""
    out = segs.groupBy(key).agg(F.count("*").alias("segments"), F.count_if("heading").alias("headings"), F.count_if("frozen").alias("frozen"), F.bool_or("heading").alias("section_aware"))
    return out.withColumn("message", F.when(~F.col("section_aware"), L.NO_HEADINGS))
