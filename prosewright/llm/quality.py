"""Quality rules as a short-circuit cascade.

Each rule rejects documents by a few counts. On a sample each rule's cost (CPU
seconds a document) and selectivity (share rejected) are measured, and rules run
in the order of rejection per cost; a document that one rule rejects is not
shown to the later ones. The order changes the cost, never the verdict.

Null texts count as empty, and empty texts fail ``few_words``. Any length of
text is taken whole. Rows are judged one by one: repeated rows get equal
verdicts, and doc_ids may be null or repeated. An empty table gives an empty
result. ``select_clean`` keeps all columns, whatever their names.

``capitals`` holds A to Z against a to z and all other letters of any script but
Latin capitals (by name), which are on neither side.
"""

from __future__ import annotations

import functools
import time
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Documents on which cost and selectivity are measured.
SAMPLE_ROWS = 2000
WINDOW = 8


def _marks(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL = _marks(b"#*$%&|<>")
BANG = _marks(b"!")
UPPER = _marks(bytes(range(65, 91)))
LOWER = _marks(bytes(range(97, 123)))


#: No letter has a code point from here on.
LETTERS_END = 0x40000


@functools.cache
def other_letters() -> np.ndarray:
    """By code point: letters beyond ASCII, without Latin capitals."""
    out = np.zeros(LETTERS_END, bool)
    for c in range(0x80, LETTERS_END):
        kind = unicodedata.category(chr(c))
        out[c] = kind[0] == "L" and not (kind in ("Lu", "Lt") and unicodedata.name(chr(c)).startswith("LATIN"))
    return out


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters of two to four bytes that begin at ``at``."""
    raw = np.concatenate([data, np.zeros(3, np.uint8)])
    b0, b1, b2, b3 = (raw[at + i].astype(np.int64) for i in range(4))
    b1, b2, b3 = b1 & 63, b2 & 63, b3 & 63
    two, three, four = (b0 & 31) << 6 | b1, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3
    return np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four))


class Texts:
    """Counts over a group of texts, each made when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.have: dict = {}

    def get(self, name: str) -> np.ndarray:
        if name not in self.have:
            self.have[name] = getattr(self, f"_{name}")()
        return self.have[name]

    def subset(self, rows: np.ndarray) -> Texts:
        """The same counts for some rows; what was made is kept."""
        length = np.diff(self.offsets)[rows]
        out = Texts(self.data[K.take_ranges(self.offsets[:-1][rows], length)], np.concatenate([[0], np.cumsum(length)]))
        out.have = {k: v[rows] for k, v in self.have.items() if isinstance(v, np.ndarray) and v.shape == (self.n,)}
        return out

    def _per_text(self, mark: np.ndarray) -> np.ndarray:
        if self.n == 1:  # a long text stands alone
            return np.array([np.count_nonzero(mark)])
        total = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def _words(self) -> tuple:
        return K.words(self.data, self.offsets)

    def _n_words(self) -> np.ndarray:
        return np.bincount(self.get("words")[2], minlength=self.n)

    def _word_chars(self) -> np.ndarray:
        return self._per_text(~K.SPACE[self.data] & ((self.data & 0xC0) != 0x80))

    def _n_symbols(self) -> np.ndarray:
        return self._per_text(SYMBOL[self.data])

    def _n_bangs(self) -> np.ndarray:
        return self._per_text(BANG[self.data])

    def _n_upper(self) -> np.ndarray:
        return self._per_text(UPPER[self.data])

    def _n_lower(self) -> np.ndarray:
        return self._per_text(LOWER[self.data])

    def _n_other_letters(self) -> np.ndarray:
        at = np.flatnonzero(self.data >= 0xC0)
        mark = np.zeros(len(self.data), bool)
        mark[at] = other_letters()[np.minimum(code_points(self.data, at), LETTERS_END - 1)]
        return self._per_text(mark)

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Per text: lines with a word, and how many of those equal an earlier line."""
        if not len(self.data):
            z = np.zeros(self.n, np.int64)
            return z, z
        cut = np.flatnonzero(self.data == 10)
        full = self.offsets[:-1] < self.offsets[1:]
        start = np.union1d(self.offsets[:-1][full], cut + 1)
        start = start[start < len(self.data)]
        end = np.append(start[1:], len(self.data))
        row = np.searchsorted(self.offsets, start, "right") - 1
        end = np.where((end > start) & (self.data[end - 1] == 10), end - 1, end)
        word = self.get("words")[0]
        keep = np.searchsorted(word, end) > np.searchsorted(word, start)
        start, end, row = start[keep], end[keep], row[keep]
        h = K.span_hashes(self.data, start, end)
        n = np.bincount(row, minlength=self.n)
        key, bits = K.pack_row(row, h, self.n)
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        distinct = np.bincount((key >> K.U(bits)).astype(np.int64), minlength=self.n)
        return n, n - distinct

    def _n_lines(self) -> np.ndarray:
        return self.get("lines")[0]

    def _n_dup_lines(self) -> np.ndarray:
        return self.get("lines")[1]

    def _n_repeat_words(self) -> np.ndarray:
        """Words in windows of WINDOW words that the text holds twice or more."""
        start, end, row = self.get("words")
        n = self.get("n_words")
        out = np.zeros(self.n, np.int64)
        if len(start) < WINDOW:
            return out
        h = K.span_hashes(self.data, start, end)
        k = len(start) - WINDOW + 1
        w = np.zeros(k, K.U)
        for j in range(WINDOW):
            w += h[j : j + k] * K.powers(K.BASE_2, WINDOW)[j]
        first = np.flatnonzero(row[:k] == row[WINDOW - 1 :])
        w = K.mix(w[first] + K.mix(row[first].astype(K.U) + K.BASE))
        s = np.sort(w)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if not len(twice):
            return out
        hit = first[twice[np.minimum(np.searchsorted(twice, w), len(twice) - 1)] == w]
        change = np.zeros(len(start) + 1, np.int64)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + WINDOW, -1)
        return np.bincount(row, weights=np.cumsum(change[:-1]) > 0, minlength=self.n).astype(np.int64) if n.sum() else out


#: Each rule: the documents it rejects.
RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    "few_words": lambda t: t.get("n_words") < 20,
    "repeated_words": lambda t: 100 * t.get("n_repeat_words") > 30 * t.get("n_words"),
    "symbols": lambda t: 100 * t.get("n_symbols") > 10 * t.get("n_words"),
    "shouting": lambda t: 100 * t.get("n_bangs") > 50 * t.get("n_words"),
    "capitals": lambda t: t.get("n_upper") > 2 * (t.get("n_lower") + t.get("n_other_letters")),
    "repeated_lines": lambda t: 100 * t.get("n_dup_lines") > 50 * t.get("n_lines"),
    "long_words": lambda t: t.get("word_chars") > 30 * t.get("n_words"),
}


def cascade(texts: Texts, order: Sequence[str], tally: dict | None = None) -> np.ndarray:
    """Per text: the place in ``order`` of the first rule that rejects it, -1 if none does."""
    verdict = np.full(texts.n, -1)
    rows, at = np.arange(texts.n), texts
    for i, name in enumerate(order):
        if not len(rows):
            break
        began = time.thread_time()
        bad = RULES[name](at)
        if tally is not None:
            n, out, s = tally.get(name, (0, 0, 0.0))
            tally[name] = (n + len(rows), out + int(bad.sum()), s + time.thread_time() - began)
        verdict[rows[bad]] = i
        if bad.any():
            keep = np.flatnonzero(~bad)
            rows, at = rows[keep], at.subset(keep)
    return verdict


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per rule: documents seen, documents rejected, CPU seconds; each rule on its own."""
    tally: dict = {}
    for batch in batches:
        data, offsets = K.columns(batch, "text")
        for lo, hi in K.groups(offsets):
            for name in RULES:
                cascade(Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), [name], tally)
    yield pa.RecordBatch.from_pylist([{"rule": k, "n": n, "bad": b, "s": s} for k, (n, b, s) in tally.items()], schema=pa.schema([("rule", pa.string()), ("n", pa.int64()), ("bad", pa.int64()), ("s", pa.float64())]))


def rule_order(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rules by share rejected per CPU second, measured on about ``sample_rows`` documents."""
    step = max(1, docs.count() // sample_rows)
    sample = docs.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.octet_length(F.col("text").cast("string"))), F.lit(step)) == 0).select(F.col("text").cast("string").alias("text"))
    seen = sample.mapInArrow(_measure, "rule string, n long, bad long, s double").groupBy("rule").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("s").alias("s")).collect()
    score = {r["rule"]: r["bad"] / max(1, r["n"]) / max(1e-9, r["s"] / max(1, r["n"])) for r in seen}
    return sorted(RULES, key=lambda k: -score.get(k, 0.0))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, kept, failed_rule (null if kept)."""
    order = list(order or rule_order(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.columns(batch, "text")
            for lo, hi in K.groups(offsets):
                t = Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                count = {c: t.get(c).astype(np.int64) for c in COUNTS}
                base = (count["n_words"] < 20) | (100 * count["n_repeat_words"] > 30 * count["n_words"])
                verdict = cascade(t, order)
                rule = pa.array([order[v] if v >= 0 else None for v in verdict], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *map(pa.array, count.values()), pa.array(base), pa.array(verdict < 0), rule], names=["doc_id", *COUNTS, "base_failed", "kept", "failed_rule"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, failed_rule string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def select_clean(docs: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    order = list(order or rule_order(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.columns(batch, "text")
            for lo, hi in K.groups(offsets):
                verdict = cascade(Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), order)
                yield batch.slice(lo, hi - lo).filter(pa.array(verdict < 0))

    return docs.mapInArrow(run, docs.schema)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
           FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
dup AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) >= 2),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN dup USING (doc_id, g)) GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, len(regexp_extract_all(text, '!')) AS bangs,
             len(regexp_extract_all(text, '[A-Z]')) AS upper, len(regexp_extract_all(text, '[a-z]')) AS lower,
             len(regexp_extract_all(text, '\\p{L}')) - len(regexp_extract_all(text, '[A-Za-z]'))
             - len(list_filter(regexp_extract_all(text, '[\\p{Lu}\\p{Lt}]'), lambda x: regexp_matches(x, '\\p{Latin}')
                               AND NOT regexp_matches(x, '[A-Z\\x{212A}\\x{212B}\\x{2132}\\x{2183}\\x{FF21}-\\x{FF3A}]'))) AS other
      FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * bangs > 50 * n_words OR upper > 2 * (lower + other)
            OR 100 * n_dup_lines > 50 * n_lines OR word_chars > 30 * n_words) AS kept
FROM b
"""
