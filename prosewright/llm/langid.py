"""Language identification by a string kernel.

Texts are compared by the byte n-grams, n = 1 to 3, that they hold at all (a
blended-spectrum presence kernel, normalised). Landmark texts give a Nystroem
map; one-versus-rest kernel ridge regression is fitted on it; a batch of texts
is scored by two matrix products, texts by landmarks and landmarks by languages.

The fit sees at most FIT_PER_LANG documents of a language and FIT_ROWS in all,
chosen by a hash, among those with a text, a lang, and crc32(doc_id as text) mod
3 other than 1. (Twice FIT_ROWS bound what the driver may get. Only thousands of
equal rows can reach that, and then any of the chosen rows are left out.) Whole texts are read in the fit and in the prediction. Texts
that are null or without a letter, and all texts if nothing can be learned, are
``und`` with score 0. Repeated rows get equal answers. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

WIDTH = 13  # n-grams are hashed to 2 ** WIDTH columns
FIT_PER_LANG = 600
FIT_ROWS = 6000
LANDMARKS = 256
RIDGE = 1e-3
ROWS = 512  # texts a matrix product

#: Letters in lower case (ASCII) and other bytes above 127 as they are; runs of anything else are one blank.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, 2 ** WIDTH) of 0 and 1: which n-grams each text holds."""
    n = len(offsets) - 1
    out = np.zeros((n, 1 << WIDTH), np.float32)
    flat = out.ravel()
    fold = FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) << WIDTH, np.diff(offsets))
    end = np.repeat(offsets[1:], np.diff(offsets))
    gram = np.zeros(len(fold), np.uint32)
    for k in range(3):
        m = len(fold) - k
        if m <= 0:
            break
        gram = gram[:m] | (fold[k:] << np.uint32(8 * k))
        h = ((gram + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - WIDTH)
        inside = np.arange(k, len(fold)) < end[:m]
        flat[(row[:m] + h)[inside]] = 1
    return out


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, doc_id, text) to (lang, doc_id, packed presence)."""
    for batch in batches:
        data, offsets = K.columns(batch, "text")
        for lo, hi in _groups(offsets):
            p = presence(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            packed = np.packbits(p.astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), pa.array([r.tobytes() for r in packed], pa.binary())], names=["lang", "doc_id", "bits"])


def _groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for lo, hi in K.groups(offsets):
        for a in range(lo, hi, ROWS):
            yield a, min(hi, a + ROWS)


def normal(p: np.ndarray) -> np.ndarray:
    return p / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))


class Model:
    def __init__(self, langs: list[str], marks: np.ndarray, weights: np.ndarray):
        self.langs, self.marks, self.weights = langs, marks, weights

    def scores(self, p: np.ndarray) -> np.ndarray:
        return (normal(p) @ self.marks) @ self.weights


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")), F.lit(3)) == 1


def fit(docs: DataFrame) -> Model | None:
    """A model of at most LANDMARKS texts; the driver receives FIT_ROWS packed rows of 1 KB at most."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(FIT_ROWS).collect()}
    if not counts:
        return None
    quota = min(FIT_PER_LANG, max(1, FIT_ROWS // len(counts)))
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 20))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 20, int((1 << 20) * quota / n)))])
    picked = rows.filter(chance < share[F.col("lang")]).select("lang", "doc_id", "text").mapInArrow(_bits, "lang string, doc_id long, bits binary")
    seen = sorted(picked.limit(2 * FIT_ROWS).collect(), key=lambda r: (r["lang"], r["doc_id"] or 0, r["bits"]))
    if not seen:
        return None
    langs = sorted({r["lang"] for r in seen})
    p = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in seen), np.uint8)).reshape(len(seen), -1).astype(np.float32)
    y = np.full((len(seen), len(langs)), -1.0)
    y[np.arange(len(seen)), [langs.index(r["lang"]) for r in seen]] = 1
    x = normal(p)
    pick = np.unique(np.linspace(0, len(seen) - 1, min(LANDMARKS, len(seen))).astype(int))
    marks = x[pick].T
    k = (x @ marks).astype(np.float64)
    value, vector = np.linalg.eigh(k[pick])
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = k @ root
    even = np.sqrt(1 / np.maximum(1, (y > 0).sum(axis=0)))[(y > 0).argmax(axis=1)][:, None]  # languages weigh alike
    left = (phi * even).T @ (phi * even) + RIDGE * np.eye(phi.shape[1])
    return Model(langs, np.ascontiguousarray(marks), (root @ np.linalg.solve(left, (phi * even).T @ (y * even))).astype(np.float32))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document; score is the softmax of the languages' margins."""
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.columns(batch, "text")
            letters = np.array(batch.column("letters").to_pylist(), bool)
            for lo, hi in _groups(offsets):
                on = letters[lo:hi]
                if model is None:
                    on = np.zeros(hi - lo, bool)
                lang, score = ["und"] * (hi - lo), np.zeros(hi - lo)
                if on.any():
                    s = model.scores(presence(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])).astype(np.float64)
                    best = s.argmax(axis=1)
                    e = np.exp(3 * (s - s.max(axis=1, keepdims=True)))
                    score = np.where(on, 1 / e.sum(axis=1), 0.0)
                    lang = [model.langs[b] if ok else "und" for b, ok in zip(best, on, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text.alias("text"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
