"""Near-duplicate documents: ProbMinHash signatures, banding, exact verification.

Two texts link when the sets of their five-word shingles have a Jaccard
similarity of at least 0.8. Candidates come from ProbMinHash: each distinct
shingle of weight w sends Poisson arrivals at rate w, each to a random register;
a register keeps the shingle that arrives first, and a shingle stops once its
next arrival is later than every register of its text. Registers agree with the
probability Jaccard similarity of the weighted sets. All distinct shingles weigh
1, however often a text repeats them, so this is the similarity of the link.
Bands of registers give buckets, and every bucket is resolved by
:func:`prosewright.llm.shared.link_buckets`.

The candidates' shingles are hashed once, into sets of 64-bit numbers; pairs and
blocks carry those sets, never texts.

Null texts and texts without a word link with nothing and are kept. Equal texts
(by a 128-bit hash) are one candidate. Rows that share a doc_id, or have none,
are documents of their own. A class is named by its smallest doc_id, null if it
has none, and one row of it is kept: the one of that doc_id, any one of several.
A text of any length is taken whole; memory beside it is 16 bytes a word. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import Cuts, link_buckets, pair_verifier, row_ids, shared_buckets

WORDS = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 4
#: Texts of a large bucket that are compared at once.
BLOCK = 512
#: Shingles of an output batch of sets.
BATCH = 1 << 18


def arrivals(element: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(exponential gap, random bits) of each element's arrival number ``turn``."""
    bits = K.mix(element + K.U((turn * 2 + 1) * int(K.BASE) % (1 << 64)))
    unit = ((bits >> K.U(11)).astype(np.float64) + 0.5) * 2.0**-53
    return -np.log(unit), K.mix(bits + K.BASE_2)


def probminhash(element: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """(n_rows, m) registers: the element that first arrives at each, 0 for rows without elements."""
    best = np.full(n_rows * m, np.inf)
    sig = np.zeros(n_rows * m, K.U)
    time = np.zeros(len(element))
    turn = 0
    while len(element):
        gap, bits = arrivals(element, turn)
        time = time + gap / weight
        cell = row * m + (bits % K.U(m)).astype(np.int64)
        hit = np.flatnonzero(time < best[cell])
        if len(hit):
            # the earliest of the arrivals at a cell is written last
            hit = hit[np.argsort(-time[hit], kind="stable")]
            best[cell[hit]] = time[hit]
            sig[cell[hit]] = element[hit]
        latest = best.reshape(n_rows, m).max(axis=1)
        go = time < latest[row]
        element, row, weight, time = element[go], row[go], weight[go], time[go]
        turn += 1
    return sig.reshape(n_rows, m)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted for each row; their rows; and where each row's begin."""
    n = len(offsets) - 1
    s, e, row = K.words(data, offsets)
    h, owner = K.shingles(K.span_hashes(data, s, e), row, n, WORDS)
    ends = np.searchsorted(owner, np.arange(n + 1))
    sets = [np.unique(h[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    size = np.array([len(x) for x in sets], np.int64)
    return np.concatenate([np.zeros(0, K.U), *sets]), np.repeat(np.arange(n), size), np.concatenate([[0], np.cumsum(size)])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = K.columns(batch, "text")
        for lo, hi in K.groups(offsets):
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


SIGNED = "row long, doc_id long, copy_hi long, copy_lo long, bands array<long>"


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text) to SIGNED."""
    for batch, data, offsets in _grouped(batches):
        n = len(offsets) - 1
        h, owner, begin = shingle_sets(data, offsets)
        sig = probminhash(h, owner, np.ones(len(h)), n, BANDS * ROWS)
        some = np.diff(begin) > 0
        band = np.zeros((n, BANDS), K.U)
        for b in range(BANDS):
            x = np.full(n, K.U((b + 1) * int(K.BASE) % (1 << 64)))
            for r in range(ROWS):
                x = K.mix(x + sig[:, b * ROWS + r])
            band[:, b] = x
        copy = b"".join([hashlib.blake2b(data[a:z], digest_size=16).digest() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        copy = np.frombuffer(copy, np.int64).reshape(n, 2)
        ends = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(band[some].ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(copy[:, 0]), pa.array(copy[:, 1]), lists], names=["row", "doc_id", "copy_hi", "copy_lo", "bands"]
        )


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, h): the text's distinct shingle hashes, sorted."""
    for batch, data, offsets in _grouped(batches):
        h, _, begin = shingle_sets(data, offsets)
        lo, n = 0, len(offsets) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + BATCH, "right")) - 1)
            lists = pa.ListArray.from_arrays(pa.array((begin[lo : hi + 1] - begin[lo]).astype(np.int32)), pa.array(h[begin[lo] : begin[hi]].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), lists], names=["id", "h"])
            lo = hi


def similar(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of at least SIMILARITY, from sizes, in whole numbers of hundredths."""
    return (100 * both >= round(100 * SIMILARITY) * (a + b - both)) & (both > 0)


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a batch, and where each row's begin."""
    col = batch.column("h")
    offsets = np.asarray(col.offsets.to_numpy(), np.int64)
    return np.asarray(col.values.to_numpy(zero_copy_only=False)).view(K.U), offsets


def linked_components(comp: np.ndarray, sh: np.ndarray, owner: np.ndarray, side: np.ndarray) -> set[tuple[int, int]]:
    """Pairs of components that some similar texts link, one of side 0 and one of side 1 (or both of side 0 if there is no other)."""
    n = len(comp)
    size = np.bincount(owner, minlength=n)
    word, count = np.unique(sh, return_inverse=True, return_counts=True)[1:]
    shared = count[word] > 1  # others meet in no pair
    word, owner = np.unique(word[shared], return_inverse=True)[1], owner[shared]
    x = np.flatnonzero(side == 0)
    y = np.flatnonzero(side == 1) if (side == 1).any() else x
    place_x, place_y = np.full(n, -1), np.full(n, -1)
    place_x[x], place_y[y] = np.arange(len(x)), np.arange(len(y))
    both = np.zeros((len(x), len(y)), np.float32)
    wide = 4096
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    for lo in range(0, int(word[-1]) + 1 if len(word) else 0, wide):
        s, e = np.searchsorted(word, [lo, lo + wide])
        w, o = word[s:e] - lo, owner[s:e]
        mx, my = np.zeros((len(x), wide), np.float32), np.zeros((len(y), wide), np.float32)
        on = place_x[o] >= 0
        mx[place_x[o[on]], w[on]] = 1
        on = place_y[o] >= 0
        my[place_y[o[on]], w[on]] = 1
        both += mx @ my.T
    i, j = np.nonzero(similar(both.astype(np.int64), size[x][:, None], size[y][None, :]) & (comp[x][:, None] != comp[y][None, :]))
    return set(zip(comp[x][i].tolist(), comp[y][j].tolist(), strict=True))


def verified_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, side, comp, h) sorted by block to links between components."""
    key, held = None, []

    def done() -> pa.RecordBatch:
        comp, side, size, sh = (np.concatenate([x[c] for x in held]) for c in range(4))
        got = list(linked_components(comp, sh, np.repeat(np.arange(len(comp)), size), side))
        return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        h, begin = _sets(batch)
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")), strict=True))
        comp, side = batch.column("comp").to_numpy(), batch.column("side").to_numpy()
        lo = 0
        while lo < len(keys):
            hi = lo
            while hi < len(keys) and keys[hi] == keys[lo]:
                hi += 1
            if keys[lo] != key and held:
                yield done()
                held = []
            key = keys[lo]
            held.append((comp[lo:hi].copy(), side[lo:hi].copy(), np.diff(begin[lo : hi + 1]), h[begin[lo] : begin[hi]].copy()))
            lo = hi
    if held:
        yield done()


def block_verifier(cut: Cuts, sets: DataFrame):
    """Big buckets (key, id, comp, n) to links between components, by products of shingle matrices of BLOCK by BLOCK texts."""

    def run(left: DataFrame) -> DataFrame:
        k = F.ceil(F.col("n") / BLOCK).cast("int")
        rows = left.join(sets, "id").withColumn("k", k).withColumn("slot", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
        first = rows.select("*", F.col("slot").alias("i"), F.explode(F.sequence(F.col("slot"), F.col("k") - 1)).alias("j"), F.lit(0).alias("side"))
        second = rows.filter("slot > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("slot") - 1)).alias("i"), F.col("slot").alias("j"), F.lit(1).alias("side"))
        rows = first.unionByName(second.select(first.columns)).select("key", "i", "j", "side", "comp", "h")
        rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
        return cut(rows.mapInArrow(verified_blocks, "a long, b long"))

    return run


def classes(cut: Cuts, docs: DataFrame, row: str, odd: bool) -> DataFrame:
    """(row, doc_id, class_id, kept) of each row of ``docs``, whose column ``row`` numbers them."""
    docs = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = cut(docs.mapInArrow(signatures, SIGNED))
    copies = cut(sig.filter("size(bands) > 0").groupBy("copy_hi", "copy_lo").agg(F.min("row").alias("id"), F.first("bands").alias("bands")))
    live = shared_buckets(cut, copies.select("id", F.explode("bands").alias("key")))
    wanted = live.select(F.col("id").alias("row")).distinct()
    sets = cut(docs.join(wanted.hint("merge"), "row", "left_semi").select(F.col("row").alias("id"), "text").mapInArrow(sets_of, "id long, h array<long>"))
    roots = link_buckets(cut, live, pair_verifier(sets, round(100 * SIMILARITY)), block_verifier(cut, sets))
    cut.drop(live, sets)
    named = copies.select("copy_hi", "copy_lo", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    key = F.concat_ws("-", "copy_hi", "copy_lo").alias("copy")
    named = cut(named.select(key, F.coalesce("root", "id").alias("root")))
    cut.drop(copies)
    out = sig.select("row", "doc_id", F.when(F.size("bands") > 0, key).alias("copy")).join(named, "copy", "left").select("row", "doc_id", "root")
    if not odd:
        return out.select("row", "doc_id", F.coalesce("root", "row").alias("class_id"), F.coalesce(F.col("root") == F.col("row"), F.lit(True)).alias("kept"))
    out = cut(out)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = cut(out.filter("root is not null").groupBy("root").agg(F.min(rank).alias("first")))
    out = out.join(first, "root", "left")
    alone = F.col("root").isNull()
    return out.select("row", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), (alone | (F.col("first.row") == F.col("row"))).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept) of each row of ``docs``."""
    cut = Cuts(docs.sparkSession)
    return classes(cut, *row_ids(cut, docs)).drop("row")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns."""
    cut = Cuts(docs.sparkSession)
    named, row, odd = row_ids(cut, docs)
    kept = classes(cut, named, row, odd).filter("kept").select(F.col("row").alias(row))
    return named.join(kept, row, "left_semi").select(*docs.columns)


#: Similarities of all pairs that share a shingle, and what can be reached by links.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT x AS doc_id, min(y) AS class_id, x = min(y) AS kept FROM reach GROUP BY x
"""
