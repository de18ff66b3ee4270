"""Removal of long repeated byte strings, by a Burrows-Wheeler transform.

A byte goes if some string of LENGTH bytes that covers it also starts anywhere
else in the table; strings lie within one text and are judged on the input.

Which strings can be equal: every string of LENGTH bytes has an anchor, the
ANCHOR-byte substring whose hash is smallest (leftmost of equals); equal strings
have equal anchors. The starts of one text fall into intervals of equal anchor,
about one for 70 bytes, and an interval's fragment is its text from the first
start to the last string's end. Fragments are brought together by anchor hash.
Equal fragments are one class; in a class of two or more all starts repeat, and
one copy stands for it. Anchors with two classes or more go on: their fragments
are concatenated in cells, suffix-sorted, and intervals of the suffix array are
extended backwards on the transform, breadth first: the boundaries between
suffixes with a common prefix of l bytes are found from those with l - 1. It
stops at LENGTH; boundaries not found by then join suffixes that agree for
LENGTH bytes or more.

Anchors with a large share of all rows are counted by map-side combining
instead, joined with salts, and their fragments dealt by more context.

Null texts are empty. Texts shorter than LENGTH lose nothing. Rows that share a
doc_id, or have none, are documents of their own. A text of any length is taken
whole, in overlapping pieces. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import SALTS, Cuts, row_ids

LENGTH = 200
ANCHOR = 64
#: Anchors are ordered by the other bits of their hash, alike in groups of any size.
PLACE_BITS = 24
#: Texts hashed together, and bytes suffix-sorted together (a larger anchor is its own cell).
GROUP = 1 << 20
CELL_BYTES = 1 << 19
#: Classes of one anchor above which its fragments are dealt by more context.
WIDE = 2048
#: A task reports anchors with this share of its rows or more; there are 1 / OFTEN hot anchors at most.
OFTEN = 1 / 4096
#: The suffix sort's intervals are taken over at this depth or the next it reaches.
FIRST_DEPTH = 16

ROW = pa.schema([("doc", pa.int64()), ("f", pa.int64()), ("g", pa.int64()), ("a", pa.int32()), ("n", pa.int32())])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(first start, number of starts, anchor hash, fragment hash) of each interval of starts."""
    n, w = len(data), length - k + 1
    last = offsets[1:] - length
    ok = last >= offsets[:-1]
    if not ok.any():
        z = np.zeros(0, np.int64)
        return z, z, z.astype(K.U), z.astype(K.U)
    first, last = offsets[:-1][ok], last[ok]
    roll, second = K.Rolling(data), K.Rolling(data, K.BASE_2, K.TABLE_2)
    h = K.mix((roll.prefix[k:] - roll.prefix[:-k]) * K.powers(roll.back, n - k + 1))
    bits = K.U(max(PLACE_BITS, n.bit_length()))
    low = (h >> bits << bits) | np.arange(len(h), dtype=K.U)  # hash, then place
    span = 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    at = (low & K.U((1 << int(bits)) - 1)).astype(np.int64)
    change = np.flatnonzero(at[1:] != at[:-1]) + 1
    row = np.searchsorted(first, change, "right") - 1
    start = np.union1d(change[(row >= 0) & (change <= last[np.maximum(row, 0)])], first)
    end = np.minimum(np.append(start[1:] - 1, n), last[np.searchsorted(first, start, "right") - 1])
    return start, end - start + 1, h[at[start]], second.spans(start, end + length)


class Frequent:
    """Counts of the most frequent keys, each too low by at most 1 / (KEYS + 1) of all that was added (mergeable Misra-Gries)."""

    KEYS = int(2 / OFTEN)

    def __init__(self):
        self.key, self.count = np.zeros(0, K.U), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        value, count = np.unique(keys, return_counts=True)
        value, place = np.unique(np.concatenate([self.key, value]), return_inverse=True)
        count = np.bincount(place, weights=np.concatenate([self.count, count])).astype(np.int64)
        if len(count) > self.KEYS:
            count -= np.partition(count, -self.KEYS - 1)[-self.KEYS - 1]
        self.key, self.count = value[count > 0], count[count > 0]


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row, first byte, last byte) of groups of texts, and of pieces of a long text that share LENGTH - 1 bytes."""
    for lo, hi in K.groups(offsets, GROUP):
        begin, end = int(offsets[lo]), int(offsets[hi])
        while end - begin > GROUP + LENGTH and hi == lo + 1:
            yield lo, hi, begin, begin + GROUP + LENGTH - 1
            begin += GROUP
        yield lo, hi, begin, end


def interval_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) to rows of ROW; rows with n = 0 tell counts (g) of anchors that are frequent here."""
    often = Frequent()
    total = 0
    for batch in batches:
        data, offsets = K.columns(batch, "text")
        docs = batch.column("doc").to_numpy()
        for lo, hi, begin, end in blocks(offsets):
            off = np.clip(offsets[lo : hi + 1], begin, end) - begin
            a, n, f, g = anchors(data[begin:end], off)
            row = np.searchsorted(off, a, "right") - 1
            often.add(f)
            total += len(a)
            yield pa.RecordBatch.from_arrays([pa.array(docs[lo:hi][row]), pa.array(f.view(np.int64)), pa.array(g.view(np.int64)), pa.array((a + begin - offsets[lo:hi][row]).astype(np.int32)), pa.array(n.astype(np.int32))], schema=ROW)
    big = often.count > total * OFTEN / 4
    z = np.zeros(int(big.sum()), np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(z.astype(np.int64)), pa.array(often.key[big].view(np.int64)), pa.array(often.count[big]), pa.array(z), pa.array(z)], schema=ROW)


FOUND = "doc long, f long, a int, n int, whole boolean, kinds int"


def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and fragment to FOUND: members of classes of two or more (kinds 0), and classes of anchors with several (kinds > 1)."""
    tail = None
    for batch in batches:
        if batch.num_rows:
            now = [batch.column(c).to_numpy() for c in ("doc", "f", "g", "a", "n")]
            now = [np.concatenate(x) for x in zip(tail, now, strict=True)] if tail else now
            cut = int(np.searchsorted(now[1], now[1][-1]))  # the last anchor may go on
            yield from anchor_classes(*(x[:cut] for x in now))
            tail = [x[cut:].copy() for x in now]
    if tail:
        yield from anchor_classes(*tail)


def anchor_classes(doc: np.ndarray, f: np.ndarray, g: np.ndarray, a: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """FOUND of whole anchors."""
    if not len(f):
        return
    new_f = np.concatenate([[True], f[1:] != f[:-1]])
    new_c = new_f | np.concatenate([[True], g[1:] != g[:-1]])
    of = np.cumsum(new_f) - 1
    kinds = np.bincount(of[new_c])
    cls = np.cumsum(new_c) - 1
    member = np.bincount(cls)[cls] >= 2
    rep = new_c & (kinds[of] >= 2)
    for pick, kind in ((member, np.zeros(len(f), np.int32)), (rep, kinds[of].astype(np.int32))):
        if pick.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[pick]) for x in (doc, f, a, n, member, kind)], names=["doc", "f", "a", "n", "whole", "kinds"])


def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, asked) to (key, doc, a, n, whole, bytes); those of wide anchors are cut by context."""
    names = ["key", "doc", "a", "n", "whole", "bytes"]
    side = (LENGTH - ANCHOR) // 2
    for batch in batches:
        data, offsets = K.columns(batch, "text")
        docs = batch.column("doc").to_numpy()
        for i, asked in enumerate(batch.column("asked").to_pylist()):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            rows = []
            for q in asked:
                f, a, n, whole = q["f"], q["a"], q["n"], q["whole"]
                if q["kinds"] <= WIDE:
                    rows.append((f, docs[i], a, n, whole, raw[a : a + n - 1 + LENGTH]))
                    continue
                # every string holds its anchor and, on one side at least, ``side`` bytes more
                piece = raw[a : a + n - 1 + LENGTH]
                p = _anchor_place(piece)
                left = min(n, max(0, p - side + 1))  # starts that have ``side`` bytes before the anchor
                if left > 0:
                    rows.append((_key(f, b"l", piece[p - side : p]), docs[i], a, left, whole, piece[: left - 1 + LENGTH]))
                if left < n:
                    rows.append((_key(f, b"r", piece[p + ANCHOR : p + ANCHOR + side]), docs[i], a + left, n - left, whole, piece[left:]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=names)


def _key(f: int, side: bytes, context: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(f.to_bytes(8, "little", signed=True) + side + context, digest_size=8).digest(), "little", signed=True)


def _anchor_place(piece: bytes) -> int:
    """Where the anchor of the fragment's first string lies in it."""
    raw = np.frombuffer(piece[:LENGTH], np.uint8)
    roll = K.Rolling(raw)
    h = roll.prefix[ANCHOR:] - roll.prefix[:-ANCHOR]
    return int((K.mix(h * K.powers(roll.back, len(h))) >> K.U(PLACE_BITS)).argmin())


def suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(suffixes sorted by ``length`` symbols or more, rows at which blocks of equal prefix begin, that prefix's length)."""
    n = len(text)
    code = np.unique(text, return_inverse=True)[1].astype(K.U) + K.U(1)
    bits, place = int(code.max()).bit_length(), n.bit_length()
    h = max(1, min((63 - place) // bits, length))
    padded = np.concatenate([code, np.zeros(h, K.U)])
    key = np.zeros(n, K.U)
    for j in range(h):
        key = (key << K.U(bits)) | padded[j : j + n]
    fits, index, mask = True, np.arange(n, dtype=K.U), K.U((1 << place) - 1)
    first = None
    while True:
        if fits:  # value and place in one word: a sort by value is ten times as fast as one by index
            packed = np.sort((key << K.U(place)) | index)
            order, key = (packed & mask).astype(np.int64), packed >> K.U(place)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        if first is None and (h >= FIRST_DEPTH or 2 * h > length):
            first = np.flatnonzero(new), h
        if h >= length:
            return order, *first
        rank = np.empty(n, K.U)
        rank[order] = np.cumsum(new).astype(K.U)
        key = rank << K.U(place)
        key[: n - h] |= rank[h:]
        h, fits = 2 * h, 3 * place <= 64


def repeated_starts(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Marks the suffixes that agree with another for ``length`` symbols or more."""
    n = len(text)
    order, starts, depth = suffix_order(text, length)
    last = text[order - 1]  # the transform; the text is taken as a circle
    psi = np.argsort(last, kind="stable").astype(np.int64)  # row of the suffix one symbol later
    lf = np.empty(n, np.int64)
    lf[psi] = np.arange(n)
    head = last[psi]
    same = np.zeros(n + 1, bool)  # row has the symbol of the row before
    same[1:n] = head[1:] == head[:-1]
    psi_next = np.append(psi[1:], n)
    psi_prev = np.concatenate([[-1], psi[:-1]])
    short = np.zeros(n + 1, bool)  # the common prefix across the boundary before a row is below ``length``
    short[starts] = True
    short[0] = short[n] = True
    lb, rb = starts, np.append(starts[1:], n)
    for _ in range(depth, length):
        if not len(lb):
            break
        size = rb - lb
        rows = K.take_ranges(lb, size)
        t = lf[rows]
        ends = ~same[t + 1] | (psi_next[t] >= np.repeat(rb, size))
        begins = ~same[t] | (psi_prev[t] < np.repeat(lb, size))
        lb, rb = np.sort(t[begins]), np.sort(t[ends]) + 1
        fresh = ~short[rb]
        lb, rb = lb[fresh], rb[fresh]
        short[rb] = True
    out = np.zeros(n, bool)
    long = ~short
    out[order] = long[:-1] | long[1:]
    return out


MARKS = "doc long, lo int, hi int"


def expand_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments sorted by key to the byte ranges (doc, lo, hi) that repeated strings cover."""

    def cell(rows: list[tuple]) -> pa.RecordBatch:
        size = np.array([len(r[5]) for r in rows])
        joined = np.frombuffer(b"".join(r[5] + b"\0" for r in rows) + b"\0", np.uint8).astype(np.uint16) + 2
        begin = np.cumsum(size + 1) - (size + 1)
        joined[begin + size] = 1  # between fragments
        joined[-1] = 0  # the one end of the circle
        hit = repeated_starts(joined)
        doc, lo, hi = [], [], []
        for r, b in zip(rows, begin.tolist(), strict=True):
            if r[4]:
                continue
            s = np.flatnonzero(hit[b : b + r[3]])
            if len(s):
                cut = np.flatnonzero(np.diff(s) > LENGTH)  # runs of strings that touch
                x, y = s[np.concatenate([[0], cut + 1])], s[np.append(cut, len(s) - 1)] + LENGTH
                doc += [r[1]] * len(x)
                lo += (x + r[2]).tolist()
                hi += (y + r[2]).tolist()
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["doc", "lo", "hi"])

    rows: list[tuple] = []
    held = 0
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for r in zip(*cols, strict=True):
            if rows and held > CELL_BYTES and r[0] != rows[-1][0]:
                yield cell(rows)
                rows, held = [], 0
            rows.append(r)
            held += len(r[5]) + 1
    if rows:
        yield cell(rows)


def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ranges) to doc_id, what was removed and what is kept."""
    for batch in batches:
        data, offsets = K.columns(batch, "text")
        out = []
        for i, ranges in enumerate(batch.column("ranges").to_pylist()):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            spans: list[list[int]] = []
            for r in sorted((r["lo"], r["hi"]) for r in ranges or ()):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            at, kept = 0, []
            for lo, hi in spans:
                kept.append(raw[at:lo])
                at = hi
            kept.append(raw[at:])
            whole = b"".join(kept)
            out.append((len(raw), len(raw) - len(whole), len(spans), whole))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        )


def repeated_ranges(cut: Cuts, docs: DataFrame) -> DataFrame:
    """(doc, lo, hi) byte ranges of the texts of (doc, text) that repeat; they may overlap."""
    rows = cut(docs.mapInArrow(interval_rows, "doc long, f long, g long, a int, n int"))
    some = rows.filter("n > 0")
    total = some.count()
    # hot: more rows than two even partitions have
    most = max(1024, int(total * OFTEN), 2 * total // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # a task's count is too low by at most half of OFTEN, and what it doesn't tell is a quarter of it
    tell = rows.filter("n = 0").groupBy("f").agg(F.sum("g").alias("c")).filter(F.col("c") > most - int(0.75 * total * OFTEN))
    hot = [r["f"] for r in tell.collect()]  # 4 / OFTEN at most
    cold = some.filter(~F.col("f").isin(hot)) if hot else some
    found = cold.repartition("f").sortWithinPartitions("f", "g").mapInArrow(classes, FOUND)
    if hot:
        warm = some.filter(F.col("f").isin(hot))
        per = cut(warm.groupBy("f", "g").agg(F.count("*").alias("c"), F.first("doc").alias("doc"), F.first("a").alias("a"), F.first("n").alias("n")))
        kinds = per.groupBy("f").agg(F.count("*").cast("int").alias("kinds"))
        reps = per.join(F.broadcast(kinds.filter("kinds > 1")), "f")  # as many as there are hot anchors
        reps = reps.select("doc", "f", "a", "n", (F.col("c") > 1).alias("whole"), "kinds")
        salt = F.pmod(F.xxhash64("doc", "a"), F.lit(SALTS)).cast("int")
        twice = per.filter("c > 1").select("f", "g", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        members = warm.withColumn("salt", salt).join(twice, ["f", "g", "salt"]).select("doc", "f", "a", "n", F.lit(True).alias("whole"), F.lit(0).alias("kinds"))
        found = found.unionByName(members).unionByName(reps)
    found = cut(found)
    cut.drop(rows)
    known = found.filter("kinds = 0").select("doc", F.col("a").alias("lo"), (F.col("a") + F.col("n") - 1 + LENGTH).alias("hi"))
    asked = found.filter("kinds > 0").groupBy("doc").agg(F.collect_list(F.struct("f", "a", "n", "whole", "kinds")).alias("asked"))  # a text's own intervals
    parts = docs.join(asked, "doc").select("doc", "text", "asked").mapInArrow(fragments, "key long, doc long, a int, n int, whole boolean, bytes binary")
    marks = parts.repartition("key").sortWithinPartitions("key").mapInArrow(expand_cells, MARKS)
    return known.unionByName(cut(marks))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each document; kept is the bytes that stay."""
    cut = Cuts(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named, row, _ = row_ids(cut, docs)
    named = named.withColumnRenamed(row, "doc")
    ranges = repeated_ranges(cut, named.select("doc", "text")).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return named.join(ranges, "doc", "left").select("doc_id", "text", "ranges").mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
