"""Conflict-constrained best-fit packing of documents into sequences.

A bin holds ``capacity`` words. Documents longer than that are cut: each full
part is a bin of its own, the remainder is packed. Parts are taken by falling
size; each goes to the tightest open bin in which it fits and with which it has
no conflict: a bin takes no two parts of equal texts (one bit per duplicate
cluster) and at most ``per_source`` parts of a source (a bit set once the source
is full there). The search walks the residuals upwards until a bin is compatible.

Parts are dealt by hash to cells of about CELL_ROWS, packed independently, so a
hot source or cluster is spread over all cells and a lost executor costs its
cells only. Bins that a cell leaves with more than capacity / OPEN_SHARE free are
undone, and their parts dealt anew to fewer cells, until they fit one cell or no
longer halve: by then it's conflicts that keep them open, not the cells.

Null texts and texts without words have no part (part, bin and start are null,
size 0). A null source never conflicts. Repeated rows are parts of one cluster
and never share a bin; a null doc_id is a doc_id like others. A text of any length
is cut into as many parts as it needs. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import n_words
from .shared import Cuts

CAPACITY = 2048
PER_SOURCE = 2
CELL_ROWS = 2048
#: Bins with more than this part of the capacity free are packed again.
OPEN_SHARE = 64


class Bins:
    """Open bins by residual; the residuals in use are the bits of one integer."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.used: list[int] = []
        self.clusters: list[int] = []
        self.full: list[int] = []  # sources with per_source parts in the bin
        self.count: list[dict] = []
        self.at: dict[int, list[int]] = {}
        self.residuals = 0

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, start) of a part; source and cluster are bits, 0 for none."""
        rest = self.residuals >> size
        r = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            for i, b in enumerate(self.at[r]):
                if not (self.clusters[b] & cluster or self.full[b] & source):
                    self._leave(r, i)
                    return self._add(b, size, source, cluster)
            rest >>= step + 1
            r += 1
        b = len(self.used)
        self.used.append(0)
        self.clusters.append(0)
        self.full.append(0)
        self.count.append({})
        return self._add(b, size, source, cluster)

    def _leave(self, r: int, i: int) -> None:
        at = self.at[r]
        at.pop(i)
        if not at:
            self.residuals ^= 1 << r

    def _add(self, b: int, size: int, source: int, cluster: int) -> tuple[int, int]:
        start = self.used[b]
        self.used[b] += size
        self.clusters[b] |= cluster
        if source:
            n = self.count[b][source] = self.count[b].get(source, 0) + 1
            if n >= self.per_source:
                self.full[b] |= source
        r = self.capacity - self.used[b]
        self.at.setdefault(r, []).append(b)
        self.residuals |= 1 << r
        return b, start


def pack_cell(rows: list[tuple], capacity: int, per_source: int) -> list[tuple[int, int, int]]:
    """(bin, start, what the bin has free in the end) of each (size, source, cluster); sizes fall."""
    sources: dict = {}
    clusters: dict = {}
    seen: dict = {}
    for _, _, c in rows:
        seen[c] = seen.get(c, 0) + 1
    bins = Bins(capacity, per_source)
    out = []
    for size, s, c in rows:
        sbit = 0 if s is None else 1 << sources.setdefault(s, len(sources))
        cbit = 0 if seen[c] < 2 else 1 << clusters.setdefault(c, len(clusters))
        out.append(bins.put(size, sbit, cbit))
    return [(b, start, capacity - bins.used[b]) for b, start in out]


PART = "row long, doc_id long, part int, from_word long, size long, source string, cluster long"
OUT = ["doc_id", "part", "from_word", "size", "source", "cluster", "bin", "start"]


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per part: doc_id, part, from_word, size, source, cluster, bin, start."""
    cut = Cuts(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words(text).alias("words"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("cluster"))
    last = F.ceil(F.col("words") / capacity).cast("int") - 1
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)))))
    begin = F.col("part").cast("long") * capacity
    parts = parts.withColumn("from_word", begin).withColumn("size", F.least(F.col("words") - begin, F.lit(capacity)))
    # slim rows, written down, so that their numbers stay
    parts = cut(parts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "part", "from_word", "size", "source", "cluster"))
    # a full part needs no partner: its bin is named by its row, as equal rows have equal parts
    alone = parts.filter(F.col("size") == capacity).withColumn("bin", -1 - F.col("row")).withColumn("start", F.lit(0))
    empty = parts.filter("size = 0").withColumn("part", F.lit(None).cast("int")).withColumn("from_word", F.lit(None).cast("long"))
    empty = empty.withColumn("bin", F.lit(None).cast("long")).withColumn("start", F.lit(None).cast("int"))
    done = alone.select(OUT).unionByName(empty.select(OUT))
    loose = parts.filter((F.col("size") > 0) & (F.col("size") < capacity))
    n, turn = loose.count(), 0
    while n:
        n_cells = -(-n // cell_rows)
        dealt = loose.withColumn("cell", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(n_cells)))
        order = [F.col("cell"), F.col("size").desc(), F.col("doc_id"), F.col("part"), F.col("cluster"), F.col("row")]
        dealt = dealt.select("cell", *parts.columns).repartition("cell").sortWithinPartitions(*order)
        packed = cut(dealt.mapInArrow(packer(capacity, per_source, turn), f"{PART}, bin long, start int, open boolean"))
        again = packed.filter("open").count()
        turn += 1
        if n_cells == 1 or 2 * again > n:
            done = done.unionByName(packed.select(OUT))
            break
        done = done.unionByName(packed.filter("not open").select(OUT))
        loose, n = packed.filter("open").select(parts.columns), again
    return done


def packer(capacity: int, per_source: int, turn: int):
    """Rows (cell, PART) sorted by cell and falling size to PART, bin, start, open."""

    def packed(cell: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        rows = list(zip(*(t[c].to_pylist() for c in ("size", "source", "cluster")), strict=True))
        bins, start, free = zip(*pack_cell(rows, capacity, per_source), strict=True)
        first = (turn << 58) + (cell << 32)
        more = [pa.array([first + b for b in bins], pa.int64()), pa.array(start, pa.int32()), pa.array([x * OPEN_SHARE > capacity for x in free], pa.bool_())]
        t = t.drop_columns("cell")
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in t.columns] + more, names=[*t.column_names, "bin", "start", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            ends = [*(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            lo = 0
            for hi in ends:
                if hi > lo:
                    if held and cells[lo] != cell:
                        yield packed(cell, held)
                        held = []
                    cell = int(cells[lo])
                    held.append(batch.slice(lo, hi - lo))
                lo = hi
        if held:
            yield packed(cell, held)

    return run
