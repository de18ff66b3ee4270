"""Near-duplicate vectors by an exact metric range join.

Vectors link when their labels are equal and their cosine is at least 0.93.
Angles are a metric. Labels with many vectors have pivots; a vector is at home
in the cell of its nearest pivot p and is also copied to the cell of a pivot q
if a vector at home there can be in reach: by the triangle inequality only if
angle(x, q) <= angle(x, p) + 2 reach, and only if x lies within reach of the
plane between p and q. So every partner of x is in x's home cell, and cells are
joined independently, in blocks, so that a hot cell is dealt to many tasks.
Where a sample shows that vectors would be copied to more cells than blocks of
their whole label take (spread out in many dimensions, most pivots are in reach),
the label is one cell, whose blocks are compared with each other once. Blocks hold
BLOCK to MOST vectors and are sent out in rounds, so that a vector has about COPIES
copies at a time on the disks. Equal vectors are one class; its copies count.

Null, empty or zero vectors, vectors with null or non-finite components, and
vectors without a label link with nothing; vectors of different lengths don't
link. Repeated rows stay repeated and link with each other. A vector of any
length is taken whole. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Cuts, components, small_side

COSINE = 0.93
#: Vectors per pivot, pivots in all (twice that at most are sent to the tasks), and vectors per block, at first and at most.
CELL = 1024
PIVOTS = 4096
BLOCK = 2048
MOST = 16384
#: Blocks grow with the table up to MOST, at so many to it, and to so many numbers.
BLOCKS = 40
BLOCK_NUMBERS = 1 << 23
#: Copies of a vector in one round.
COPIES = 2
#: Vectors on which pivots are tried.
TRIED = 2048
#: Products made at once.
STRIP = 1 << 21
#: Vectors that are compared with all pivots at once.
ROWS = 256
#: Slack for rounding; only adds copies.
EPS = 1e-9


def unit(rows: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as unit vectors."""
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks) if rows.num_chunks else pa.array([], rows.type)
    x = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_cells(x: np.ndarray, p: np.ndarray, reach: float, chord: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in x, pivot, whether it is the nearest) of the cells of each vector."""
    dot = x @ p.T
    angle = np.arccos(np.clip(dot, -1, 1))
    own, i = angle.argmin(axis=1), np.arange(len(x))
    apart = np.sqrt(np.maximum(0, 2 - 2 * (p[own] @ p.T)))
    go = (angle <= angle[i, own][:, None] + 2 * reach) & (dot[i, own][:, None] - dot <= chord * apart + EPS)
    go[i, own] = True
    who, cell = np.nonzero(go)
    return who, cell, cell == own[who]


def dealer(pivots: dict, cosine: float):
    """Rows (id, mult, grp, vec) to rows (cell, home, id, mult, grp, vec)."""
    reach, chord = np.arccos(cosine) + EPS, np.sqrt(2 - 2 * cosine) + EPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp = np.array(batch.column("grp").to_pylist(), object)
            for g in dict.fromkeys(grp.tolist()):
                at = np.flatnonzero(grp == g)
                part = batch.take(pa.array(at))
                p = pivots.get(g)
                if p is None:
                    who, cell = np.arange(len(at)), np.zeros(len(at), np.int32)
                    home = np.ones(len(at), bool)
                else:
                    x = unit(part.column("vec"))
                    got = [near_cells(x[lo : lo + ROWS], p, reach, chord) for lo in range(0, len(x), ROWS)]
                    who = np.concatenate([w + i * ROWS for i, (w, _, _) in enumerate(got)])
                    cell, home = (np.concatenate([g[k] for g in got]) for k in (1, 2))
                out = part.take(pa.array(who))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(home), *(out.column(c) for c in ("id", "mult", "grp", "vec"))], names=["cell", "home", "id", "mult", "grp", "vec"]
                )

    return run


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the rows of x and y that link, strip by strip of x.

    Single precision leaves out what is surely too far or surely near; between, double precision decides, and the plain formula near the threshold.
    """
    slack = (x.shape[1] + 16) * 1.2e-7  # twice the bound of rounding
    xs, ys = x.astype(np.float32), y.astype(np.float32).T
    step = max(1, STRIP // max(1, len(y)))
    for lo in range(0, len(x), step):
        dot = xs[lo : lo + step] @ ys
        at = np.flatnonzero(dot >= cosine - slack)
        if not len(at):
            continue
        i, j = np.divmod(at, len(y))
        i += lo
        fine = np.ones(len(at), bool)
        unsure = np.flatnonzero(dot.ravel()[at] < cosine + slack)
        for k in range(0, len(unsure), 8192):
            part = unsure[k : k + 8192]
            fine[part] = links(x[i[part]], y[j[part]], cosine)
        if fine.any():
            yield i[fine], j[fine]


def links(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x link with the same row of y."""
    dot = (x * y).sum(axis=1)
    link = dot >= cosine
    for k in np.flatnonzero(np.abs(dot - cosine) < 1e-12).tolist():
        a, b = x[k], y[k]
        link[k] = float(np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b)))) >= cosine
    return link


def joiner(cosine: float):
    """Blocks (grp, cell, i, j, side, id, mult, vec) to rows (id, links, to): counts, and a forest of the links. A cell of -1 has blocks that meet once, so both sides count."""

    def joined(h: pa.Table, m: pa.Table, both: bool) -> pa.RecordBatch:
        hid, mid = h["id"].to_numpy(), m["id"].to_numpy()
        hm, mm = h["mult"].to_numpy(), m["mult"].to_numpy()
        n_h, n_m = np.zeros(len(hid), np.int64), np.zeros(len(mid), np.int64)
        made = [(np.concatenate([hid, mid]), np.concatenate([hid, mid]))]
        lab_m = mid.copy()
        for i, j in linked(unit(h["vec"]), unit(m["vec"]), cosine) if len(hid) and len(mid) else ():
            other = hid[i] != mid[j]
            i, j = i[other], j[other]
            if not len(i):
                continue
            np.add.at(n_h, i, mm[j])
            if both:
                np.add.at(n_m, j, hm[i])
            # labels fall until they agree; those of earlier strips that fall are told again
            rows, old = np.unique(i), lab_m.copy()
            lab_h = hid.copy()
            while True:
                new_h = lab_h.copy()
                np.minimum.at(new_h, i, lab_m[j])
                new_m = lab_m.copy()
                np.minimum.at(new_m, j, new_h[i])
                if (new_h == lab_h).all() and (new_m == lab_m).all():
                    break
                lab_h, lab_m = new_h, new_m
            fell = np.flatnonzero(lab_m != old)
            made += [(hid[rows], lab_h[rows]), (old[fell], lab_m[fell])]
        ids, to = (np.concatenate([p[k] for p in made]) for k in (0, 1))
        counts = np.concatenate([n_h, n_m, np.zeros(len(ids) - len(hid) - len(mid), np.int64)])
        tell = (counts > 0) | (ids != to)
        return pa.RecordBatch.from_pydict({"id": ids[tell], "links": counts[tell], "to": to[tell]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            keys = list(zip(*(t[c].to_pylist() for c in ("grp", "cell", "i", "j")), strict=True))
            lo = 0
            for n, k in enumerate([*keys, None]):
                if n == len(keys) or k != key:
                    if n > lo:
                        held.append(t.slice(lo, n - lo))
                    if n < len(keys):
                        if held:
                            yield split(held, key)
                        key, held, lo = k, [], n
        if held:
            yield split(held, key)

    def split(held: list[pa.Table], key: tuple) -> pa.RecordBatch:
        t = pa.concat_tables(held).combine_chunks()
        side, once = t["side"].to_numpy(), key[1] < 0
        h = t.filter(pa.array(side == 0)).combine_chunks()
        if once and key[2] == key[3]:
            return joined(h, h, False)
        return joined(h, t.filter(pa.array(side == 1)).combine_chunks(), once)

    return run


def worth_it(reps: DataFrame, pivots: dict, wide: dict, cosine: float, share: float, block: int) -> dict:
    """The pivots of labels whose vectors, by a sample, are copied to no more cells than to blocks of the whole label."""
    chance = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, TRIED / max(1, sum(wide.values()))))
    tried: dict = {}
    for r in reps.filter(chance & F.col("grp").isin(list(pivots))).select("grp", "id", "vec").orderBy(F.xxhash64("id", F.lit(8))).limit(2 * TRIED).collect():
        tried.setdefault(r["grp"], []).append(r["vec"])
    reach, chord = np.arccos(cosine) + EPS, np.sqrt(2 - 2 * cosine) + EPS
    copies = {g: len(near_cells(unit(pa.array(v, pa.list_(pa.float64()))), pivots[g], reach, chord)[0]) / len(v) for g, v in tried.items()}
    return {g: p for g, p in pivots.items() if copies.get(g, np.inf) <= max(2, np.ceil(wide[g] / block) + 1)}


def in_rounds(cut: Cuts, placed: DataFrame, block: int, cosine: float) -> list[DataFrame]:
    """Tables (id, links, to) of the rows (cell, home, id, mult, grp, vec), some blocks at a time."""
    sizes = cut(placed.groupBy("grp", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("k")))
    most = sizes.agg(F.max("k")).first()[0] or 0
    placed = placed.join(small_side(sizes), ["grp", "cell"])
    slot = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    every, cols = F.sequence(F.lit(0), F.col("k") - 1), ["grp", "cell", "i", "j", "side", "id", "mult", "vec"]
    once = F.col("cell") < 0
    rounds = max(1, -(-(most + 1) // COPIES))
    founds = []
    for n in range(rounds):
        now = F.pmod(F.col("i") + F.col("j"), F.lit(rounds)) == n
        homes = placed.filter("home").withColumn("i", slot).withColumn("j", F.explode(every)).withColumn("side", F.lit(0)).filter(now & (~once | (F.col("i") <= F.col("j"))))
        all_ = placed.withColumn("j", slot).withColumn("i", F.explode(every)).withColumn("side", F.lit(1)).filter(now & (~once | (F.col("i") < F.col("j"))))
        blocks = homes.select(cols).unionByName(all_.select(cols)).repartition("grp", "cell", "i", "j").sortWithinPartitions("grp", "cell", "i", "j", "side", "id")
        founds.append(cut(blocks.mapInArrow(joiner(cosine), "id long, links long, to long")))
    return founds


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector; component_id is the smallest vec_id reachable."""
    spark = vectors.sparkSession
    cut = Cuts(spark)
    e = F.col("embedding").cast("array<double>")
    # vectors are compared in double precision, and carried in their own
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    big = F.lit(float("inf"))
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big)) & F.exists(e, lambda v: v != 0) & F.col("label").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull(), F.transform(e, lambda v: v + 0.0).cast(kind)).alias("vec"), F.col("label").cast("string").alias("label"))
    rows = rows.withColumn("grp", F.concat_ws(":", "label", F.size("vec").cast("string")))
    copy = F.concat_ws("-", F.xxhash64("grp", "vec"), F.xxhash64("vec", "grp", F.lit(1)))
    rows = rows.select("vec_id", "vec", "grp", F.when(F.col("vec").isNotNull(), copy).alias("copy"))
    reps = rows.filter("copy is not null").groupBy("copy").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult"), F.first("grp").alias("grp"), F.first("vec").alias("vec"))
    reps = cut(reps)
    total, width = reps.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    per = reps.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > max(CELL, total // PIVOTS))
    block = max(BLOCK, min(MOST, total // BLOCKS, BLOCK_NUMBERS // width))
    wide = {r["grp"]: r["n"] for r in per.collect()}  # PIVOTS labels at most
    share = max(CELL, total / PIVOTS)
    pivots: dict = {}
    if wide:
        # about one vector in ``share`` is a pivot, by a hash
        chance = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) / share)
        picked = reps.filter(chance).join(small_side(per), "grp").select("grp", "id", "vec").orderBy(F.xxhash64("id", F.lit(6))).limit(2 * PIVOTS).collect()
        for r in sorted(picked, key=lambda r: r["id"]):
            pivots.setdefault(r["grp"], []).append(r["vec"])
        pivots = {g: unit(pa.array(v, pa.list_(pa.float64()))) for g, v in pivots.items()}
        pivots = worth_it(reps, pivots, wide, cosine, share, block)
    # vectors in cells of pivots, and labels that are one cell each
    celled = F.col("grp").isin(list(pivots))
    founds = []
    if pivots:
        dealt = cut(reps.filter(celled).select("id", "mult", "grp", "vec").mapInArrow(dealer(pivots, cosine), f"cell int, home boolean, id long, mult long, grp string, vec {kind}"))
        founds += in_rounds(cut, dealt, block, cosine)
        cut.drop(dealt)
    whole = reps.filter(~celled) if pivots else reps
    founds += in_rounds(cut, whole.select(F.lit(-1).alias("cell"), F.lit(True).alias("home"), "id", "mult", "grp", "vec"), block, cosine)
    found = functools.reduce(DataFrame.unionByName, founds)
    count = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(cut, found.filter("id != to").select(F.col("id").alias("a"), F.col("to").alias("b")))
    named = reps.select("copy", "id", "mult").join(count, "id", "left").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    named = cut(named.select("copy", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")))
    out = rows.select("vec_id", "copy").join(named, "copy", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
         WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN low ON low.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""
