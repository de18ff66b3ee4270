"""Fuzzy line deduplication. DataFrame functions only.

Lines (split at line feeds, blanks at their ends ignored) are alike when the
sets of their shingles have a Jaccard similarity of at least 0.8; a shingle is
WIDTH characters from any place of the line on, or the whole of a shorter line.
Equal lines are one class. A line's signature is its shingles' hashes in order:
a hash is as good as a random number, so the smallest of a range of hashes, and
the next ones after it, are a sample that like lines share. TAKE of them from the
start of each of RANGES ranges on are a band; lines of few shingles have bands of
TAKE_FEW, as a longer run of theirs seldom agrees. Lines that share a band are
compared exactly, and connected lines are one component, by the union-find of
:mod:`.shared`. The first line of a component in the order of doc_id and place
stays, the others go.

Blank lines stay, and are alike to none. Null texts stay null and have no line.
Rows that share a doc_id, or have none, are documents of their own, in any
order. All columns are kept, whatever their names; only ``text`` changes. An
empty table gives an empty result. A long line is taken whole, its shingles
hashed by pieces of PIECE characters; its hashes are held at once, 8 bytes a
character and copies of them. A task gathers the hashes of up to GATHERED lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import HOT_ROWS, HOT_SHARE, Cuts, link_buckets, row_ids, salted_join, setting, shared_buckets

SIMILARITY = 80  # hundredths
WIDTH = 5
#: Bands begin at so many (a power of 2) places of a signature.
RANGES = 8
TAKE = 5
#: Lines of up to FEW shingles have bands of TAKE_FEW, lines of more than 0.8 FEW those of TAKE: a link's sizes differ by a fifth at most.
TAKE_FEW = 3
FEW = 40
BANDS = 2 * RANGES
#: Lines of a large bucket that are compared in one row.
BLOCK = 128
PIECE = 4096
#: Places of a line that are hashed in one row.
WINDOW = 16
#: Lines of one task whose hashes are gathered before Spark sorts the others.
GATHERED = 1 << 17
#: Whole-stage code with methods of more bytes is left: the JVM interprets them from 8000 on, and below that the bands' one method took longer than separate projections.
JIT_BYTES = 3000
#: A piece and what its last shingles need of the next one.
PIECES = f"(?s)(?=(.{{1,{PIECE + WIDTH - 1}}})).{{1,{PIECE}}}"


GATHER = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def shingle_set(line: Column) -> Column:
    """The distinct hashes of a line's shingles, by higher-order functions: for lines inside of arrays."""
    wide = 4 * WIDTH  # four bytes a character, so that the place of each is known
    places = lambda b: F.sequence(F.lit(1), F.greatest(F.octet_length(b) - (wide - 1), F.lit(1)), F.lit(4))
    cut = lambda b: F.transform(places(b), lambda i: F.xxhash64(F.substring(b, i, F.lit(wide))))
    hashed = lambda texts: F.flatten(F.transform(F.transform(texts, lambda x: F.encode(x, "UTF-32")), cut))
    pieces = F.filter(F.regexp_extract_all(line, F.lit(PIECES), F.lit(1)), lambda x: F.char_length(x) >= WIDTH)
    found = F.when(F.octet_length(line) <= PIECE, hashed(F.array(line))).otherwise(hashed(pieces))
    return F.array_distinct(F.when(F.char_length(line) < WIDTH, F.array(F.xxhash64(line))).otherwise(found))


def shingle_sets(rows: DataFrame, key: list[str], lines: list[str]) -> DataFrame:
    """``rows`` dealt by ``key``, which is theirs alone: ``key``, the ``lines`` and, as h0, h1, ..., their :func:`shingle_set`.

    Higher-order functions are interpreted, element by element. Here a row of WINDOW
    places is hashed by one compiled expression; no shuffle follows, as keys are together.
    """
    part = F.explode_outer(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("line")) for i, c in enumerate(lines)])).alias("s")
    rows = rows.select(*key, part).select(*key, "s.side", "s.line")
    pieces = F.when(F.octet_length("line") <= PIECE, F.array("line")).otherwise(F.regexp_extract_all("line", F.lit(PIECES), F.lit(1)))
    rows = rows.select(*key, "side", "line", F.posexplode_outer(pieces).alias("piece_no", "piece"))
    rows = rows.withColumn("utf", F.encode("piece", "UTF-32")).withColumn("last", F.greatest(F.octet_length("utf") - 4 * WIDTH, F.lit(0)))
    # rows of WINDOW places each, the last one ending at the last place; where there are fewer places, of one place each
    far = F.col("last") - 4 * (WINDOW - 1)
    step = F.when(far >= 0, 4 * WINDOW).otherwise(4)
    rows = rows.select(*key, "side", "line", "piece_no", "piece", "utf", far.alias("far"), F.explode_outer(F.sequence(F.lit(0), F.col("last"), step)).alias("at"))
    begin = F.when(F.col("far") >= 0, F.least("at", "far")).otherwise(F.col("at"))
    some = F.coalesce(F.substring("utf", begin + 1, F.lit(4 * (WINDOW + WIDTH - 1))), F.lit(b""))  # not null, which spares code
    whole = F.when((F.col("piece_no") == 0) & (F.col("at") == 0), F.col("line"))
    rows = rows.select(*key, "side", whole.alias("line"), "piece_no", F.when(F.octet_length("utf") < 4 * WIDTH, F.col("piece")).alias("short"), (F.col("far") >= 0).alias("full"), some.alias("some"))
    hashes = [F.xxhash64(F.substring("some", 4 * j + 1, 4 * WIDTH)) for j in range(WINDOW)]
    # a short last piece is in the one before
    hashes = F.when(F.col("full"), F.array(*hashes)).when(F.col("short").isNull(), F.array(hashes[0])).when(F.col("piece_no") == 0, F.array(F.xxhash64("short")))
    rows = rows.select(*key, "side", "line", hashes.alias("h"))
    mine = lambda c, i: F.collect_list(F.when(F.col("side") == i, F.col(c)) if len(lines) > 1 else F.col(c))
    rows = rows.groupBy(*key).agg(*[mine("line", i).alias(c) for i, c in enumerate(lines)], *[mine("h", i).alias(f"h{i}") for i in range(len(lines))])
    return rows.select(*key, *[F.get(c, F.lit(0)).alias(c) for c in lines], *[F.array_distinct(F.flatten(f"h{i}")).alias(f"h{i}") for i in range(len(lines))])


def band_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with their sorted hashes ``h`` in exchange for bands k0, k1, ... at the first hash of each range that has one, else null; and ``n``, their number."""
    bounds = [(1 << 64) // RANGES * r - (1 << 63) for r in range(RANGES)]
    literal = [F.lit(b).cast("long") for b in bounds]
    rest = [c for c in rows.columns if c != "h"]
    rows = rows.select(*rest, "h", F.size("h").alias("n"), F.sort_array(F.concat("h", F.array(*literal))).alias("marked"))
    # a bound stands behind the smaller hashes and the bounds before it
    begins = [(F.array_position("marked", b) - (r + 1)).cast("int").alias(f"at{r}") for r, b in enumerate(literal)]
    rows = rows.select(*rest, "h", "n", *begins, F.col("n").alias(f"at{RANGES}"))
    few, more = F.col("n") <= FEW, F.col("n") * 100 > FEW * SIMILARITY

    def band(r: int, take: int, when: Column) -> Column:
        return F.when(when & (F.col(f"at{r}") < F.col(f"at{r + 1}")), F.xxhash64(F.lit(take), F.lit(r), F.slice("h", F.col(f"at{r}") + 1, F.lit(take))))

    keys = [band(r, take, when) for take, when in ((TAKE_FEW, few), (TAKE, more)) for r in range(RANGES)]
    return rows.select(*rest, "n", *[k.alias(f"k{j}") for j, k in enumerate(keys)])


def place(doc: Column, line_no: Column) -> Column:
    """One ordered number for a line's place."""
    return (doc.cast("decimal(28,0)") * F.lit(1 << 31).cast("decimal(10,0)") + line_no).cast("decimal(38,0)")


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc, line_no, line) of the lines that aren't blank."""
    rows = docs.select("doc", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
    return rows.select("doc", "line_no", F.btrim("line", F.lit(" \t\r\x0b\x0c")).alias("line")).filter("line != ''")


def line_pair_verifier(found: DataFrame):
    """Pairs (a, b) of ids to those whose lines, of ``found`` (id, line, n), are alike."""

    def run(pairs: DataFrame) -> DataFrame:
        side = lambda c: found.select(F.col("id").alias(c), F.col("line").alias(f"x{c}"), F.col("n").alias(f"n{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * SIMILARITY)
        # few bytes but much work: a fixed number, which isn't merged into a few tasks
        n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        both = shingle_sets(both.select("a", "b", "na", "nb", "xa", "xb").repartition(n, "a", "b"), ["a", "b", "na", "nb"], ["xa", "xb"])
        common = both.select("a", "b", F.size(F.array_intersect("h0", "h1")).alias("c"), (F.col("na") + F.col("nb")).alias("n"))
        return common.filter(F.col("c") * (100 + SIMILARITY) >= F.col("n") * SIMILARITY).select("a", "b")

    return run


def block_verifier(cut: Cuts, found: DataFrame):
    """Big buckets (key, id, comp, n) to links between components; BLOCK by BLOCK lines are compared inside a row."""

    def run(left: DataFrame) -> DataFrame:
        k = F.ceil(F.col("n") / BLOCK).cast("int")
        rows = left.withColumn("k", k).withColumn("slot", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).join(found.select("id", "line"), "id")
        blocks = cut(rows.groupBy("key", "slot", "k").agg(F.collect_list(F.struct("comp", "line")).alias("m")))  # about BLOCK lines
        # a block and itself, y is null: hashed once, and each pair compared once
        own = blocks.select("key", "slot", F.col("slot").alias("i"), F.col("m").alias("x"), F.lit(None).cast(blocks.schema["m"].dataType).alias("y"))
        first = blocks.filter("slot + 1 < k").select("key", F.col("slot").alias("i"), F.explode(F.sequence(F.col("slot") + 1, F.col("k") - 1)).alias("slot"), F.col("m").alias("x"))
        pairs = own.unionByName(first.join(blocks.select("key", "slot", F.col("m").alias("y")), ["key", "slot"]))
        # few bytes but much work: a fixed number, which isn't merged into a few tasks
        n = 2 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hashed = lambda m: F.transform(m, lambda e: F.struct(e["comp"].alias("comp"), shingle_set(e["line"]).alias("h"))).alias(m)
        pairs = pairs.repartition(n, "key", "i", "slot").select(hashed("x"), hashed("y"))
        # rows rather than nested arrays: their comparison is compiled
        pairs = pairs.select(F.col("y").isNull().alias("own"), F.coalesce("y", "x").alias("y"), F.explode_outer("x").alias("a"))
        pairs = pairs.select("own", "a", F.explode_outer("y").alias("b"))
        na, nb = F.size("a.h"), F.size("b.h")
        apart = F.when(F.col("own"), F.col("a.comp") < F.col("b.comp")).otherwise(F.col("a.comp") != F.col("b.comp"))
        near = apart & (F.least(na, nb) * 100 >= F.greatest(na, nb) * SIMILARITY)
        common = F.when(near, F.size(F.array_intersect("a.h", "b.h")))  # named once below, as the filter makes it again for each name
        pairs = pairs.select(F.col("a.comp").alias("a"), F.col("b.comp").alias("b"), common.alias("c"), (na + nb).alias("n"))
        return cut(pairs.filter(F.col("c") * (100 + SIMILARITY) >= F.col("n") * SIMILARITY).select("a", "b"))

    return run


def dropped_lines(cut: Cuts, docs: DataFrame) -> DataFrame:
    """(doc, dropped) of (doc, text): the places of the lines that go, in order."""
    spark = docs.sparkSession
    rows = occurrences(docs).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), place(F.col("doc"), F.col("line_no")).alias("place"), "line")
    lines = rows.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count("*").alias("times"), F.first("line").alias("line"))
    lines = shingle_sets(lines, ["h1", "h2", "place", "times"], ["line"]).withColumn("h", F.sort_array("h0")).drop("h0")
    with setting(spark, "spark.sql.codegen.hugeMethodLimit", JIT_BYTES), setting(spark, GATHER, GATHERED):
        lines = cut(band_keys(lines).withColumn("id", F.monotonically_increasing_id()))
    buckets = lines.select("id", F.explode(F.array(*[f"k{j}" for j in range(BANDS)])).alias("key")).filter("key is not null")
    live = shared_buckets(cut, buckets)
    found = cut(lines.select("id", "line", "n").join(live.select("id").distinct(), "id"))
    # pairs carry the lines, a tenth of the size of their hashes
    with setting(spark, "spark.sql.codegen.hugeMethodLimit", JIT_BYTES), setting(spark, GATHER, GATHERED):
        roots = link_buckets(cut, live, line_pair_verifier(found), block_verifier(cut, found))
    cut.drop(live, found)
    named = lines.select("id", "h1", "h2", "place", "times").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    named = cut(named.filter("times > 1 or root is not null").withColumn("root", F.coalesce("root", "id")))
    first = named.groupBy("root").agg(F.min("place").alias("first"))
    kept = cut(named.join(first, "root").select("h1", "h2", "first", "times"))
    total = lines.agg(F.sum("times")).first()[0] or 0
    hot = [r["h1"] for r in kept.filter(F.col("times") > max(HOT_ROWS, int(total * HOT_SHARE))).select("h1").collect()]  # 1 / HOT_SHARE at most
    cut.drop(lines, named)
    again = occurrences(docs).select("doc", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    gone = salted_join(again, kept.select("h1", "h2", "first"), ["h1", "h2"], "doc", hot).filter(place(F.col("doc"), F.col("line_no")) != F.col("first"))
    return gone.groupBy("doc").agg(F.sort_array(F.collect_list("line_no")).alias("dropped"))  # a text's own lines


def dedup_lines(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The documents with the kept lines as ``text``; and the names of two more columns, n_lines and the dropped lines' places."""
    cut = Cuts(docs.sparkSession)
    columns = docs.columns
    named, doc, _ = row_ids(cut, docs)
    gone = f"{doc}_dropped"
    dropped = dropped_lines(cut, named.select(F.col(doc).alias("doc"), F.col("text").cast("string").alias("text")))
    out = named.join(dropped.select(F.col("doc").alias(doc), F.col("dropped").alias(gone)).hint("merge"), doc, "left")
    every = lines_of(F.col("text"))
    kept = F.array_join(F.filter(every, lambda line, i: ~F.array_contains(F.col(gone), i)), "\n")
    text = F.when(F.size(gone) > 0, kept).otherwise(F.col("text"))
    n_lines = F.coalesce(F.size(every), F.lit(0))
    return out.select(*[text.alias(c) if c == "text" else F.col(c) for c in columns], n_lines.alias(f"{doc}_n_lines"), F.coalesce(gone, F.array().cast("array<int>")).alias(gone)), f"{doc}_n_lines", gone
