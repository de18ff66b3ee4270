"""Tables cut from their lineage, salted joins, pairs of buckets, and connected components.

A cut table is Parquet in the folder named by ``spark.checkpoint.dir``, which
every executor reaches; a lost executor costs a reread, not a recomputation.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot above this share of the rows, so there are at most 1 / share hot keys.
HOT_SHARE = 1 / 512
#: and above this many rows.
HOT_ROWS = 256
#: Buckets of up to so many members may give all their pairs.
SMALL = 8
#: Hot keys are dealt to so many tasks.
SALTS = 64
#: Rounds in which buckets are compared with one member, before blocks of them are.
HUB_ROUNDS = 2
#: So many edges, of two numbers each, are few enough for one task.
FEW_EDGES = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A temporary one where none is set and executors are threads of the driver, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.conf.get("spark.master", "") or "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="cut-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: What was written and not dropped: path to the JVM's path and configuration.
_left: dict[str, tuple] = {}


def remember(spark: SparkSession, path: str) -> str:
    """Has a folder deleted when its scope or the program ends."""
    _left[path] = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration())
    return path


def drop_path(path: str) -> None:
    """Deletes a remembered folder by Spark's own file system layer."""
    if found := _left.pop(path, None):
        where, conf = found
        where.getFileSystem(conf).delete(where, True)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Drops at its end what was remembered within; for callers that have written their result by then."""
    before = set(_left)
    try:
        yield
    finally:
        for path in [p for p in _left if p not in before]:
            drop_path(path)


@atexit.register
def _sweep() -> None:
    for path in list(_left):
        with contextlib.suppress(Exception):  # the JVM may be gone
            drop_path(path)


class Cuts:
    """Tables cut during one call; those no longer needed are dropped early, the others at the end of the scope."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def __call__(self, df: DataFrame) -> DataFrame:
        path = remember(self.spark, f"{shared_dir(self.spark)}/cut-{uuid.uuid4().hex}")
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._held = [*getattr(self, "_held", []), out]  # ids stay unique
        free_shuffles(self.spark)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and (path := self.paths.pop(id(t), None)):
                drop_path(path)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """One of the session's settings for what is written within."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


_freed = [0.0]


def free_shuffles(spark: SparkSession, every: float = 0.3) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished jobs.

    They stay on the executors' disks until the driver's JVM happens to collect
    its garbage, which a large heap may put off for all of a job of many shuffles.
    """
    if time.monotonic() - _freed[0] > every:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _freed[0] = time.monotonic()


def row_ids(cut: Cuts, docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """``docs`` with a column of numbers, one for each row; its name; and whether those aren't the doc_ids.

    They are the doc_ids unless some are null or repeated.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    odd = bool(docs.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1 or doc_id is null").limit(1).count())
    return (cut(docs.withColumn(name, F.monotonically_increasing_id())) if odd else docs.withColumn(name, F.col("doc_id").cast("long"))), name, odd


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` to broadcast if it has at most ``rows`` (slim) rows; else Spark and AQE choose the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salted_join(big: DataFrame, small: DataFrame, key: str | list[str], by: str | Column, hot: list, how: str = "inner") -> DataFrame:
    """Joins on ``key``; rows of the ``hot`` values of the first key are dealt to SALTS tasks by the hash of ``by``.

    ``small`` is repeated for hot keys only. For callers that know the hot keys; other
    joins leave hot partitions to adaptive execution, which splits them.
    """
    keys = [key] if isinstance(key, str) else key
    if not hot:
        return big.join(small, keys, how)
    is_hot = F.col(keys[0]).isin(hot)
    left = big.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int"))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = small.withColumn("_salt", F.explode(salts))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def components(cut: Cuts, edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): the smallest node reachable.

    Union-find by relational steps: a child keeps its smallest parent and hands
    the others on as edges between parents, until every child has one parent;
    then chains are halved. No step gathers a component in one task; only where
    there are at most FEW_EDGES in all does one task take the steps, without a shuffle.
    """
    first = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    few = first.limit(FEW_EDGES + 1).count() <= FEW_EDGES
    made: list[DataFrame] = [first]

    def step(df: DataFrame) -> DataFrame:
        made.append(cut(df))
        return view(made[-1])

    def view(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if few else df

    def keep(n: int) -> None:
        """Drops all tables but the last ``n``."""
        cut.drop(*made[:-n])
        del made[:-n]

    e = view(first)
    while True:
        low = step(e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")))
        if not low.filter("c > 1").limit(1).count():
            forest = low.select(F.col("a").alias("node"), F.col("m").alias("root"))
            keep(1)
            break
        both = e.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s"))
        e = step(both.select("s.a", "s.b").filter("a != b").distinct())
        keep(1)
    while True:
        parents = forest.select(F.col("root").alias("node")).distinct()
        up = step(parents.join(forest, "node").select(F.col("node").alias("root"), F.col("root").alias("upper")))
        if not up.limit(1).count():
            break
        forest = step(forest.join(up, "root", "left").select("node", F.coalesce("upper", "root").alias("root")))
        keep(1)
    roots = forest.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    return forest.unionByName(roots)


def pair_verifier(items: DataFrame, similarity: int, to_set: Callable[[Column], Column] = lambda x: x):
    """Pairs (a, b) of ids to those whose sets have a Jaccard similarity of ``similarity`` hundredths or more.

    ``items`` are (id, x), by whatever name, and ``to_set`` makes an array of x;
    with sizes of the sets as ``n``, sets too unlike in size aren't made.
    """
    x, n = items.columns[1], "n" if "n" in items.columns else None

    def run(pairs: DataFrame) -> DataFrame:
        side = lambda c: items.select(F.col("id").alias(c), F.col(x).alias(f"x{c}"), *([F.col(n).alias(f"n{c}")] if n else []))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        if n:
            both = both.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * similarity)
        both = both.select("a", "b", to_set(F.col("xa")).alias("ha"), to_set(F.col("xb")).alias("hb"))
        na, nb = F.size("ha"), F.size("hb")
        common = F.when(F.least(na, nb) * 100 >= F.greatest(na, nb) * similarity, F.size(F.array_intersect("ha", "hb"))).otherwise(0)
        common = both.select("a", "b", common.alias("c"), (na + nb).alias("n"))
        return common.filter(F.col("c") * (100 + similarity) >= F.col("n") * similarity).select("a", "b")

    return run


def shared_buckets(cut: Cuts, rows: DataFrame) -> DataFrame:
    """(key, id, hub) of the distinct rows (key, id) whose key has two ids or more; hub is the smallest of them."""
    sized = rows.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).filter("hub < top")
    return cut(rows.join(sized.select("key", "hub"), "key"))


def link_buckets(cut: Cuts, live: DataFrame, verify: Callable[[DataFrame], DataFrame], verify_big: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of the ids that share a bucket and are verified, without all pairs of a bucket.

    ``live``: (key, id, hub) as of :func:`shared_buckets`. ``verify`` takes
    distinct pairs (a, b) and returns those that link. Each bucket's members are
    first compared with one member, its hub, and later only with members of
    other components, in up to HUB_ROUNDS rounds as long as the pairs left over
    are many. Then buckets of up to SMALL members give their pairs to ``verify``,
    and the others go to ``verify_big`` as (key, id, comp, n) and come back as
    links (a, b) between components. A pair that is never compared lies in one
    component already, so no link that could change a component is lost.
    """
    roots = components(cut, verify(live.filter("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()))
    member = live.select("key", F.col("id").alias("node"))
    total = live.count()
    for n in range(HUB_ROUNDS):
        named = member.join(roots, "node", "left")
        named = cut(named.select("key", F.col("node").alias("id"), F.coalesce("root", "node").alias("comp")))
        per = named.groupBy("key", "comp").agg(F.count("*").alias("c"))
        split = per.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("n2"))
        split = cut(split.filter("lo < hi"))
        across = split.agg(F.sum((F.col("n") * F.col("n") - F.col("n2")) / 2)).first()[0] or 0
        if not across:
            cut.drop(named, split)
            break
        last = across <= 4 * total or n == HUB_ROUNDS - 1
        left = cut(named.join(split.select("key", "hi", "n"), "key"))
        cut.drop(named, split)
        if last:
            few = left.filter(F.col("n") <= SMALL)
            other = few.select("key", F.col("id").alias("id2"), F.col("comp").alias("comp2"))
            pairs = few.join(other, "key").filter("comp < comp2").select(F.col("id").alias("a"), F.col("id2").alias("b"))
        else:
            hubs = left.filter("comp = hi").groupBy("key").agg(F.min_by("id", F.xxhash64("id", F.lit(n))).alias("hub"))
            pairs = left.filter("comp != hi").join(hubs, "key").select(F.col("id").alias("a"), F.col("hub").alias("b"))
        more = verify(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        # links between components, as edges between their roots
        tag = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        joined = more.join(tag("a"), "a", "left").join(tag("b"), "b", "left")
        step = joined.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        if last:
            step = step.unionByName(verify_big(left.filter(F.col("n") > SMALL).select("key", "id", "comp", "n")))
        step = cut(step.distinct())
        cut.drop(left)
        if step.limit(1).count():
            up = components(cut, step)
            merged = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("upper")), "root", "left")
            merged = merged.select("node", F.coalesce("upper", "root").alias("root"))
            new = cut(merged.unionByName(up.join(roots.select("node"), "node", "left_anti")))
            cut.drop(roots)
            roots = new
        if last:
            break
    return roots
