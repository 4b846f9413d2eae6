"""What the training-data operators share: text folding, stored tables, size-checked broadcasts, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What words consist of in text as it stands (A-Z included).
WORD_CHAR = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII alone take the faster path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text in order: runs outside GAP after ascii_lower. Null has none."""
    found = F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP)
    return F.array_remove(found, "")


def scratch(spark: SparkSession) -> str:
    """The shared folder for stored tables: spark.checkpoint.dir, or where that is unset and the master is local (tests)
    a folder of our own. On a cluster without the setting there is no folder that executors share, which is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("strandline.scratch", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("strandline.scratch", folder)
    return folder


#: Shuffle files of a query go when it ends, rather than when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables that the open scopes, innermost last, are to delete.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables by any file system that Spark knows."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, after their last reader; those stored with ``keep`` are left to the
    scope around this one, or stay until the folder is cleared if there is none, as the result may still need them."""
    outer = _SCOPES.get()
    token = _SCOPES.set((*outer, []))
    try:
        yield
    finally:
        discard(spark, *_SCOPES.get()[-1])
        _SCOPES.reset(token)


def scoped(operator):
    """``operator(docs, ...)`` in a scope of its own: what it returns may read kept tables alone."""

    @wraps(operator)
    def run(docs, *args, **named):
        with scope(docs.sparkSession):
            return operator(docs, *args, **named)

    return run


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and a lost executor costs
    only the tasks that ran on it. The scope around deletes the files, with ``keep`` the one around that."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _SCOPES.get()
    if len(scopes) > keep:
        scopes[-1 - keep].append(path)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def stored_and(df: DataFrame, name: str, what: Column | None = None, keep: bool = False) -> tuple[DataFrame, int]:
    """stored(), and a count taken while it is written: of rows, or of rows for which ``what`` is true."""
    seen = Observation()
    kept = stored(df.observe(seen, F.count_if(F.lit(True) if what is None else what).alias("n")), name, keep)
    return kept, seen.get["n"]


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, Python workers are handed at most ``rows`` rows at once: for rows that hold whole sets or blocks of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of a round of components() for which a task is worth its start.
ROWS_A_TASK = 200_000


@scoped
def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (a, b: bigint): rows (node, comp), comp the smallest node reachable.

    In each round every node is merged into the first of itself and its neighbours in an order hashed anew, and edges are
    drawn between what is left, so that rounds shrink, whatever the shape; then labels are carried back round by round.
    Nodes that have no edge but to themselves are left out; repeated edges do no harm; no edges give no rows. Skewed nodes
    are met by map-side minima before each shuffle.
    """
    ends = edges.select("a", "b").filter("a <> b")
    open_, n = stored_and(ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    rounds: list[DataFrame] = []
    while n:
        # few edges are met in few tasks: a round over a thousand links should not cost a task for each shuffle partition
        tasks = 1 + n // ROWS_A_TASK
        open_ = open_.coalesce(tasks)
        place = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        first = open_.groupBy("a").agg(F.min(place("b")).alias("f")).select(F.col("a").alias("node"), F.least("f", place("a"))["id"].alias("comp"))
        first = stored(first.coalesce(tasks), name)
        rounds.append(first)
        own = lambda c: first.select(F.col("node").alias(c), F.col("comp").alias(f"{c}2"))  # noqa: E731, B023
        drawn = open_.join(own("a"), "a").join(own("b"), "b").filter("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct()
        open_, n = stored_and(drawn.coalesce(tasks), name)
    if not rounds:
        return stored(open_.select(F.col("a").alias("node"), F.col("b").alias("comp")), name, keep=True)
    comps = rounds[-1]
    for first in reversed(rounds[:-1]):
        far = comps.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        comps = first.join(far, "comp", "left").select("node", F.coalesce("far", "comp").alias("comp"))
    comps = stored(comps, name)
    least = comps.groupBy("comp").agg(F.min("node").alias("least"))
    return stored(comps.join(least, "comp").select("node", F.col("least").alias("comp")), name, keep=True)


def bucket_components(members: DataFrame, verify, near=None, rest=None, rounds: int = 2, orders: int = 4, steps: int = 1, known: DataFrame | None = None) -> DataFrame:
    """Components of the links among nodes that share a bucket: (node, comp), only nodes that have a link.

    ``members``: (key, band, node, sig, weight), a stored table with a row for each bucket that a node is in;
    ``near(sig_a, sig_b)`` is a cheap column test, ``verify(pairs)`` gives back those rows (a, b) that are links; ``known``
    are components from which to start. Members are not paired with each other: in each round every bucket that spans
    several components names a head (first the one of most weight, then by an order that changes with the band and the
    round), and members outside the head's component are compared with it. The first round takes the bands in ``steps``
    parts one after another, so that what one part has linked is not compared again in the next. For what is left then,
    nodes of one bucket in different components, ``rest(members with comp)`` gives the links; without it the pairs that
    pass ``near`` are verified one by one. So the components are exact, and copies of one thing have become one component
    before anything is compared pair by pair.
    """
    spark = members.sparkSession
    comps = spark.createDataFrame([], "node bigint, comp bigint") if known is None else known
    done = spark.createDataFrame([], "a bigint, b bigint")
    open_ = members
    turns = [(turn, step) for turn in range(rounds + 1) for step in range(steps if not turn and rounds else 1)]
    for turn, step in turns:
        now = open_.filter(F.pmod("band", F.lit(steps)) == step) if steps > 1 and not turn else open_
        if turn or step or known is not None:
            now = now.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            # a bucket is closed for good when its members are in one component, or are two, which have been compared
            spans = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
            now, n = stored_and(now.join(spans.filter("lo < hi and n > 2" if turn else "lo < hi").select("key"), "key"), "open")
            if not n:
                continue
        else:
            now = now.withColumn("comp", F.col("node"))
        if turn:
            open_ = now.drop("comp")
        if turn < rounds:
            order = F.struct(F.lit(0) if turn else -F.col("weight"), F.xxhash64("node", F.pmod("band", F.lit(orders)), F.lit(turn)))
            heads = now.withColumn("order", order).groupBy("key").agg(F.min(F.struct("order", "node", "comp", "sig")).alias("head"))
            other = heads.select("key", F.col("head.node").alias("b"), F.col("head.comp").alias("b_comp"), F.col("head.sig").alias("b_sig"))
            pairs = now.join(other, "key").filter("comp <> b_comp")
        elif rest is not None:
            return merged(comps, rest(now))
        else:
            other = now.select("key", F.col("node").alias("b"), F.col("comp").alias("b_comp"), F.col("sig").alias("b_sig"))
            pairs = now.join(other, "key").filter("comp < b_comp")
        if near is not None:
            pairs = pairs.filter(near(F.col("sig"), F.col("b_sig")))
        pairs = pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        pairs, n = stored_and(pairs.join(done, ["a", "b"], "left_anti") if turn or step else pairs, "pairs")
        if n:
            done = done.unionByName(pairs)
            comps = merged(comps, verify(pairs))
    return comps


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after ``links`` are added: links are drawn between components first, so each round is as small as what
    it changes."""
    with scope(links.sparkSession):
        links, n = stored_and(links, "links")
        if not n:
            return comps
        own = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
        drawn = links.join(own("a"), "a", "left").join(own("b"), "b", "left")
        found = components(drawn.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")))
        moved = comps.join(found.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        fresh = found.join(comps.select("node"), "node", "left_anti")
        return stored(moved.unionByName(fresh), "components", keep=True)
