"""Boosted trees: training and scoring with Spark ML, and out-of-fold evaluation by histogram trees over all rows."""

from __future__ import annotations

import json
import pickle
import secrets
import socket
from collections.abc import Callable, Generator, Iterator
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandline.operators.graph import cut

#: Up to so many rows the trees of a fold are fitted in one task; beyond, to all rows where they lie, by at most so many
#: tasks that run at once and add up their histograms. Both give the same trees.
TASK_ROWS = 20_000
TASKS = 64
BINS = 64
#: Equal rows are one row with their number as weight, up to this many.
WEIGHT = 64


def assembled(df: DataFrame, order: list[str], strict: bool = False) -> DataFrame:
    """Features in their fixed order as doubles; absent ones are 0, or an error if ``strict``."""
    if strict and (missing := [c for c in order if c not in df.columns]):
        raise ValueError(f"missing features: {missing}")
    rest = [c for c in df.columns if c not in order]
    return df.select(*rest, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in order))


def train(df: DataFrame, order: list[str], rounds: int = 300, depth: int = 5, step: float = 0.05, subsample: float = 0.85, columns: str = "0.8", seed: int = 42):
    """A pipeline of assembler and boosted trees on label column y, fitted by Spark ML to all rows wherever they are; save
    it with ``model.write().save(path)``."""
    trees = GBTClassifier(featuresCol="features", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=subsample, featureSubsetStrategy=columns, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=order, outputCol="features"), trees]).fit(assembled(df, order).withColumn("y", F.col("y").cast("double")))


def score(model, df: DataFrame, order: list[str], strict: bool = False) -> DataFrame:
    """Rows with ``score``, the probability of label 1."""
    made = model.transform(assembled(df, order, strict)).withColumn("score", vector_to_array("probability")[1])
    return made.drop("features", "rawPrediction", "probability", "prediction")


class Trees:
    """Histogram trees with logistic loss, grown level by level; each round sees a share of rows and of columns.

    Gradients are rounded to multiples of a power of 2 that leave sums of all rows exact, and rows are drawn by hashes of
    their keys, so trees depend neither on the order of rows nor on how tasks share them."""

    def __init__(self, rounds: int = 300, depth: int = 5, step: float = 0.05, subsample: float = 0.85, columns: float = 0.8, l2: float = 1.0, least: float = 1.0, seed: int = 42):
        self.rounds, self.depth, self.step, self.subsample, self.columns, self.l2, self.least, self.seed = rounds, depth, step, subsample, columns, l2, least, seed
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, key: np.ndarray | None = None) -> Trees:
        weight = np.ones(len(y), int) if weight is None else weight
        key = np.arange(len(y)) if key is None else key
        cuts = [cuts_of(at_ranks(np.sort(c), weight[np.argsort(c)], ranks(weight.sum()))) for c in x.T]
        growing(lambda sums: sums, [self.grow(binned(x, cuts), cuts, y, weight, key, int(weight.sum()))])
        return self

    def grow(self, bins: list[np.ndarray], cuts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, key: np.ndarray, n: int) -> Generator[np.ndarray, np.ndarray, None]:
        """Grows the trees; yields the sums of these rows level by level and is sent those of all ``n`` rows. ``bins`` has
        an array for each column with cuts."""
        rng, scale, width = np.random.default_rng(self.seed), 2.0 ** (52 - n.bit_length()), len(cuts)
        of = dict(zip((c for c in range(width) if len(cuts[c])), bins, strict=True))
        # of a column whose rows are mostly in one bin the others are counted; the rest of the node is in that bin
        most = {c: int(np.bincount(b, minlength=1).argmax()) for c, b in of.items()}
        other = {c: at if 2 * len(at := np.flatnonzero(b != most[c])) < len(b) else None for c, b in of.items()}
        few = {c: b if other[c] is None else b[other[c]] for c, b in of.items()}
        heavy = [np.arange(len(y)), *(at for j in range(1, int(weight.max(initial=1))) if len(at := np.flatnonzero(weight > j)))]
        key, total = key.astype(np.uint64), np.zeros(len(y))
        for turn in range(self.rounds):
            p = 1 / (1 + np.exp(-total))
            used = np.zeros(len(y))
            for j, at in enumerate(heavy):
                used[at] += uniform(key[at], self.seed + turn * WEIGHT + j) < self.subsample
            some = np.sort(rng.choice(width, max(1, round(self.columns * width)), replace=False))
            told = [c for c in some if len(cuts[c])]
            open_ = np.array([[k < len(cuts[c]) for k in range(BINS)] for c in some])
            gh = [np.rint(scale * v) * used for v in (p - y, p * (1 - p))]
            column, limit, value = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf), np.zeros(2**self.depth)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, wide = 2**level - 1, 2**level
                whole = np.stack([np.bincount(node, v, wide) for v in gh], dtype=float)  # without rows they are integers
                own = [whole[:, :, None]]
                for c in told:
                    at, m = other[c], len(cuts[c]) + 1
                    cell = (node if at is None else node[at]) * m + few[c]
                    sums = np.stack([np.bincount(cell, v if at is None else v[at], wide * m).reshape(wide, m) for v in gh], dtype=float)
                    if at is not None:
                        sums[:, :, most[c]] += whole - sums.sum(axis=2)
                    own.append(sums[:, :, :-1])
                sums = (yield np.concatenate(own, axis=2).ravel()).reshape(2, wide, -1) / scale
                left = np.zeros((2, wide, len(some), BINS))
                left[:, :, open_] = sums[:, :, 1:]
                (gl, hl), (gt, ht) = np.cumsum(left, axis=3), sums[:, :, 0, None, None]
                gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                gain[(hl < self.least) | (ht - hl < self.least) | ~open_] = 0
                best, each = gain.reshape(wide, -1).argmax(axis=1), np.arange(wide)
                split = gain.reshape(wide, -1)[each, best] > 1e-12
                column[first : first + wide] = some[best // BINS]
                right = np.zeros(len(y), bool)
                for k in np.flatnonzero(split):
                    limit[first + k] = cuts[some[best[k] // BINS]][best[k] % BINS]
                for c in np.unique(some[best // BINS][split]):
                    bound = np.where(split & (some[best // BINS] == c), best % BINS, BINS)
                    right |= of[c] > bound[node]
                node = 2 * node + right
            gs, hs = (np.where(split, v.reshape(wide, -1)[each, best], t.ravel()) for v, t in ((gl, gt), (hl, ht)))
            value[0::2] = -self.step * gs / (hs + self.l2)
            value[1::2] = -self.step * (gt.ravel() - gs) / (ht.ravel() - hs + self.l2)
            total += value[node]
            self.trees.append((column, limit, value))

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for column, limit, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), column[node]] > limit[node])
            total += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each key (splitmix64)."""
    z = key + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((z ^ z >> np.uint64(31)) >> np.uint64(11)) * 2.0**-53


def ranks(n: int) -> np.ndarray:
    """Places, from 0, of the quantiles of n values that bound bins, and of the largest."""
    return np.append(np.arange(1, BINS) * (int(n) - 1) // BINS, int(n) - 1)


def at_ranks(values: np.ndarray, counts: np.ndarray, places: np.ndarray, before: int = 0) -> np.ndarray:
    """Those of ascending values that stand at any of the places, where value i stands ``counts[i]`` times and ``before``
    smaller ones are not here."""
    ends = before + np.cumsum(counts)
    return values[np.searchsorted(ends, places[(places >= before) & (places < ends[-1])], side="right")] if len(values) else values


def cuts_of(found: np.ndarray) -> np.ndarray:
    """Bounds of bins from the values at ranks(): a row is left of a bound with values up to it, or without one (NaN)."""
    cuts = np.unique(found)[:-1]
    return cuts[~np.isnan(cuts)]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
    """The bins of each column that has cuts."""
    return [np.where(np.isnan(c), 0, np.searchsorted(q, c, side="left")).astype(np.uint8) for q, c in zip(cuts, x.T, strict=True) if len(q)]


def growing(total: Callable[[np.ndarray], np.ndarray], trees: list[Generator[np.ndarray, np.ndarray, None]]) -> None:
    """Grows trees of the same rounds and depth in step; ``total`` makes sums of all rows from those of the own ones."""
    sums = [next(t) for t in trees]
    while sums:
        whole = np.split(total(np.concatenate(sums)), np.cumsum([len(s) for s in sums])[:-1])
        sums = [s for t, w in zip(trees, whole, strict=True) if (s := _sent(t, w)) is not None]


def _sent(tree: Generator[np.ndarray, np.ndarray, None], whole: np.ndarray) -> np.ndarray | None:
    try:
        return tree.send(whole)
    except StopIteration:
        return None


def _prompt(peer: Connection) -> Connection:
    s = socket.socket(fileno=peer.fileno())
    s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    s.detach()
    return peer


def meeting() -> Callable[[np.ndarray], np.ndarray]:
    """In a task of a barrier stage: a function that adds up arrays over its tasks. The first task adds, and the others
    connect to it with a key that Spark hands round."""
    context = BarrierTaskContext.get()
    tasks, me = context.getTaskInfos(), context.partitionId()
    if me == 0:
        key = secrets.token_bytes(32)
        listener = Listener(("0.0.0.0", 0), backlog=len(tasks), authkey=key)
        context.allGather(json.dumps([listener.address[1], key.hex()]))
        peers = [_prompt(listener.accept()) for _ in tasks[1:]]
        listener.close()

        def added(own: np.ndarray) -> np.ndarray:
            whole = own.copy()
            for peer in peers:
                whole += np.frombuffer(peer.recv_bytes())
            for peer in peers:
                peer.send_bytes(whole.tobytes())
            return whole

        return added
    port, key = json.loads(next(m for m in context.allGather("") if m))
    first = _prompt(Client((tasks[0].address.rsplit(":", 1)[0], port), authkey=bytes.fromhex(key)))

    def asked(own: np.ndarray) -> np.ndarray:
        first.send_bytes(own.tobytes())
        return np.frombuffer(first.recv_bytes())

    return asked


def quantile_cuts(sets: DataFrame, order: list[str], sizes: dict[int, int]) -> dict[int, list[np.ndarray]]:
    """For each fold of ``sizes`` (rows of the other folds) the cuts of each column over the rows of the other folds. Values
    are counted, sorted over all tasks and stored; each task then starts from the sums of those before it."""
    names = {k: f"m{k}" for k in sizes}
    cells = sets.select("__own", "__w", F.posexplode(F.array(*order)).alias("__c", "__v")).groupBy("__c", "__v")
    cells = cells.agg(*(F.sum(F.when(F.col("__own") != k, F.col("__w")).otherwise(0)).alias(m) for k, m in names.items()))
    cells = cut(cells.repartitionByRange("__c", "__v").sortWithinPartitions("__c", "__v")).withColumn("__p", F.spark_partition_id())
    before, passed = {}, np.zeros((len(order), len(sizes)), int)
    for r in sorted(cells.groupBy("__p", "__c").agg(*(F.sum(m).alias(m) for m in names.values())).collect()):
        before[r[0], r[1]] = passed[r[1]].copy()
        passed[r[1]] += r[2:]

    def values(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reached = dict(before)
        for pdf in parts:
            for at, rows in pdf.groupby(["__p", "__c"]):
                for (k, m), passed in zip(names.items(), reached[at], strict=True):
                    found = at_ranks(rows["__v"].to_numpy(), rows[m].to_numpy(), ranks(sizes[k]), passed)
                    yield pd.DataFrame({"k": k, "c": at[1], "v": np.unique(found)})
                reached[at] = reached[at] + rows[list(names.values())].to_numpy().sum(axis=0)

    found = {k: [[] for _ in order] for k in sizes}
    for r in cells.mapInPandas(values, "k int, c int, v double").collect():
        found[r.k][r.c].append(r.v)
    return {k: [cuts_of(np.array(v, float)) for v in columns] for k, columns in found.items()}


def fit_all(sets: DataFrame, order: list[str], sizes: dict[int, int], tasks: int, how: dict) -> list[Row]:
    """(k, model) for each fold of ``sizes`` (rows of the other folds), fitted to all of ``sets`` by tasks that hold their
    part of the rows as bins and meet at each level."""
    cuts = quantile_cuts(sets, order, sizes)

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {k: [] for k in sizes}
        for pdf in parts:
            for k in sizes:
                rest = pdf[pdf["__own"] != k]
                held[k].append((*(rest[c].to_numpy() for c in ("__y", "__w", "__key")), *binned(rest[order].to_numpy(float), cuts[k])))
        made, grown = {}, []
        for k, n in sizes.items():
            empty = (np.zeros(0), np.zeros(0, int), np.zeros(0, int), *(np.zeros(0, np.uint8) for q in cuts[k] if len(q)))
            y, weight, key, *bins = (np.concatenate(v) for v in zip(empty, *held.pop(k), strict=True))
            made[k] = Trees(**how)
            grown.append(made[k].grow(bins, cuts[k], y, weight, key, n))
        growing(meeting(), grown)
        if BarrierTaskContext.get().partitionId() == 0:
            yield pd.DataFrame({"k": list(made), "model": [pickle.dumps(m) for m in made.values()]})

    # a barrier stage is repeated after a fault only if a shuffle follows
    return sets.repartition(tasks).mapInPandas(fit, "k int, model binary", barrier=True).repartition(1).collect()


def out_of_fold(df: DataFrame, order: list[str], fold: str, rows: int = TASK_ROWS, **how) -> DataFrame:
    """``df`` with ``score``: each row scored by trees fitted to all rows of the other folds. A fold whose rest has one
    label only is scored 0. Up to ``rows`` rows trees are fitted a fold a task, beyond by all tasks together (fit_all), and
    then sent to all rows. Rows are made once and stored: features written out anew in each plan fill the driver."""
    kept = cut(assembled(df, order))
    y = F.col("y").cast("double")
    counts = kept.filter(F.col(fold).isNotNull()).groupBy(fold).agg(F.count(y).alias("n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("ones")).orderBy(fold).collect()
    folds, n, ones = [r[0] for r in counts], sum(r.n for r in counts), sum(r.ones for r in counts)
    sizes = {k: n - r.n for k, r in enumerate(counts) if 0 < ones - r.ones < n - r.n}  # those with both labels
    if not sizes:
        return kept.withColumn("score", F.lit(0.0))
    own = (F.array_position(F.array(*map(F.lit, folds)), F.col(fold)) - 1).cast("int")
    sets = kept.filter(F.col(fold).isNotNull() & y.isNotNull()).select(own.alias("__own"), y.alias("__y"), *order).groupBy("__own", "__y", *order).agg(F.count("*").alias("__n"))
    sets = sets.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(__n - 1) div {WEIGHT}"))).alias("__i"))
    sets = cut(sets.select("__own", "__y", *order, F.least(F.lit(WEIGHT), F.col("__n") - F.col("__i") * WEIGHT).alias("__w"), F.xxhash64("__own", "__y", *order, "__i").alias("__key")))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        made = Trees(**how).fit(pdf[order].to_numpy(float), *(pdf[c].to_numpy() for c in ("__y", "__w", "__key")))
        return pd.DataFrame({"k": [key[0]], "model": [pickle.dumps(made)]})

    if n > rows:
        sc = df.sparkSession.sparkContext._jsc.sc()
        slots = sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())
        fitted = fit_all(sets, order, sizes, max(1, min(slots, TASKS, -(-n // rows))), how)
    else:
        rest = sets.withColumn("__k", F.explode(F.array(*map(F.lit, sizes)))).filter("__k != __own")
        fitted = rest.groupBy("__k").applyInPandas(fit, "k int, model binary").collect()
    held = df.sparkSession.sparkContext.broadcast({folds[r.k]: bytes(r.model) for r in fitted})

    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = {k: pickle.loads(m) for k, m in held.value.items()}
        for pdf in parts:
            pdf["score"] = 0.0
            for k, model in ready.items():
                own = (pdf[fold] == k).to_numpy()
                if own.any():
                    pdf.loc[own, "score"] = model.probability(pdf.loc[own, order].to_numpy(float))
            yield pdf

    return kept.mapInPandas(scored, StructType([*kept.schema.fields, StructField("score", DoubleType())]))
