"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A sketch has T coordinates. In round i < T every shingle is dropped into a hashed bin with a hashed value; in round
T + i all fall into bin i. A coordinate keeps the least value of the earliest round that reached its bin, so after at most
2 T rounds every coordinate is filled, whatever the size of the set, and the share of equal coordinates is concentrated
around the Jaccard similarity. R coordinates make a band; texts that share a band are candidates, verified on full sets.

Texts with equal shingle sets are one node from the start. Within a band's bucket members are not paired with each other
but with a few representatives; links found make components, and only pairs of a bucket that are in different components
are then compared, in blocks of sets against blocks of sets, from
which only links come out. So no link between components is lost, and no task holds a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import batches, bucket_components, components, merged, scoped, small, stored

T, R = 128, 4  # coordinates, and coordinates to a band: at similarity 0.8 a pair misses all 32 bands once in 2e7
BLOCK = 128  # sets that are compared with as many others at once
#: Candidate ids up to so many are broadcast to pick their texts, after they have been counted.
BROADCAST_ROWS = 500_000
#: Ids of the sets that pairs ask for are broadcast up to so many, after they have been counted.
PAIR_ROWS = 500_000
STEPS = 4  # parts in which bands are compared with their heads, one after another
PAIRS_AT_ONCE = 256  # pairs of sets that a worker is handed at once
SALT_ROWS = 500  # pairs of one representative that go to one task together
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.cumprod(np.full(1 << 12, _PRIME | np.uint64(1), np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text: runs other than ASCII white space, A-Z as a-z."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    b = np.frombuffer(raw, np.uint8)
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    inside = np.flatnonzero(~gap)
    if not len(inside):
        return np.zeros(0, np.uint64)
    fresh = np.concatenate([[True], np.diff(inside) > 1])
    first = np.flatnonzero(fresh)
    place = np.arange(len(inside)) - np.repeat(first, np.diff(np.append(first, len(inside))))
    # a byte's weight depends on its place in the word alone; the table is carried on for the places beyond it
    longest = int(place.max()) + 1
    powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.full(longest, _PRIME | np.uint64(1), np.uint64))
    weight = powers[place]
    total = np.add.reduceat((b[inside].astype(np.uint64) + np.uint64(1)) * weight, first)
    return _mix(total + np.diff(np.append(first, len(inside))).astype(np.uint64) * _PRIME)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of ``width`` words; of all its words if they are fewer."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    total = np.full(n, np.uint64(len(w)) if len(w) < width else np.uint64(width))
    for k in range(min(width, len(w))):
        total = _mix(total * _PRIME + w[k : k + n])
    return np.unique(total)


_SEEDS = _mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * _PRIME)


def sketch(x: np.ndarray) -> np.ndarray:
    """The T coordinates of a non-empty set of hashes. Rounds go on until no coordinate is empty."""
    out, filled, i = np.zeros(T, np.uint64), np.zeros(T, bool), 0
    while not filled.all():
        if i < T:
            h = _mix(x ^ _SEEDS[i])
            bins, value = (h >> np.uint64(57)).astype(np.intp), h << np.uint64(7)
            order = np.lexsort((value, bins))
            where = bins[order]
            at = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            got, low = where[at], value[order][at]
            new = ~filled[got]
            # the round is part of the value: equal coordinates come from equal rounds
            out[got[new]] = low[new] + np.uint64(i % 128)
            filled[got[new]] = True
            i += 1
        else:
            rest = np.flatnonzero(~filled)
            for j in rest:
                out[j] = _mix(x ^ _SEEDS[T + j]).min()
            filled[rest] = True
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of R coordinates, its number mixed in."""
    total = _SEEDS[: T // R].copy()
    for k in range(R):
        total = _mix(total * _PRIME + coordinates[k::R])
    return total.view(np.int64)


def _set_key(x: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set_key, bands) of each row; sets without shingles have neither key nor bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, found = [], [], []
            for text in batch.column(1).to_pylist():
                x = shingles(text, width)
                sizes.append(len(x))
                keys.append(_set_key(x) if len(x) else None)
                found.append(bands(sketch(x)) if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["id", "n_shingles", "set_key", "bands"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, set binary): the shingle sets of the wanted ids, made anew from their texts; an id has one row for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_set_key(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "set_key", "set"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.join(small(wanted.select("id"), BROADCAST_ROWS), "id", "left_semi").mapInArrow(run, "id bigint, set_key binary, set binary").dropDuplicates(["id", "set_key"]).drop("set_key")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose sets have 100 * intersection >= percent * union. Pairs of a hot ``b`` are dealt over salts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    hot = pairs.groupBy("b").agg(F.floor(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    dealt = pairs.join(hot, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts") + 1).cast("int")).drop("salts")
    # a later round asks for few sets: only those are moved
    sets = sets.join(small(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), PAIR_ROWS), "id", "left_semi")
    rights = sets.withColumnRenamed("id", "b").withColumnRenamed("set", "set_b").join(hot, "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts")))).drop("salts")
    met = dealt.join(sets.withColumnRenamed("id", "a").withColumnRenamed("set", "set_a"), "a").join(rights, ["b", "salt"])
    with batches(pairs.sparkSession, PAIRS_AT_ONCE):
        return stored(met.select("a", "b", "set_a", "set_b").mapInArrow(run, "a bigint, b bigint"), "verified")


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of two lists of sets, by products of their incidence matrices over what occurs
    twice, some columns at a time."""
    both = [*xs, *ys]
    out = np.zeros((len(xs), len(ys)))
    if not sum(map(len, both)):
        return out
    _, kind, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    twice = count > 1
    keep = twice[kind]
    column, row = (np.cumsum(twice) - 1)[kind[keep]], row[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    wide = 4096
    for at in range(0, int(twice.sum()), wide):
        lo, hi = np.searchsorted(column, (at, at + wide))
        m = np.zeros((len(both), wide), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        out += m[: len(xs)] @ m[len(xs) :].T
    return out


def _between(now: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among nodes of different components that buckets still hold together.

    Nodes that buckets connect are one group; a group is cut into blocks of about BLOCK nodes, a large component into
    blocks of its own, and every two blocks meet unless all in them is one component.
    """
    heads = now.groupBy("key").agg(F.min("node").alias("b"))
    tied = now.join(heads, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    groups = components(tied).select("node", F.col("comp").alias("grp"))
    nodes = stored(now.select("node", "comp").distinct().join(groups, "node"), "left-over")
    sizes = nodes.groupBy("grp", "comp").agg(F.count("*").alias("n"))
    pooled = sizes.filter(F.col("n") < BLOCK).groupBy("grp").agg(F.sum("n").alias("pool"))
    sized = nodes.join(sizes, ["grp", "comp"]).join(pooled, "grp", "left")
    share = lambda n, key: F.pmod(F.xxhash64(key), F.ceil(n / BLOCK))
    block = F.when(F.col("n") >= BLOCK, F.xxhash64("comp", share(F.col("n"), "node"))).otherwise(F.xxhash64(F.lit("pool"), share(F.col("pool"), "comp")))
    rows = sized.select("grp", block.alias("block"), "node", "comp").join(sets.withColumnRenamed("id", "node"), "node")
    packed = stored(rows.groupBy("grp", "block").agg(F.collect_list(F.struct("node", "comp", "set")).alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi")), "blocks")
    one, two = (packed.select("grp", *(F.col(c).alias(f"{c}_{x}") for c in ("block", "lo", "hi"))) for x in "ab")
    met = one.join(two, "grp").filter("block_a <= block_b and not (lo_a = hi_a and lo_b = hi_b and lo_a = lo_b)").select("grp", "block_a", "block_b")
    met = stored(met, "block-pairs")
    first, second = (packed.select("grp", F.col("block").alias(f"block_{x}"), F.col("rows").alias(f"rows_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (na, ca, xs), (nb, cb, ys) = (_unpacked(batch.column(c)[k].values) for c in (0, 1))
                both = overlaps(xs, ys)
                la, lb = (np.array([len(x) for x in q], float) for q in (xs, ys))
                link = (100 * both >= percent * (la[:, None] + lb[None, :] - both)) & (ca[:, None] != cb[None, :])
                i, j = np.nonzero(link)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(na[i], nb[j])), pa.array(np.maximum(na[i], nb[j]))], names=["a", "b"])

    # pairs of blocks are dealt by themselves, so a group is spread over all tasks
    joined = met.join(first, ["grp", "block_a"]).join(second, ["grp", "block_b"])
    with batches(now.sparkSession, 1):
        return stored(joined.select("rows_a", "rows_b").mapInArrow(run, "a bigint, b bigint").distinct(), "block-links")


def _unpacked(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    return rows.field(0).to_numpy(zero_copy_only=False), rows.field(1).to_numpy(zero_copy_only=False), [np.frombuffer(x, np.uint64) for x in rows.field(2).to_pylist()]


def links(docs: DataFrame, width: int, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(signatures with the id of each set's class, components of linked classes): the sets' links, whole.

    The second has (node, comp) for classes that have a link; others are alone.
    """
    found = stored(signatures(docs, width, id_col, text_col), "signatures")
    classes = found.filter("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("node"), F.first("bands").alias("bands"))
    classes = stored(classes, "classes")
    keyed = classes.select("node", F.posexplode("bands").alias("band", "key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # buckets of one are gone here: what is left are members of candidate groups
    shared = stored(keyed.join(full, "key"), "candidates")
    # who meets most others is the likely middle of its group, and heads its buckets first
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    members = stored(shared.join(weight, "node").select("key", "band", "node", F.lit(0).alias("sig"), "weight"), "members")
    sets = stored(_sets(docs, weight.select(F.col("node").alias("id")), width, id_col, text_col), "sets")
    comps = bucket_components(members, lambda pairs: _verified(pairs, sets, percent), rest=lambda now: _between(now, sets, percent), rounds=1, steps=STEPS)
    found = found.join(classes.select("set_key", "node"), "set_key", "left")
    # rows that share an id are one document: their classes are linked, and a row without shingles goes with them
    shared_ids = found.filter("id is not null").groupBy("id").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n"), F.count("node").alias("m"))
    shared_ids = stored(shared_ids.filter("least < most or (m > 0 and m < n)").select("id", "least"), "shared-ids")
    found = found.join(small(shared_ids, BROADCAST_ROWS), "id", "left")
    comps = merged(comps, found.filter("least < node").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())
    return found.withColumn("node", F.coalesce("node", "least")).drop("least"), comps


@scoped
def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row.

    Documents are linked if their sets of ``width``-word shingles have at least ``percent`` hundredths of their union in
    common; component_id is the smallest id that links reach, and kept marks it. Ids are integers (a text that is no number
    is an error: number the rows first). Null and empty texts have no set and are linked with nothing. Rows that share an
    id are one document with the sets of all of them, each row with its own n_shingles; rows with a null id stand alone,
    with a null component, and are kept. An empty table gives no rows.
    """
    found, comps = links(docs, width, percent, id_col, text_col)
    joined = found.select("id", "n_shingles", "node").join(comps, "node", "left")
    comp = F.coalesce("comp", "node", "id")
    joined = joined.select(F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))
    return stored(joined, "near-duplicates", keep=True)
