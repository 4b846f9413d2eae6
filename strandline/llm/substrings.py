"""Repeated substrings by a sparse suffix order, merged from front-coded sorted runs.

Every string of ``length`` bytes is represented by the suffix that starts at its minimizer: the leftmost smallest hashed
seed of SEED bytes in it. Equal strings have their minimizers at the same place, so to find all strings that occur twice
it is enough to order the suffixes at minimizers. Seeds that occur once in the corpus are dropped first.

Each task sorts the suffixes it has (to ``length`` bytes) into a run for each part of the seed space and writes the run
front-coded: how many bytes a suffix shares with the one before it, and the rest. A part's runs are merged by a loser
tree that keeps, for each run, the common prefix with the last winner, and so compares no byte twice that is known to
be equal. What comes out is the suffix order with its common prefixes; ordering the texts before the minimizers in the
same way gives common prefixes to the left, and for each offset the strings that agree on both sides are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import batches, scoped, small, stored

LENGTH, SEED = 400, 64
#: Strings from so many bytes on, about 40 words, are reported as repeated, though only those of LENGTH are removed.
PASSAGE = 240
#: Seeds at more places than these are told to all tasks, so that none has to hold a very common passage.
HOT_SEED = 2_000
#: Such seeds (a number each) are broadcast up to so many, after they have been counted.
HOT_ROWS = 200_000
#: Runs are cut at so many bytes of contexts, which bounds a task's memory while it sorts.
RUN_BYTES = 24_000_000
#: Texts, and runs, that a Python worker is handed at once.
BATCH_ROWS, BATCH_RUNS = 500, 16
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))
_BLOCK = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_UP, _DOWN = _powers(_PRIME, _BLOCK + SEED), _powers(_INVERSE, _BLOCK + SEED)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def seed_hashes(b: np.ndarray, seed: int = SEED) -> np.ndarray:
    """A 64-bit hash of each run of ``seed`` bytes, by block so that memory stays a small multiple of the text."""
    out = np.empty(max(0, len(b) - seed + 1), np.uint64)
    for at in range(0, len(out), _BLOCK):
        part = b[at : at + _BLOCK + seed - 1].astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _UP[: len(part)], out=total[1:])
        n = len(part) - seed + 1
        out[at : at + n] = _mix((total[seed:] - total[:n]) * _DOWN[:n])
    return out


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """The places of the leftmost least hash of every window of ``width`` hashes, ascending."""
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(0, np.int64)
    # 48 bits of hash, then how far right: the least of these is the leftmost of the least
    found = []
    for at in range(0, n, _BLOCK):
        part = h[at : at + _BLOCK + width - 1]
        key = ((part >> np.uint64(24)) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        pad = -len(key) % width
        blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        m = len(part) - width + 1
        least = np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64) + at  # never falls from one window to the next
        found.append(place[np.concatenate([[True], place[1:] != place[:-1]])])
    place = np.concatenate(found)
    return place[np.concatenate([[True], place[1:] != place[:-1]])]


def anchors(text: bytes, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(places, seed hashes) of the minimizers of all strings of ``length`` bytes of a text."""
    if len(text) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = seed_hashes(np.frombuffer(text, np.uint8), seed)
    at = minimizers(h, length - seed + 1)
    return at, h[at]


def starts(at: np.ndarray, h: np.ndarray, n: int, length: int = LENGTH, seed: int = SEED) -> list[tuple[int, int]]:
    """For each anchor the range (first, last) of strings whose minimizer it is: bounded by better anchors near it.

    An anchor to the left rules out strings that hold it if its hash is not larger, one to the right if smaller.
    """
    order = h >> np.uint64(24)
    width = length - seed + 1
    out = []
    for i, p in enumerate(at.tolist()):
        lo, hi = max(0, p - width + 1), min(p, n - length)
        j = i - 1
        while j >= 0 and at[j] >= lo:
            if order[j] <= order[i]:
                lo = int(at[j]) + 1
                break
            j -= 1
        j = i + 1
        while j < len(at) and at[j] <= hi + width - 1:
            if order[j] < order[i]:
                hi = min(hi, int(at[j]) - width)
                break
            j += 1
        out.append((lo, hi))
    return out


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """How many bytes two strings share from the start, given that they share ``known``."""
    n = min(len(a), len(b))
    step = 16
    while known < n:
        end = min(n, known + step)
        if a[known:end] == b[known:end]:
            known, step = end, step * 2
        elif step == 1 or end - known == 1:
            return known
        else:
            n, step = end, max(1, (end - known) // 2)
    return known


def front_code(sorted_strings: list[bytes]) -> tuple[list[int], bytes]:
    """(bytes shared with the one before, for each string; all that is not shared, joined)."""
    shared, rest, last = [], [], b""
    for s in sorted_strings:
        k = common(last, s)
        shared.append(k)
        rest.append(s[k:])
        last = s
    return shared, b"".join(rest)


def front_decode(shared: list[int], sizes: list[int], rest: bytes) -> Iterator[tuple[int, bytes]]:
    """(bytes shared with the one before, string) for each string of a run."""
    at, last = 0, b""
    for k, n in zip(shared, sizes, strict=True):
        last = last[:k] + rest[at : at + n - k]
        at += n - k
        yield k, last


class LoserTree:
    """Merges sorted runs of (common prefix with the one before, string, tag) into one such run.

    Each waiting head knows its common prefix with the string that went out last. Of two heads the one that shares more
    with it is smaller; only if they share as much are bytes compared, and from there on. The loser of a match stays at
    its node with the prefix it shares with the winner, which is what it shares with the next one to go out there.
    """

    def __init__(self, runs: list[Iterator]):
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.runs = [*runs, *(iter(()) for _ in range(self.size - len(runs)))]
        self.compared = 0
        self.node = [None] * self.size
        heads = [self._next(i) for i in range(self.size)]
        while len(heads) > 1:
            level = []
            for i in range(0, len(heads), 2):
                win, lose = self._match(heads[i], heads[i + 1])
                self.node[(len(heads) + i) // 2] = lose
                level.append(win)
            heads = level
        self.top = heads[0]

    def _next(self, i: int):
        """(shared, string, tag, run) or, at the end of a run, None in place of a string."""
        for shared, string, tag in self.runs[i]:
            return [shared, string, tag, i]
        return [-1, None, None, i]

    def _match(self, a, b):
        if a[1] is None or b[1] is None:
            return (b, a) if a[1] is None else (a, b)
        if a[0] != b[0]:  # the one that shares less with the last winner is larger, and keeps that number
            return (a, b) if a[0] > b[0] else (b, a)
        k = common(a[1], b[1], a[0])
        self.compared += k - a[0] + 1
        win, lose = (a, b) if a[1][k : k + 1] <= b[1][k : k + 1] else (b, a)
        lose[0] = k
        return win, lose

    def __iter__(self):
        while self.top[1] is not None:
            shared, string, tag, run = self.top
            yield shared, string, tag
            head = self._next(run)
            at = (self.size + run) // 2
            while at:
                head, self.node[at] = self._match(head, self.node[at])
                at //= 2
            self.top = head


def _bytes(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def text_key(text: bytes) -> bytes:
    return hashlib.md5(text, usedforsecurity=False).digest()


def _scan(length: int, seed: int):
    """For each distinct text of a batch: key, bytes, and its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                raw = _bytes(text)
                at, h = anchors(raw, length, seed)
                rows.append((text_key(raw), len(raw), at.tolist(), h.view(np.int64).tolist()))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.list_(pa.int64()))], names=["key", "n", "at", "h"])

    return run


def windows(raw: bytes, at: np.ndarray, h: np.ndarray, lengths: tuple[int, ...], seed: int) -> dict[int, tuple[int, int]]:
    """For each anchor of the shortest length (first, end) of the bytes that the strings it stands for cover, of every
    length: a minimizer of a longer string is one of the shorter strings that hold it, too."""
    out: dict[int, tuple[int, int]] = {}
    for length in lengths:
        if len(raw) < length:
            continue
        own, its = (at, h) if length == min(lengths) else anchors(raw, length, seed)
        for p, (lo, hi) in zip(own.tolist(), starts(own, its, len(raw), length, seed), strict=True):
            if lo <= hi:
                a, b = out.get(p, (lo, hi + length))
                out[p] = min(a, lo), max(b, hi + length)
    return out


def _runs(lengths: tuple[int, ...], seed: int, parts: int):
    """Front-coded sorted runs of the contexts of wanted anchors. Contexts that repeat in a task are sent once."""

    def cut(held: dict) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list] = {}
        for (right, left), (h, tags, many) in held.items():
            by_part.setdefault((h >> 20) % parts, []).append((right, left, tags, many))
        for part, rows in by_part.items():
            rows.sort(key=lambda r: (r[0], r[1]))
            shared, rest = front_code([r[0] for r in rows])
            by_left = sorted(range(len(rows)), key=lambda i: rows[i][1])
            shared_left, rest_left = front_code([rows[i][1] for i in by_left])
            made = {"part": part, "shared": shared, "sizes": [len(r[0]) for r in rows], "rest": rest, "left_order": by_left, "left_shared": shared_left, "left_sizes": [len(rows[i][1]) for i in by_left], "left_rest": rest_left, "many": [r[3] for r in rows], "tags": [len(r[2]) for r in rows], "tag_key": [t[0] for r in rows for t in r[2]], "tag_at": [t[1] for r in rows for t in r[2]]}
            yield pa.RecordBatch.from_pylist([made], RUN_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                key, raw, wanted = row[0].as_py(), _bytes(row[1].as_py()), set(row[2].as_py())
                at, h = anchors(raw, min(lengths), seed)
                spans = windows(raw, at, h, lengths, seed)
                for p, x in zip(at.tolist(), h.tolist(), strict=True):
                    if p in wanted and p in spans:
                        lo, end = spans[p]
                        context = raw[p:end], raw[lo:p][::-1]
                        if context in held:
                            held[context][1].append((key, p))
                            held[context][2] = True
                        else:
                            held[context] = [x, [(key, p)], False]
                            size += end - lo
                        if size > RUN_BYTES:
                            yield from cut(held)
                            held, size = {}, 0
        yield from cut(held)

    return run


_LISTS = [pa.field(n, pa.list_(pa.int32())) for n in ("shared", "sizes", "left_order", "left_shared", "left_sizes")]
RUN_SCHEMA = pa.schema([pa.field("part", pa.int32()), *_LISTS, pa.field("rest", pa.binary()), pa.field("left_rest", pa.binary()), pa.field("many", pa.list_(pa.bool_())), pa.field("tags", pa.list_(pa.int32())), pa.field("tag_key", pa.list_(pa.binary())), pa.field("tag_at", pa.list_(pa.int64()))])
RUN_DDL = "part int, shared array<int>, sizes array<int>, left_order array<int>, left_shared array<int>, left_sizes array<int>, rest binary, left_rest binary, many array<boolean>, tags array<int>, tag_key array<binary>, tag_at array<bigint>"


def merge(runs: list[dict], lengths: tuple[int, ...]) -> Iterator[tuple[bytes, int, int, int]]:
    """(text, first byte, byte after the last, length) of repeated strings of each length among runs of one part."""

    def right(n, r):
        return ((k, s, (n, i)) for i, (k, s) in enumerate(front_decode(r["shared"], r["sizes"], r["rest"])))

    def left(n, r):
        return ((k, s, (n, i)) for i, (k, s) in zip(r["left_order"], front_decode(r["left_shared"], r["left_sizes"], r["left_rest"]), strict=True))

    order, lcp, size = [], [], []
    for k, s, tag in LoserTree([right(n, r) for n, r in enumerate(runs)]):
        lcp.append(k)
        size.append(len(s))
        order.append(tag)
    place = {tag: i for i, tag in enumerate(order)}
    left_order, left_lcp, left_size = [], [], []
    for k, s, tag in LoserTree([left(n, r) for n, r in enumerate(runs)]):
        left_lcp.append(k)
        left_size.append(len(s))
        left_order.append(place[tag])
    first_tag = [np.cumsum([0, *r["tags"]]).tolist() for r in runs]
    lcp, size, left_lcp, left_size, left_order = (np.array(x, np.int64) for x in (lcp, size, left_lcp, left_size, left_order))
    n = len(order)
    many = np.array([runs[r]["many"][i] for r, i in order], bool)
    left_of = np.zeros(n, np.int64)
    left_of[left_order] = left_size
    # a group: suffixes that share at least a seed with the one before
    for length in lengths:
        repeated: list[list[int]] = [[] for _ in range(n)]
        for offset in range(min(length, int(left_size.max(initial=0)) + 1)):
            need = length - offset
            fits = np.flatnonzero((left_of >= offset) & (size >= need))
            if len(fits) < 1:
                continue
            right_class = np.cumsum(lcp < need)
            left_class = np.zeros(n, np.int64)
            left_class[left_order] = np.cumsum(left_lcp < offset)
            both = right_class[fits] * (n + 1) + left_class[fits]
            _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
            for i in fits[(count[inverse] > 1) | many[fits]].tolist():
                repeated[i].append(offset)
        for i, offsets in enumerate(repeated):
            if not offsets:
                continue
            run, j = order[i]
            r = runs[run]
            spans = []
            for o in reversed(offsets):  # from the leftmost string on
                if spans and -o <= spans[-1][1]:
                    spans[-1][1] = length - o
                else:
                    spans.append([-o, length - o])
            for t in range(first_tag[run][j], first_tag[run][j + 1]):
                key, p = r["tag_key"][t], r["tag_at"][t]
                for a, b in spans:
                    yield key, p + a, p + b, length


def _merge(lengths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows):
            found = list(merge(rows, lengths)) if rows else []
            cols = list(zip(*found, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["key", "lo", "hi", "length"])

        part, rows = None, []
        for batch in batches:  # sorted by part: a part's runs come one after another
            for row in batch.to_pylist():
                if row["part"] != part:
                    yield made(rows)
                    part, rows = row["part"], []
                rows.append(row)
        yield made(rows)

    return run


@scoped
def repeats(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH, PASSAGE), seed: int = SEED, text_col: str = "text") -> DataFrame:
    """(key, spans): for distinct texts (key: md5) the bytes lo to hi that strings of a ``length`` cover which occur more
    than once; spans may overlap."""
    # equal texts are one here, however many rows hold them
    shortest = min(lengths)
    texts = docs.select(F.col(text_col).alias("text")).filter(F.octet_length("text") >= shortest)
    spark = docs.sparkSession
    with batches(spark, BATCH_ROWS):
        scanned = stored(texts.mapInArrow(_scan(shortest, seed), "key binary, n bigint, at array<bigint>, h array<bigint>"), "anchors")
    distinct = stored(scanned.groupBy("key").agg(F.first("n").alias("n"), F.count("*").alias("copies"), F.first("at").alias("at"), F.first("h").alias("h")), "texts")
    each = F.explode(F.array(*(F.lit(x).cast("bigint") for x in lengths)))
    whole = distinct.filter("copies > 1").select("key", F.lit(0).cast("bigint").alias("lo"), F.col("n").alias("hi"), each.alias("length")).filter("hi >= length")
    single = distinct.select("key", F.explode(F.arrays_zip("at", "h")).alias("x")).select("key", "x.at", "x.h")
    again = stored(single.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "seeds")
    # the seeds of very common passages go to all tasks, so that their places stay where they are; the rest is dealt out
    hot = small(again.filter(F.col("n") > HOT_SEED).select("h"), HOT_ROWS)
    often = single.join(hot, "h", "left_semi")
    seldom = single.join(hot, "h", "left_anti").join(again.filter(F.col("n") <= HOT_SEED).select("h"), "h", "left_semi")
    wanted = stored(often.unionByName(seldom).groupBy("key").agg(F.collect_list("at").alias("wanted")), "wanted")
    keyed = texts.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    # what is wanted grows with the texts, so it is dealt out with them, and hashed there instead of sorting texts
    rows = keyed.join(wanted.hint("shuffle_hash"), "key")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = rows.select("key", "text", "wanted").dropDuplicates(["key"]).mapInArrow(_runs(lengths, seed, 4 * parts), RUN_DDL)
    with batches(spark, BATCH_ROWS):
        runs = stored(runs, "runs")
    merged = runs.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_merge(lengths), "key binary, lo bigint, hi bigint, length bigint")
    found = merged.unionByName(whole).distinct()
    with batches(spark, BATCH_RUNS):
        return stored(found.groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "length")).alias("spans")), "spans", keep=True)


def _joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans that touch or overlap as one, ascending."""
    runs: list[list[int]] = []
    for lo, hi in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    return runs


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(k, BATCH_ROWS) for x in batches for k in range(0, x.num_rows, BATCH_ROWS)):
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = _bytes(text)
                runs = _joined([(x["lo"], x["hi"]) for x in spans or [] if x["length"] == length])
                kept, at = [], 0
                for lo, hi in runs:
                    kept.append(raw[at:lo])
                    at = hi
                kept = b"".join([*kept, raw[at:]])
                repeated = sum(hi - lo for lo, hi in _joined([(x["lo"], x["hi"]) for x in spans or []]))
                rows.append((len(raw), len(raw) - len(kept), repeated, [{"lo": a, "hi": b} for a, b in runs], kept))
            cols = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(cols[4], pa.binary())], names=["id", "n_bytes", "n_removed", "n_repeated", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE) -> DataFrame:
    """(id, n_bytes, n_removed, n_repeated, spans, kept) of each row: its text as UTF-8 without the bytes that any string
    of ``length`` bytes covers which also starts anywhere else in the table, in the same text or another.

    ``spans`` are the maximal removed runs, ``kept`` (binary) the remaining bytes joined. ``n_repeated`` counts the bytes
    that repeated strings of ``passage`` bytes cover, which stay if they are shorter than ``length``; a passage from
    ``length`` on is not looked for. Null texts are empty; texts shorter than ``length`` lose nothing; rows that repeat a
    text are copies of each other, so both lose all of it; a null id stays null; an empty table gives no rows; matches
    never cross rows.
    """
    grouped = repeats(docs, (length, passage) if passage < length else (length,), seed, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    rows = keyed.join(grouped.hint("shuffle_hash"), "key", "left").select("id", "text", "spans")
    made = rows.mapInArrow(_cut(length), f"id {kind}, n_bytes bigint, n_removed bigint, n_repeated bigint, spans array<struct<lo:bigint,hi:bigint>>, kept binary")
    return made.withColumnRenamed("id", id_col)
