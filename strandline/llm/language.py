"""Language ID by prediction by partial matching over bytes.

Each language has a variable-order context tree of bytes, up to three bytes deep. Its statistics are counted once from
labelled documents and then frozen. A byte that a context has seen c times of n, among d kinds, costs -log2(c / (n + d));
else an escape of -log2(d / (n + d)) is paid and the next shorter context is asked (method C), down to a flat code over
all bytes; a context that was never seen passes on for nothing. As the statistics are frozen, the cost of every byte after
every context is one number. Those of all strings of four bytes that any language has seen are kept ready, for all
languages side by side, and so are costs and escapes of the shorter contexts for strings that none has seen, so exact
code lengths of whole texts are sums of look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

DEPTH = 3
#: Documented bound of what is learned: documents that statistics are counted from, chosen by hash of the text, alike for
#: every language.
TRAIN_ROWS = 20_000
#: Bytes of a text whose codes are looked up at once, which bounds memory for any length.
STEP = 1 << 16
UNDETERMINED = "und"
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def normal(text: bytes) -> np.ndarray:
    """The bytes that are coded: A-Z as a-z, runs of white space and control bytes as one space, one space at the end, and
    four at the start, of which the last is coded, too."""
    b = np.frombuffer(b"    " + text.translate(_LOWER) + b" ", np.uint8)
    b = np.where(b < 33, np.uint8(32), b)
    keep = np.ones(len(b), bool)
    keep[4:] = (b[4:] != 32) | (b[3:-1] != 32)
    return b[keep]


def strings(text: bytes) -> np.ndarray:
    """Every byte that is coded with its three predecessors as one 32-bit number."""
    b = normal(text).astype(np.uint32)
    return b[:-DEPTH] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]


class Places:
    """Where each of some distinct numbers stands in their order: a table by hash, and a sorted rest of those that fell
    on a taken place."""

    def __init__(self, values: np.ndarray):
        bits = max(8, int(len(values) * 2).bit_length())
        self.shift = np.uint32(32 - bits)
        self.key, self.at = np.zeros(1 << bits, np.uint32), np.full(1 << bits, -1, np.int32)
        slot = self._slot(values)
        self.key[slot], self.at[slot] = values, np.arange(len(values), dtype=np.int32)
        self.rest = np.flatnonzero(self.at[slot] != np.arange(len(values)))
        self.rest = self.rest[np.argsort(values[self.rest], kind="stable")].astype(np.int32)
        self.rest_key = values[self.rest]

    def _slot(self, values: np.ndarray) -> np.ndarray:
        return (values * np.uint32(0x9E3779B1)) >> self.shift

    def find(self, values: np.ndarray) -> np.ndarray:
        """The places of ``values``; -1 for those that are not among the numbers."""
        slot = self._slot(values)
        out = np.where(self.key[slot] == values, self.at[slot], np.int32(-1))
        if len(self.rest):
            left = np.flatnonzero(out < 0)
            k = np.minimum(np.searchsorted(self.rest_key, values[left]), len(self.rest) - 1)
            found = self.rest_key[k] == values[left]
            out[left[found]] = self.rest[k[found]]
        return out


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sums of their counts."""
    kinds, inverse = np.unique(codes, return_inverse=True)
    return kinds, np.bincount(inverse, counts, len(kinds))


def _level(codes: np.ndarray, own: np.ndarray, counts: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(costs of ``codes``, contexts, their escapes) by one language's counts of its ``own`` codes, the last byte of which
    is the symbol; ``below`` are the costs of ``codes`` without their first byte."""
    contexts, at = np.unique(codes >> np.uint32(8), return_inverse=True)
    where = np.searchsorted(contexts, own >> np.uint32(8))
    n, d = np.bincount(where, counts, len(contexts)), np.bincount(where, minlength=len(contexts))
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(n > 0, -np.log2(d / (n + d)), 0.0)
        seen = np.zeros(len(codes))
        seen[np.searchsorted(codes, own)] = counts
        cost = np.where(seen > 0, -np.log2(seen / (n + d)[at]), escape[at] + below)
    return cost, contexts, escape


class Model:
    """Frozen trees of all languages side by side.

    ``codes`` and ``costs``: for strings of 4 and 3 bytes that some language has seen, and for all of 2 bytes, the cost of
    the last byte after the others, a row of all languages; ``contexts`` and ``escapes``: of 3 and of 2 bytes.
    """

    def __init__(self, langs: list[str], codes: list[np.ndarray], costs: list[np.ndarray], contexts: list[np.ndarray], escapes: list[np.ndarray]):
        self.langs, self.codes, self.costs, self.contexts, self.escapes = langs, codes, costs, contexts, escapes
        self.places = [Places(c) for c in codes[:2]]
        self.context_places = [Places(c) for c in contexts]

    def parts(self) -> tuple:
        return self.langs, self.codes, self.costs, self.contexts, self.escapes

    def lengths(self, text: str) -> np.ndarray:
        """The exact code length of a text in bits, for each language."""
        out = np.zeros(len(self.langs))
        whole = strings(text.encode("utf-8", "surrogatepass"))
        for start in range(0, len(whole), STEP):
            w = whole[start : start + STEP]
            for level in range(2):
                at = self.places[level].find(w)
                met = at >= 0
                out += self.costs[level][at[met]].sum(axis=0, dtype=np.float64)
                w = w[~met]
                if not len(w):
                    break
                at = self.context_places[level].find(w >> np.uint32(8))
                out += self.escapes[level][at[at >= 0]].sum(axis=0, dtype=np.float64)
                w = w & np.uint32(0xFFFFFF if level == 0 else 0xFFFF)
            else:
                out += self.costs[2][w].sum(axis=0, dtype=np.float64)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the shortest code and its share of 2 ** -bits among all (equal priors; ties: first by name)."""
        if not self.langs or not text or not has_letter(text):
            return UNDETERMINED, 0.0
        bits = self.lengths(text)
        best = int(bits.argmin())
        return self.langs[best], float(1.0 / np.exp2(bits[best] - bits).sum())


def grown(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The trees of languages from their counts (codes of four bytes, how many times each)."""
    langs = sorted(counts)
    empty = np.zeros(0, np.uint32)
    codes = [np.unique(np.concatenate([empty, *(counts[x][0] for x in langs)]) & np.uint32(mask)) for mask in (0xFFFFFFFF, 0xFFFFFF)] + [np.arange(1 << 16, dtype=np.uint32)]
    contexts = [np.unique(c >> np.uint32(8)) for c in codes[:2]]
    costs: list[list[np.ndarray]] = [[], [], []]
    escapes: list[list[np.ndarray]] = [[], []]
    single = np.arange(256, dtype=np.uint32)
    for x in langs:
        own = [_summed(counts[x][0] & np.uint32(mask), counts[x][1]) for mask in (0xFFFFFFFF, 0xFFFFFF, 0xFFFF, 0xFF)]
        flat, _, _ = _level(single, *own[3], np.full(256, 8.0))
        two, _, _ = _level(codes[2], *own[2], flat[codes[2] & np.uint32(0xFF)])
        three, _, e2 = _level(codes[1], *own[1], two[codes[1] & np.uint32(0xFFFF)])
        four, _, e3 = _level(codes[0], *own[0], three[np.searchsorted(codes[1], codes[0] & np.uint32(0xFFFFFF))])
        for held, made in zip((*costs, *escapes), (four, three, two, e3, e2), strict=True):
            held.append(made.astype(np.float32))
    beside = lambda held, n: np.stack(held, axis=1) if held else np.zeros((n, 0), np.float32)
    return Model(langs, codes, [beside(h, len(c)) for h, c in zip(costs, codes, strict=True)], contexts, [beside(h, len(c)) for h, c in zip(escapes, contexts, strict=True)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, code of four bytes) of a task's texts; sent on whenever many are held."""

    def sent(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, seen = _summed(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(seen.astype(np.int64))], names=["lang", "code", "seen"])

    held: dict[str, list] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = np.unique(strings(text.encode("utf-8", "surrogatepass")), return_counts=True)
            held.setdefault(lang, []).append(found)
            size += len(found[0])
            if size > HELD:
                yield from sent(held)
                held, size = {}, 0
    yield from sent(held)


#: Counts that a task holds before it sends them on.
HELD = 4_000_000


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Trees from the non-null (lang, text) rows of ``labelled``: from all of them, or beyond ``rows`` from those whose
    text hash falls in a share of about that size. What comes to the driver are the distinct strings of four bytes of
    those texts, which that number bounds."""
    known = labelled.filter("lang is not null and text is not null and text <> ''").select("lang", "text")
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    found = known.mapInArrow(_count, "lang string, code bigint, seen bigint").groupBy("lang", "code").agg(F.sum("seen").alias("seen")).toArrow()
    langs = found.column("lang").combine_chunks().dictionary_encode()
    which = langs.indices.to_numpy(zero_copy_only=False)
    codes, seen = found.column("code").to_numpy().astype(np.uint32), found.column("seen").to_numpy().astype(np.float64)
    return grown({x: (codes[which == k], seen[which == k]) for k, x in enumerate(langs.dictionary.to_pylist())})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row of ``docs``, from its whole text.

    Null texts, and texts without a letter, are ``und`` with score 0. Equal texts get equal values; rows that repeat are
    kept; null ids stay null; an empty table gives no rows. With nothing learned every text is ``und``.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.parts())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Model(*held.value)
        for batch in batches:
            found = [ready.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with lang_pred and lang_score as identify() gives them (replaced if there are such columns)."""
    held = docs.sparkSession.sparkContext.broadcast(model.parts())
    own = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Model(*held.value)
        for batch in batches:
            found = [ready.predict(t) for t in batch.column(0).to_pylist()]
            said = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *said], names=[*own, "lang_pred", "lang_score"])

    rows = docs.select(F.col(text_col).alias("__sl_text"), *own)
    kind = StructType([*(docs.schema[c] for c in own), StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])
    return rows.mapInArrow(run, kind)
