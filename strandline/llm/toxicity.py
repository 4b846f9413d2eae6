"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

A lexicon of words and word beginnings is weighed from labelled texts and joined to a short seed list; the features are
densities of its three grades, how near its words stand to the second person, capitals, punctuation, and spelling that
hides words. Histogram trees with logistic loss are fitted to the labelled sample, and the pool-adjacent-violators algorithm
maps their sums to probabilities, by sums of each fifth under trees of the others.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import stored

#: Insults that count before anything is learned, and second-person words.
SEED_WORDS = ("idiot", "moron", "scum", "clown", "loser", "worthless", "pathetic", "disgusting", "stupid", "trash")
SECOND_PERSON = ("you", "your", "yours", "u", "ur", "du", "dich", "dir", "dein", "deine", "sie", "ihr", "tu", "te", "toi", "ton", "ta", "vous", "votre", "usted", "tú", "ti")
#: Digits and signs that stand for letters.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})
#: Documented bounds: labelled rows that anything is learned from, which bounds the lexicon too, and the fewest texts that
#: must hold an entry.
TRAIN_ROWS, SUPPORT = 8_000, 5
HEAD, STEMS = 3, (3, 4, 5, 6)
NEAR = 5  # words
GRADES = (0.85, 0.6, 0.35)  # shares of toxic texts from which a learned entry counts as grade 0, 1, 2

WORD = re.compile(r"[^\W_]+(?:[*@$!'0-9][^\W_]+)*")
FEATURES = ("grade0 density", "grade0 count", "grade0 kinds", "grade1 density", "grade1 kinds", "grade2 density", "seed density", "near second person", "capitals", "shouted words", "punctuation", "exclamation", "hidden spelling", "hidden seeds", "log words")


def units(text: str) -> set[str]:
    """Whole words, and their beginnings marked with a star."""
    kinds = set(WORD.findall(text.lower()))
    return kinds | {w[:k] + "*" for w in kinds for k in STEMS if len(w) > k}


class Lexicon:
    """Entries with a grade; a word takes the best grade among itself and its beginnings."""

    def __init__(self, grades: dict[str, int]):
        self.grades = grades
        self.heads = {x.rstrip("*")[:HEAD] for x in grades}

    def grade(self, word: str) -> int | None:
        if word[:HEAD] not in self.heads:
            return None
        found = [g for x in (word, *(word[:k] + "*" for k in STEMS if len(word) > k)) if (g := self.grades.get(x)) is not None]
        return min(found, default=None)


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of a text, all of it; a null or empty text is all zeros."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lower = [w.lower() for w in words]
    count, kinds, places, seeds = [0, 0, 0], [set(), set(), set()], [], 0
    heads = lexicon.heads
    grade_of: dict[str, int | None] = {}
    for at, w in enumerate(lower):
        if w[:HEAD] in heads:
            g = grade_of[w] if w in grade_of else grade_of.setdefault(w, lexicon.grade(w))
            if g is not None:
                count[g] += 1
                kinds[g].add(w)
                seeds += w in SEED_WORDS
                if g == 0:
                    places.append(at)
    near = 0
    if places:
        second = [at for at, w in enumerate(lower) if w in SECOND_PERSON]
        for p in places:
            i = bisect_left(second, p - NEAR)
            near += i < len(second) and second[i] <= p + NEAR
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    shouted = sum(len(w) > 2 and w.isupper() for w in words)
    marks = sum(text.count(x) for x in ".,;:?!-\"'()")
    hidden = [w for w in lower if not w.isalnum() or not (w.isalpha() or w.isdigit())]
    revealed = sum(w.translate(LOOKALIKE) in SEED_WORDS for w in hidden)
    return [
        count[0] / n, count[0], len(kinds[0]), count[1] / n, len(kinds[1]), count[2] / n, seeds / n,
        near / n, capitals / len(text), shouted / n, marks / len(text), text.count("!") / len(text),
        len(hidden) / n, revealed / n, float(np.log1p(n)),
    ]


class Trees:
    """Histogram gradient-boosted trees with logistic loss; each tree is complete, of ``depth`` levels."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], axis=1)
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        total = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-total))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), int)
            column, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first = 2**level - 1
                best = np.zeros(2**level)
                split = np.full(2**level, -1)
                for j, q in enumerate(cuts):
                    if not len(q):
                        continue
                    at = (node - first) * self.bins + binned[:, j]
                    left = [np.cumsum(np.bincount(at, v, 2**level * self.bins).reshape(-1, self.bins), axis=1) for v in (g, h)]
                    (gl, hl), (gt, ht) = left, [v[:, -1:] for v in left]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hl < self.least) | (ht - hl < self.least)] = 0
                    gain = gain[:, : len(q)]
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(len(k)), k] > best + 1e-9
                    best[better] = gain[np.arange(len(k)), k][better]
                    split[better] = k[better]
                    column[first : first + 2**level][better] = j
                    cut[first : first + 2**level][better] = q[k[better]]
                node = 2 * node + 1 + (x[np.arange(len(y)), column[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            gs, hs = (np.bincount(leaf, v, 2**self.depth) for v in (g, h))
            value = -self.rate * gs / (hs + self.l2)
            total += value[leaf]
            self.trees.append((column, cut, value))
        return self

    def decide(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for column, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), column[node]] > cut[node])
            total += value[node - (2**self.depth - 1)]
        return total


class Isotonic:
    """A rising map of scores to probabilities by pooling adjacent violators, linear between its knots."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        pools: list[list[float]] = []  # sum of labels, number, sum of scores
        for s, label in zip(score[order], y[order], strict=True):
            pools.append([float(label), 1.0, float(s)])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.x = np.array([c / n for _, n, c in pools]) if pools else np.zeros(1)
        # a pool of few rows is drawn towards the middle, as (k + 0.5) / (n + 1)
        self.y = np.maximum.accumulate([(k + 0.5) / (n + 1) for k, n, _ in pools]) if pools else np.full(1, 0.5)
        return self

    def map(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.x, self.y), 0.0, 1.0)


class Model:
    def __init__(self, lexicon: Lexicon, trees: Trees, calibration: Isotonic):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([features(t, self.lexicon) for t in texts], float)
        return self.calibration.map(self.trees.decide(x))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each entry the number of toxic texts of a task that hold it."""
    toxic = Counter()
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if y:
                toxic.update(units(text))
    yield pa.RecordBatch.from_arrays([pa.array(list(toxic), pa.string()), pa.array(list(toxic.values()), pa.int64())], names=["unit", "toxic"])


def _held(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = wanted.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(units(text) & names)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["unit", "held"])

    return run


def learn_lexicon(labelled: DataFrame, support: int = SUPPORT) -> Lexicon:
    """Grades from (text, toxic) rows: all entries held by at least ``support`` toxic texts, by the lower bound (one standard
    error) of their share of toxic texts. Two passes, so that only what toxic texts hold is shuffled; the rows are the
    bounded sample, and so are the entries."""
    rows = labelled.select("text", "toxic")
    marked = rows.mapInArrow(_units, "unit string, toxic bigint").groupBy("unit").agg(F.sum("toxic").alias("toxic")).filter(F.col("toxic") >= support)
    marked = marked.toArrow()
    toxic = dict(zip(marked.column("unit").to_pylist(), marked.column("toxic").to_pylist(), strict=True))
    grades = {}
    if toxic:
        wanted = labelled.sparkSession.sparkContext.broadcast(frozenset(toxic))
        held = rows.mapInArrow(_held(wanted), "unit string, held bigint").groupBy("unit").agg(F.sum("held").alias("held")).toArrow()
        for unit, n in zip(held.column("unit").to_pylist(), held.column("held").to_pylist(), strict=True):
            p = (toxic[unit] + 0.5) / (n + 1.5)
            bound = p - (p * (1 - p) / n) ** 0.5
            grade = next((i for i, least in enumerate(GRADES) if bound >= least), None)
            if grade is not None:
                grades[unit] = grade
    return Lexicon(grades | dict.fromkeys(SEED_WORDS, 0))


def _features_of(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [Lexicon(x) for x in held.value]
        for batch in batches:
            parts = batch.column(2).to_pylist()
            x = [features(t, lexicons[p % 2]) for t, p in zip(batch.column(0).to_pylist(), parts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "part", "x"])

    return run


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from rows (text, toxic) with a non-null label: all, or beyond ``rows`` those whose text hash falls in a
    share of about that size. The features that the trees see come from a lexicon of the other half, so that no text is
    graded by entries that its own label made; the lexicon that is kept comes from both halves. The calibration is fitted to
    scores of each fifth by trees of the other four, so that all rows serve it; the trees that are kept are of all rows."""
    known = labelled.filter("toxic is not null").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    known = stored(known.withColumn("part", F.pmod(F.xxhash64("text", F.lit(7)), F.lit(10)).cast("int")), "toxicity")
    others = [learn_lexicon(known.filter(F.col("part") % 2 == half)).grades for half in (1, 0)]
    held = labelled.sparkSession.sparkContext.broadcast(others)
    found = known.select("text", "toxic", "part").mapInArrow(_features_of(held), "toxic int, part int, x array<double>").toArrow()
    y, part = (np.array(found.column(c).to_pylist(), float) for c in ("toxic", "part"))
    x = np.array(found.column("x").to_pylist(), float).reshape(len(y), len(FEATURES))
    apart = np.zeros(len(y))
    for fifth in range(5):
        own = part // 2 == fifth
        if own.any():
            apart[own] = Trees().fit(x[~own], y[~own]).decide(x[own])
    return Model(learn_lexicon(known), Trees().fit(x, y), Isotonic().fit(apart, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row, from its whole text; score is 0 to 1, higher for texts likelier to be labelled toxic.

    Null and empty texts are scored as texts without words. Equal texts get equal scores; repeated rows are kept, null
    ids stay null, an empty table gives no rows, and other columns are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.lexicon.grades, model.trees, model.calibration))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades, trees, calibration = held.value
        ready = Model(Lexicon(grades), trees, calibration)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ready.score(batch.column(1).to_pylist()), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
