import random
import re

import numpy as np

from strandline.llm import neardup as N


def sets(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, percent):
    ids = sorted(rows)
    s = {i: sets(rows[i], width) for i in ids}
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s[i]), top(i)) for i in ids}


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, k = {}, 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 30, 120]))]
        for _ in range(rng.randrange(1, 9)):
            copy = [word() if rng.random() < rng.choice([0, 0.01, 0.04]) else w for w in base]
            rows[k] = " ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy)
            k += 1
    base = [word() for _ in range(200)]  # one large group
    for _ in range(150):
        rows[k] = " ".join(word() if rng.random() < 0.02 else w for w in base)
        k += 1
    base = [word() for _ in range(160)]  # variants that are linked with the middle, and others that are not
    for j in range(140):
        rows[k] = " ".join(word() if j and rng.random() < j / 1400 else w for w in base)
        k += 1
    rows |= {k: None, k + 1: "", k + 2: " \t\n", k + 3: "A b\x0bc", k + 4: "a\x0cB C"}
    return rows


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 100, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert len(N.sketch(x)) == N.T and (N.sketch(x) == N.sketch(x[::-1].copy())).all()
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    assert abs((N.sketch(a) == N.sketch(b)).mean() - 900 / 1100) < 0.15


def test_words_of_any_length():
    long = "x" * 10000
    assert (N.word_hashes(f"{long} ab {long}") == N.word_hashes(f"{long}\tAB\n{long}")).all()
    assert len(set(N.word_hashes("a b ab ba aa").tolist())) == 5


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").repartition(3)
    for width, percent in ((4, 80), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, width, percent).collect()}
        assert got == brute(rows, width, percent)


def test_overlaps_are_exact():
    rng = np.random.default_rng(1)
    xs, ys = ([np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (1, 0, 50, 200)] for _ in "ab")
    assert (N.overlaps(xs, ys) == [[len(np.intersect1d(x, y)) for y in ys] for x in xs]).all()


def test_odd_rows(spark, odd, none):
    got = N.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[4].component_id == 1 and not by[4].kept and by[1].kept and by[3].kept and by[None].kept
    assert N.near_duplicates(none).count() == 0


def test_a_long_word_changes_its_own_shingles_alone(spark):
    words = [f"w{k}x" for k in range(300)]
    plain, blob = " ".join(words), " ".join([*words[:150], "y" * 5000, *words[150:]])
    a, b = (set(N.shingles(t, 4).tolist()) for t in (plain, blob))
    assert len(a & b) == 294
    rows = spark.createDataFrame([(1, plain), (2, blob)], "doc_id bigint, text string")
    assert {r.component_id for r in N.near_duplicates(rows, 4).collect()} == {1}


def test_shared_ids_have_the_sets_of_all_rows(spark):
    texts = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcde"]
    near = [t.replace("30", "x") for t in texts]
    rows = [(9, texts[0]), (9, texts[1]), (9, ""), (1, near[0]), (2, near[1]), (3, texts[2]), (8, texts[2]), (8, texts[3]), (7, near[3]), (6, texts[4])]
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 4).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert by == {9: {(1, False)}, 1: {(1, True)}, 2: {(1, False)}, 3: {(3, True)}, 8: {(3, False)}, 7: {(3, False)}, 6: {(6, True)}}
