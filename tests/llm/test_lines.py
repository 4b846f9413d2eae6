import random

from pyspark.sql import functions as F

from strandline.llm import lines as L


def simhash(words):
    import xxhash

    hs = [(xxhash.xxh64(w.encode(), seed=42).intdigest(), min(len(w), 16) ** 2) for w in set(words) if len(w) >= 4]
    return None if not hs else sum(1 << b for b in range(64) if 2 * sum((h >> b & 1) * q for h, q in hs) > sum(q for _, q in hs))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def one_block(a, b):
    """Whether two lines agree on all blocks of words but one, blocks of the longer, or of lines of a word more."""
    n, m = max(len(a), len(b)), min(len(a), len(b))
    for size in {n, n + 1} if n == m else {n} if n == m + 1 else ():
        allowed = int(0.2 * size + 1e-9)
        blocks = -(-size // allowed) if allowed else 0
        for i in range(blocks):
            before, after = i * size // blocks, size - (i + 1) * size // blocks
            if a[:before] == b[:before] and a[len(a) - after :] == b[len(b) - after :]:
                return True
    return False


def brute(rows, alone=False):
    """Cleaned texts, by all pairs of distinct lines, and how many pairs are linked; ``alone``: by edit similarity alone."""
    places, linked = {}, 0
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            w = tuple(line.lower().replace(".", " ").split())
            if w:
                places.setdefault(w, set()).add((d, k))
    keys, up = list(places), {}
    hashes = {k: simhash(k) for k in keys}
    top = lambda x: top(up[x]) if x in up else x
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (alone or None not in (hashes[a], hashes[b]) and (hashes[a] ^ hashes[b]).bit_count() <= 3 or one_block(a, b)) and edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
                linked += 1
                if top(a) != top(b):
                    up[top(a)] = top(b)
    groups = {}
    for k in keys:
        groups.setdefault(top(k), set()).update(places[k])
    drop = {p for g in groups.values() for p in g - {min(g)}}
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in drop) for d, t in rows}, linked


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.choice((3, 4, 7)))) for _ in range(400)]
    base = [rng.choices(vocab, k=rng.choice([3, 12, 60, 300])) for _ in range(25)]

    def line():
        w = list(rng.choice(base))
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = rng.choice(vocab)
        return " ".join(w) + rng.choice(["", ".", " ."])

    rows = [(d, "\n".join(line() if rng.random() < 0.9 else "" for _ in range(rng.randrange(8)))) for d in range(60)] + [(99, None)]
    want, fuzzy = brute(rows)
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert fuzzy and got == want


def test_masks_are_pigeonholes():
    for n in (1, 10**6, 10**9, 10**11):
        masks = L.masks(n)
        for bits in ((0, 1, 2), (0, 31, 63), (13, 26, 50)):
            assert any(not any(m >> b & 1 for b in bits) for m in masks)
        assert min(m.bit_count() for m in masks) >= min(n.bit_length(), 40)


def test_odd_rows(spark, odd, none):
    got = L.dedup_lines(odd)
    assert got.columns[: len(odd.columns)] == odd.columns and got.count() == odd.count()
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].n_dropped == 0 and by[4].text == "" and by[4].n_dropped == 2
    assert by[2].text is None and by[6].text == "%%% --- ..."
    assert L.dedup_lines(none).count() == 0
    hashed = L.simhashes(spark.createDataFrame([(1, " ".join(["abcd"] * 300 + ["bcde", "cdefg"] * 299 + ["x"] * 50))], "node bigint, line string")).first().sig
    assert hashed & (2**64 - 1) == simhash(["abcd", "bcde", "cdefg", "x"])


def edited(rng, vocab, sizes):
    """Lines of the given numbers of words, and copies of each with up to one edit more than is allowed."""
    lines = []
    for n in sizes:
        base = rng.choices(vocab, k=n)
        lines.append(base)
        for made in range(1, n // 5 + 2):
            w = list(base)
            for _ in range(made):
                at, kind = rng.randrange(len(w)), rng.random()
                w[at : at + (kind < 0.7)] = [rng.choice(vocab)] * (kind < 0.5 or kind >= 0.7)
            lines.append(w)
    return [(d, " ".join(w)) for d, w in enumerate(lines)]


def test_edits_of_all_lengths(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.choice((3, 4, 7)))) for _ in range(300)]
    rows = edited(rng, vocab, (4, 5, 6, 9, 10, 14, 20, 33, 60, 120) * 3)
    want, linked = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert linked > 30 and {r.doc_id: r.text for r in L.dedup_lines(docs).collect()} == want


def test_lines_one_edit_apart_are_all_found(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.choice((3, 4, 7)))) for _ in range(300)]
    rows = []
    for n in range(5, 60, 3):
        base = rng.choices(vocab, k=n)
        at = rng.randrange(n)
        rows += [base, base[:at] + base[at + 1 :], base[:at] + ["new"] + base[at:], base[:at] + ["other"] + base[at + 1 :]]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in L.dedup_lines(docs).collect()}
    assert [d for d, t in got.items() if t] == list(range(0, len(rows), 4))


def test_words_that_share_a_code(spark):
    """Of 150,000 words several share each of 20,000 codes; two lines of words that differ but share all codes are no copies."""
    from collections import defaultdict

    df = spark.range(60_000).select(F.concat(F.lit("w"), "id").alias("w"))
    kinds = defaultdict(list)
    for r in df.select("w", L._codes(F.col("w")).alias("c")).collect():
        kinds[r.c].append(r.w)
    twins = [x[:2] for x in kinds.values() if len(x) > 1][:10]
    a, b = ([x[i] for x in twins] for i in (0, 1))
    texts = spark.createDataFrame([(n, " ".join(x)) for n, x in ((1, a), (2, b), (3, [*a[:9], "new"]))], "node bigint, line string").withColumn("coded", L._codes(F.col("line")))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a bigint, b bigint")
    assert [tuple(r) for r in L._verifier(texts, 0.8)(pairs).collect()] == [(1, 3)]


def test_large_buckets_are_cut(spark, monkeypatch):
    """Lines of the same words in other orders share all bits and are no links, save those that differ in few places."""
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.choice((3, 4, 7)))) for _ in range(30)]
    rows = []
    for _ in range(40):
        w = list(vocab)
        rng.shuffle(w)
        rows += [w, [w[1], w[0], *w[2:28], w[29], w[28]]]
    rows = [(d, " ".join(w)) for d, w in enumerate(rows)]
    monkeypatch.setattr(L, "HOT_NODES", 8)
    want, linked = brute(rows)
    assert linked == 40 and {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == want


def test_near_hashes_meet_in_one_bucket(spark):
    """Hashes of at most three different bits share many buckets of bits, and are one pair of one of them."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    sigs = {base ^ sum(1 << b for b in rng.sample(range(64), rng.choice((0, 1, 2)))) for _ in range(60)}
    rows = spark.createDataFrame([(k, L._signed(s)) for k, s in enumerate(sorted(sigs))], "node bigint, sig bigint")
    close = {(i, j) for i, x in enumerate(sorted(sigs)) for j, y in enumerate(sorted(sigs)) if i < j and (x ^ y).bit_count() <= L.K}
    for lines in (len(sigs), L.FINE):
        keyed = L.bit_keys(rows, lines)
        other = keyed.select("key", F.col("node").alias("b"), F.col("sig").alias("b_sig"))
        near = keyed.join(other, "key").filter("node < b").filter(F.bit_count(F.col("sig").bitwiseXOR(F.col("b_sig"))) <= L.K)
        got = [tuple(r) for r in near.filter(F.col("key") == L.first_key(F.col("sig"), F.col("b_sig"), lines)).select("node", "b").collect()]
        assert near.count() > len(close)
        assert len(got) == len(close) and set(got) == close


def test_keys_of_bits_stay_small_in_plans(spark):
    """The driver plans and compiles what a query says: hundreds of masks are one constant there, not an expression each."""
    sigs = spark.createDataFrame([(1, 5)], "node bigint, sig bigint")
    keyed = L.bit_keys(sigs, L.FINE)
    other = keyed.select("key", F.col("node").alias("b"), F.col("sig").alias("b_sig"))
    met = keyed.join(other, "key").filter(F.col("key") == L.first_key(F.col("sig"), F.col("b_sig"), L.FINE))
    assert len(L.masks(L.FINE)) > 100
    for df in (keyed, met):
        assert len(df._jdf.queryExecution().optimizedPlan().toJSON()) < 50_000


def shuffled(rng, lines, words=30):
    vocab = ["".join(rng.choices("abcdefghij", k=rng.choice((3, 4, 7)))) for _ in range(words)]
    rows = []
    for _ in range(lines):
        w = list(vocab)
        rng.shuffle(w)
        rows += [w, [w[1], w[0], *w[2:28], w[29], w[28]]]
    return [(d, " ".join(w)) for d, w in enumerate(rows)]


def test_large_buckets_are_not_dealt_by_bits_again(spark, monkeypatch):
    """Lines of large left-over buckets meet by a few runs of words, not by every choice of blocks of bits."""
    asked, made = [], L.bit_keys
    monkeypatch.setattr(L, "bit_keys", lambda sigs, lines, k=L.K: asked.append(lines) or made(sigs, lines, k))
    monkeypatch.setattr(L, "HOT_NODES", 8)
    rows = shuffled(random.Random(4), 20)
    want, linked = brute(rows)
    assert linked and {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == want
    assert asked and max(asked) == len(rows)


def test_linked_lines_share_a_run(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.choice((3, 4, 7)))) for _ in range(40)]
    rows = [(d, t.split()) for d, t in edited(rng, vocab, (8, 9, 10, 14, 20, 33, 60) * 4)]
    df = spark.createDataFrame([(d, len(w), " ".join(w)) for d, w in rows], "node bigint, m int, line string")
    for similarity in (0.8, 0.4):
        q = L.run_length(similarity)
        keys = {}
        for r in L.run_keys(df, similarity, q).collect():
            keys.setdefault(r.node, set()).add(r.key)
        linked = [(a, b) for a, v in rows for b, w in rows if a < b and edits(v, w) <= int((1 - similarity) * max(len(v), len(w)) + 1e-9)]
        assert len(linked) > 30 and all(keys[a] & keys[b] for a, b in linked)
        assert all(len(keys[a]) <= q * int((1 - similarity) / similarity * len(w) + 1e-6) + 1 for a, w in rows)
    assert L.run_length(0.8) == 2 and L.run_length(0.4) == 1 and L.run_length(0) == 0


def test_lines_that_share_a_word_key_share_a_half(spark):
    """There are fewer keys of halves, so they are asked first."""
    rng = random.Random(7)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.choice((3, 4, 7)))) for _ in range(300)]
    rows = edited(rng, vocab, (4, 5, 6, 9, 10, 14, 20, 33, 60, 120) * 3)
    df = spark.createDataFrame([(d, len(t.split()), t) for d, t in rows], "node bigint, m int, line string")

    def pairs(keyed):
        by = {}
        for r in keyed.collect():
            by.setdefault(r.key, set()).add(r.node)
        return sum(map(len, by.values())), {(a, b) for x in by.values() for a in x for b in x if a < b}

    n, halves = pairs(L.half_keys(df))
    most, want = pairs(L.word_keys(df))
    assert len(want) > 20 and want <= halves and n < most / 3


def test_hashes_of_short_and_long_lines(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(L, "SHORT", 200, raising=False)
    rows = [(n, " ".join("".join(rng.choices("abcdefghij", k=rng.choice((3, 4, 7, 20)))) for _ in range(n))) for n in (1, 2, 5, 9, 30, 200, 2000)]
    rows.append((99, "one word as long as two " + "x" * 300))
    got = {r.node: r.sig & (2**64 - 1) for r in L.simhashes(spark.createDataFrame(rows, "node bigint, line string")).collect()}
    assert got == {n: h for n, t in rows if (h := simhash(t.split())) is not None}


def test_hashing_stays_below_what_java_compiles(spark):
    """HotSpot leaves methods of 8,000 bytes and more to its interpreter."""
    lines = spark.createDataFrame([(1, "some words")], "node bigint, line string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    made = L.simhashes(lines.limit(1))._jdf.queryExecution().debug().codegenToSeq()
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())]
    assert sum(x >= 8_000 for x in sizes) <= 1  # lines of more than SHORT letters
