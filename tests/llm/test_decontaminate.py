import hashlib
import random
import re

from pyspark.sql import functions as F

from strandline.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(t):
    return WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items, n=10):
    wins = []
    for i, t in items:
        w = cut(t)
        if w:
            wins += [(str(i), tuple(w[s : s + n])) for s in range(max(1, len(w) - n + 1))]
    out = []
    for d, t in docs:
        w = cut(t)
        hit, ids = set(), set()
        for i, p in wins:
            for s in range(len(w) - len(p) + 1):
                if tuple(w[s : s + len(p)]) == p:
                    hit |= set(range(s, s + len(p)))
                    ids.add(i)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocab = ["the", "of", "Ab", "cé", "x1", "zz", "qq"]
    items = [(k, " ".join(rng.choices(vocab, k=n))) for k, n in enumerate((14, 10, 3, 1, 0, 25))] + [(9, None), (10, "zz  QQ, zz")]
    docs = [(k, " ".join(rng.choices(vocab, k=rng.randrange(40)))) for k in range(30)] + [(50, f"lead {items[0][1]} tail {items[5][1]}"), (51, None), (52, ""), (53, items[1][1]), (53, items[1][1])]
    got = D.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_odd_rows_and_empty(spark, odd, none):
    items = spark.createDataFrame([(1, "cat sat on the mat"), (None, "second line")], "item_id bigint, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in D.scan(odd, items).collect()}
    assert (1, 18, 7, 1) in got and (4, 18, 7, 1) in got and (2, 0, 0, 0) in got
    assert D.scan(odd, items).count() == odd.count()
    assert D.scan(none, items).count() == 0
    assert D.scan(odd, items.limit(0)).filter("contaminated").count() == 0


def test_near_holds_exact(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "b a c d e"), (3, "a x y z e")], "doc_id bigint, text string")
    index = D.build(docs, D.phrases(spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")))
    assert {r.doc for r in D.match(index).collect()} == {1}
    assert {r.doc for r in D.near(index, 2).collect()} == {1, 2}


def test_query_against_sql(spark):
    import duckdb

    from strandline.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(D.scan_sql())
    names = [c[0] for c in want.description]
    got = queries.op1_decontaminate(spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(names).collect()))) == sorted(map(str, want.fetchall()))


def test_near_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choices(vocab, k=n))) for k, n in enumerate((4, 4, 12, 2, 1))]
    docs = [(k, " ".join(rng.choices(vocab, k=60))) for k in range(25)] + [(90, " ".join(reversed(items[0][1].split()))), (91, "w0 " * 500)]
    seen = {}
    for _, t in docs:
        for w in cut(t):
            seen[w] = seen.get(w, 0) + 1
    want = {}
    for d, t in docs:
        w, ids = cut(t), set()
        for i, text in items:
            v = cut(text)
            for s in range(max(1, len(v) - 9)):
                p = v[s : s + 10]
                if any(x not in seen for x in p):
                    continue
                off = min(range(len(p)), key=lambda o: (seen[p[o]], p[o], o))
                for at in (k - off for k, x in enumerate(w) if x == p[off]):
                    if all(x in w[max(0, at + o - 2) : max(0, at + o + 3)] for o, x in enumerate(p) if o != off):
                        ids.add(i)
        want[d] = len(ids)
    got = D.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), slack=2)
    assert {r.doc_id: r.n_near for r in got.collect()} == want and len(set(want.values())) > 2
