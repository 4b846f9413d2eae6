import random

from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import substrings as S


def brute(texts, n):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for b in raws:
        for k in range(len(b) - n + 1):
            seen[b[k : k + n]] = seen.get(b[k : k + n], 0) + 1
    out = []
    for b in raws:
        mark = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                mark[k : k + n] = b"\1" * n
        out.append((len(b), sum(mark), bytes(x for x, m in zip(b, mark, strict=True) if not m)))
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=12), max_size=8), max_size=9))
def test_loser_tree_sorts_with_prefixes(runs):
    runs = [sorted(r) for r in runs]
    made = []
    for n, r in enumerate(runs):
        shared, rest = S.front_code(r)
        made.append(((k, s, n) for k, s in S.front_decode(shared, [len(x) for x in r], rest)))
    got = list(S.LoserTree(made))
    want = sorted(x for r in runs for x in r)
    assert [s for _, s, _ in got] == want
    last = b""
    for k, s, _ in got:
        assert k == next((i for i, (a, b) in enumerate(zip(last, s, strict=False)) if a != b), min(len(last), len(s)))
        last = s


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=30, max_size=300), st.integers(8, 30))
def test_minimizers_cover_every_string(b, n):
    at, h = S.anchors(b, n, 6)
    ranges = S.starts(at, h, len(b), n, 6)
    covered = sorted(s for lo, hi in ranges for s in range(lo, hi + 1))
    assert covered == list(range(max(0, len(b) - n + 1)))


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 6)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(4)]
    texts = [" ".join(rng.choice([word(), word(), word(), rng.choice(shared)]) for _ in range(rng.randrange(25))) for _ in range(60)]
    texts += [texts[0], texts[0], None, "", "a" * 200, "xy" * 60, shared[0], shared[0][3:], (shared[1] + " ") * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for n in (40, 55):
        rows = S.remove_repeats(df, n, 16, passage=30).collect()
        got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in rows}
        assert [got[k] for k in range(len(texts))] == brute(texts, n)
        assert {r.doc_id: r.n_repeated for r in rows} == {k: x[1] for k, x in enumerate(brute(texts, 30))}


def test_query_against_brute_force(spark, tmp_path):
    """The registered query with its own lengths: passages from 240 bytes are told, those from 400 taken out."""
    import hashlib

    from strandline.llm import queries

    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, short, few = prose(120), prose(52), prose(30)
    texts = [prose(150) for _ in range(10)] + [f"{prose(40)} {p} {prose(20)}" for p in (shared, shared, short, short, few, few, shared)] + [None, "", shared, prose(2000) + shared * 3]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_substrings(spark, str(tmp_path)).collect()}
    for k, ((n, removed, kept), (_, repeated, _)) in enumerate(zip(brute(texts, 400), brute(texts, 240), strict=True)):
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.kept_sha256, r.n_repeated) == (n, removed, hashlib.sha256(kept).hexdigest(), repeated)
    assert got[12].n_removed == 0 < got[12].n_repeated and got[14].n_repeated == 0 == got[0].n_repeated


def test_odd_rows(spark, odd, none):
    got = S.remove_repeats(odd, 40, 16, passage=30).collect()
    assert len(got) == odd.count()
    assert next(r for r in got if r.doc_id == 1).n_removed == next(r for r in got if r.doc_id == 1).n_bytes
    assert S.remove_repeats(none, 40, 16).count() == 0


def test_workers_are_handed_few_rows_at_once(spark, monkeypatch):
    """Python workers hold a bounded number of texts or runs, however many rows a task has."""
    import pyarrow as pa

    seen, put = {}, S.stored

    def stored(df, name, **named):
        seen[name] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return put(df, name, **named)

    monkeypatch.setattr(S, "stored", stored)
    S.repeats(spark.createDataFrame([("ab " * 200,), ("ab " * 200,)], "text string"), (60, 40), 16)
    assert max(seen["anchors"], seen["runs"]) <= 500 and seen["spans"] <= 16
    rows = pa.RecordBatch.from_pylist([{"id": k, "text": "x", "spans": [{"lo": 0, "hi": 1, "length": 40}]} for k in range(1200)])
    got = list(S._cut(40)(iter([rows])))
    assert sum(x.num_rows for x in got) == 1200 and max(x.num_rows for x in got) <= 500
