from pyspark.sql import functions as F

import corpus_pipeline as C


def test_stages_on_a_small_corpus(spark, tmp_path):
    def prose(k, n=60):
        return " ".join(f"{'abcdefghij'[(k * 7 + j * j) % 10]}o{'klmnopqrst'[(k + j * 3) % 10]}{k * 131 + j}x" for j in range(n))

    item = prose(500, 20)
    rows = [(k, prose(k), "en", f"s{k % 3}", 1) for k in range(30)]
    rows += [
        (100, "--- 123", "en", "s0", 1),
        (101, None, None, None, None),
        (102, f"{prose(60)}\nCommon line of seven words right here.", "en", "s0", 1),
        (103, f"{prose(61)}\ncommon line of seven words right here", "en", "s0", 1),
        (104, prose(3), "en", "s1", 1),
        (105, " ".join(w if j != 30 else "changed" for j, w in enumerate(prose(70, 120).split())), "en", "s1", 1),
        (106, prose(70, 120), "en", "s1", 1),
        (107, f"lead {item} tail", "en", "s2", 1),
    ]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(C.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    every = {r[0] for r in rows}
    assert set(seen["language_id"]) == every - {100, 101}
    assert set(seen["line_dedup"]) == every - {100, 101, 104} - ({106} & (every - set(seen["line_dedup"])))
    assert "common line" not in seen["line_dedup"][103] and "Common line" in seen["line_dedup"][102]
    assert len({105, 106} & set(seen["near_dedup"])) == 1
    assert set(seen["line_dedup"]) - set(seen["near_dedup"]) <= {105, 106}
    assert set(seen["near_dedup"]) - set(seen["decontamination"]) == {107}
    assert set(seen["mixing_sources"]) <= set(seen["decontamination"]) and seen["mixing_sources"]
    assert C.run(spark, str(tmp_path)).select(F.count("*")).first()[0] == docs.count()


def test_stages_tell_rows_apart(spark, tmp_path):
    text = lambda c: " ".join(f"{c}{j}x" for j in range(60))
    item = " ".join(f"item{j}" for j in range(20))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"a {item} b"), (5, f"c {item} d"), (5, text("e"))]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], schema)
    assert [tuple(r) for r in C.decontamination(spark, docs, str(tmp_path)).select("doc_id", "text").collect()] == [(5, text("e"))]
    rows = [(None, text("a")), (None, text("a")), (None, text("b")), (7, text("b")), (4, text("b")), (7, text("c"))]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], schema)
    out = C.near_dedup(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text[0]) for r in out.collect()) == [(0, "a"), (4, "b"), (7, "c")]


def test_stages_on_odd_and_empty_tables(spark, tmp_path, odd, none):
    spark.createDataFrame([(1, "moon all night long"), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, docs in (("odd", odd), ("none", none), ("null", odd.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in odd.schema)).limit(3))):
        for k, (stage, f) in enumerate(C.STAGES):
            out = f(spark, docs, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{name}-{stage}")
            after = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
            if k < len(C.STAGES) - 1:
                assert after.columns == docs.columns
            assert after.count() <= docs.count() or k == len(C.STAGES) - 1
            docs = after


def test_each_stage_against_brute_force(spark, tmp_path):
    """Every stage on the same generated corpus, each held against a plain version of its own operator's definition."""
    import random

    from tests.llm.test_decontaminate import brute as hits
    from tests.llm.test_lines import brute as lines
    from tests.llm.test_neardup import brute as near

    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.choice((3, 4, 7)))) for _ in range(500)]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    shared, item = [line(n) for n in (6, 9, 14, 30)], line(14)
    rows = []
    for k in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.3 else line(rng.randrange(5, 40)) for _ in range(rng.randrange(1, 5))]
        if k % 10 == 0:
            parts.append(f"{line(4)} {item} {line(3)}")
        rows.append((k, "\n".join(parts)))
    rows += [(100 + k, " ".join(w if rng.random() < 0.985 else "zzz" for w in rows[k][1].split(" "))) for k in range(0, 60, 4)] + [(200, rows[1][1]), (201, "123 --"), (202, None)]
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 2}", 1) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    assert set(texts(C.language_id(spark, docs, str(tmp_path)))) == {d for d, t in rows if t and any(map(str.isalpha, t))}
    cleaned, linked = lines(rows)
    want = {d: cleaned[d] for d, t in rows if cleaned[d] == t or any(map(str.isalnum, cleaned[d] or ""))}
    assert linked and texts(C.line_dedup(spark, docs, str(tmp_path))) == want
    comps = near(dict(rows), 5, 80)
    assert set(texts(C.near_dedup(spark, docs, str(tmp_path)))) == {d for d, (_, c) in comps.items() if d == c} and len({c for _, c in comps.values()}) < len(rows)
    kept = {r[0] for r in hits(rows, [(1, item)]) if not r[2]}
    assert set(texts(C.decontamination(spark, docs, str(tmp_path)))) == kept and len(kept) < len(rows)
    mixed = C.mixing_sources(spark, docs, str(tmp_path)).collect()
    counts = {}
    for r in mixed:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert all(sorted(r.copy_no for r in mixed if r.doc_id == d) == list(range(1, n + 1)) for d, n in counts.items())
