from strandline.operators import kernels as K
from strandline.plans.example import ENDPOINTS, PROGRAM


def code(text):
    return [K.parse(x.strip(), 0x1000 + 4 * k, 4) for k, x in enumerate(text.strip().splitlines())]


SERVE = """lea rdi,[rbp-0x40]
call 2000 <fread@plt>
lea rsi,[rbp-0x40]
call 2010 <send@plt>"""


def test_same_function_hit_and_twins():
    assert K.same_function(code(SERVE)) == ["rbp-64"]
    assert K.same_function(code(SERVE.replace("rsi,[rbp-0x40]", "rsi,[rbp-0x80]"))) == []
    # output before the read in the text (loop layout)
    a, b, c, d = SERVE.splitlines()
    assert K.same_function(code("\n".join([c, d, a, b]))) == ["rbp-64"]
    # through a copy
    copied = f"{a}\n{b}\nlea rdi,[rbp-0x90]\nlea rsi,[rbp-0x40]\ncall 1 <memcpy@plt>\nlea rsi,[rbp-0x90]\n{d}"
    assert K.same_function(code(copied)) == ["rbp-144"]


def test_channel_two_is_local():
    text = SERVE.replace("call 2010 <send@plt>", "mov edi,0x2\ncall 2010 <write@plt>")
    assert K.same_function(code(text)) == []
    assert K.same_function(code(text.replace("0x2\n", "0x5\n"))) == ["rbp-64"]
    opened = "call 1 <open@plt>\nmov DWORD PTR [rbp-0x8],eax\n" + SERVE.replace("call 2010 <send@plt>", "mov edi,DWORD PTR [rbp-0x8]\ncall 2010 <write@plt>")
    assert K.same_function(code(opened)) == []


def test_open_direction():
    assert K.open_direction(code("mov esi,0x0\ncall 1 <open@plt>"), 1) == "read"
    assert K.open_direction(code("mov esi,0x41\ncall 1 <open@plt>"), 1) == "write"
    assert K.open_direction(code("mov edx,0x1a4\ncall 1 <open@plt>"), 1) == "write"
    assert K.open_direction(code("call 1 <creat@plt>"), 0) == "write"
    assert K.open_direction(code("mov esi,0x241\ncall 1 <fopen@plt>"), 1) == "read"


def test_descriptor_flow():
    text = "mov esi,0x0\ncall 1 <open@plt>\nmov DWORD PTR [rbp-0x4],eax\nmov edi,DWORD PTR [rbp-0x4]\ncall 2 <relay>"
    assert K.passes_descriptor(code(text), frozenset(), frozenset(["relay"])) == ["relay"]
    assert K.passes_descriptor(code(text.replace("0x0", "0x41")), frozenset(), frozenset(["relay"])) == []
    assert K.passes_descriptor(code("call 1 <my_open>\nmov edi,eax\ncall 2 <relay>"), frozenset(["my_open"]), frozenset(["relay"])) == ["relay"]


def test_registrar_and_resolver():
    store = "mov rax,QWORD PTR [rip+0x100]\nmov DWORD PTR [rax+0x8],edi"
    (n, g, off), = K.registrar(code(store))
    assert (n, off, g) == (0, 8, 0x1000 + 4 + 0x100)
    fetch = "mov rcx,QWORD PTR [rip+0x100]\nmov eax,DWORD PTR [rcx+0x8]\nret"
    assert K.resolver(code(fetch)) == [(g, 8)]
    assert K.resolver(code("mov rcx,QWORD PTR [rip+0x100]\nmov eax,DWORD PTR [rbp-0x8]")) == []
    assert K.drains(code("call 1 <lookup>\nmov edi,eax\ncall 2 <read@plt>"), frozenset(["lookup"])) == ["read"]
    assert K.feeds(code("mov esi,0x0\ncall 1 <open@plt>\nmov esi,eax\ncall 2 <put>"), frozenset(), {"put": 1}) == ["put"]


def test_offsets_touches_paths_chars():
    assert K.mount_offsets(code("mov esi,DWORD PTR [rbx+0x18]\ncall 1 <sendfile@plt>")) == [24]
    assert K.stores_at(code("mov DWORD PTR [rbx+0x18],eax\nmov DWORD PTR [rbp+0x18],eax"), frozenset([24])) == [24]
    assert K.touches(code("lea rdi,[rbx+0x20]\ncall 1 <memcpy@plt>\nlea rdi,[rbx+0x20]"), frozenset([32]), frozenset(["memcpy"])) == 1
    assert K.send_offsets(code("lea rsi,[rbx+0x20]\ncall 1 <send@plt>")) == [32]
    assert K.path_provenance(code("lea rdi,[rip+0x10]\ncall 1 <open@plt>"))["const"] == 1
    assert K.path_provenance(code("call 1 <open@plt>"))["param"] == 1
    assert K.path_provenance(code("lea rdi,[rbp-0x10]\ncall 1 <fopen@plt>"))["computed"] == 1
    assert K.char_loop(code("call 1 <getc@plt>\nmov edi,eax\ncall 2 <putc@plt>")) == ["putc"]


def test_condition_budget_counts_repeats():
    loop = {"a": ["b", "b"], "b": ["a"], "z": []}
    assert not K.condition_budget(loop, "a", frozenset(["z"]), 80)
    assert K.condition_budget({"a": ["z"]}, "a", frozenset(["z"]))


def test_c_functions():
    text = 'int x; // f(){}\nstatic int add(int a)\n{ char *s = "}"; if (a) { return a; } return 0; }\nstruct p { int q; };\nvoid two(void){}\n'
    assert [(n, a, b) for n, a, b, _ in K.c_functions(text)] == [("add", 3, 3), ("two", 5, 5)]


def test_run_kernels(spark):
    rows = [("p", "f", k, 0, 4, t) for k, t in enumerate(SERVE.splitlines())] + [("p", ".plt", 0, 0, 4, "call 1 <send@plt>"), ("p", "g", 0, None, None, None)]
    df = spark.createDataFrame(rows, "target_id string, function string, seq bigint, pc bigint, size int, instruction string")
    got = K.run_kernels(df, ("samefunc",)).collect()
    assert [(r.function, r.tag, r.evidence) for r in got] == [("f", "samefunc", "rbp-64")]


def test_gbt_query_is_the_whole_job(spark, monkeypatch):
    from pyspark.sql import functions as F

    from strandline.functions import dimensions
    from strandline.plans import kernels as plans

    asked = {}

    def scored(df, order, fold, **how):
        asked.update(order=order, folds=df.select(fold).distinct().count(), how=how)
        return df.withColumn("score", F.lit(0.0))

    monkeypatch.setattr(plans.boost, "out_of_fold", scored)
    plans.gbt_train_score(spark, "/root/testdata/sf0.001").collect()
    assert len(asked["order"]) == len(dimensions.NAME_KEYWORDS) + 4 == 34 and asked["folds"] == 5 and not asked["how"]


def test_program_kernels(spark):
    rows = [("p", f, k, 8 * k, 8, t) for f, text in PROGRAM.items() for k, t in enumerate(text.splitlines())]
    rows += [("q", f, k, 8 * k, 8, t) for f in ("serve", "queue") for k, t in enumerate(PROGRAM[f].splitlines())]
    df = spark.createDataFrame(rows, "target_id string, function string, seq bigint, pc bigint, size int, instruction string")
    got = {(r.target_id, r.function, r.tag) for r in K.run_kernels(df).collect()}
    for want in (("serve", "fd_arg"), ("feeder", "fd_table"), ("drainer", "fd_table"), ("queue", "fd_queue"), ("append", "mount_writer"), ("filler", "crossbuf"), ("filler", "writes_send_buffer"), ("copier", "writes_send_buffer")):
        assert ("p", *want) in got
    fds = {(t, f, tag) for t, f, tag in got if tag in ("fd_arg", "fd_table", "fd_queue")}
    assert fds == {("p", f, tag) for f, tag in ENDPOINTS.items() if tag.startswith("fd_")}
    assert ("p", "copier", "crossbuf") not in got


def test_taint_query_against_plain_calls(spark):
    """Every row of the query, by calling the kernels on each function of the carrier one after another."""
    from strandline.plans import kernels as plans

    sf = "/root/testdata/sf0.001"
    rows = plans._program(spark, sf).toPandas().sort_values(["target_id", "function", "seq"], kind="stable")
    codes = {k: [K.parse(t or "", int(p), int(z)) for t, p, z in zip(g.instruction, g.pc, g["size"], strict=True)] for k, g in rows.groupby(["target_id", "function"])}
    want = [(t, f, name, str(x)) for (t, f), c in codes.items() for name, kernel in K.KERNELS.items() for x in kernel(c)]
    for target in {t for t, _ in codes}:
        own = {f: c for (t, f), c in codes.items() if t == target}
        about = K.summary({f: K.facts(c) for f, c in own.items()})
        want += [(target, f, tag, str(x)) for f, c in own.items() for kernel in K.PROGRAM_KERNELS.values() for tag, xs in kernel(f, c, about) for x in xs]
    got = [tuple(r) for r in plans.taint_kernels(spark, sf).collect()]
    assert len(got) > 10 and sorted(got) == sorted(want)


def test_histogram_trees_learn_and_repeat():
    import numpy as np

    from strandline.operators.boost import Trees

    rng = np.random.default_rng(0)
    x = rng.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    one, two = (Trees(rounds=120, depth=3, step=0.2).fit(x[:600], y[:600]).probability(x[600:]) for _ in "ab")
    assert (one == two).all() and ((one > 0.5) == y[600:]).mean() > 0.93
    assert (Trees(rounds=3).fit(np.zeros((5, 2)), np.array([0.0, 1, 0, 1, 1])).probability(np.zeros((2, 2))) > 0.4).all()


def test_out_of_fold_scores(spark):
    """A row's score does not depend on its own label; a fold whose rest has one label is scored 0."""
    from pyspark.sql import functions as F

    from strandline.operators import boost

    rows = spark.range(200).select("id", (F.col("id") % 4).cast("int").alias("fold"), (F.col("id") * 37 % 101).alias("a"), F.lit(1.0).alias("b"))
    rows = rows.withColumn("y", (F.col("a") > 50).cast("int"))
    how = {"rounds": 20, "depth": 2, "step": 0.3}
    got = {r.id: r.score for r in boost.out_of_fold(rows, ["a", "b"], "fold", **how).collect()}
    again = {r.id: r.score for r in boost.out_of_fold(rows.withColumn("y", F.when(F.col("id") == 8, 1 - F.col("y")).otherwise(F.col("y"))).repartition(5), ["a", "b"], "fold", **how).collect()}
    assert len(got) == 200 and got[8] == again[8] and sum((s > 0.5) == (k * 37 % 101 > 50) for k, s in got.items()) > 190
    lone = boost.out_of_fold(rows.withColumn("y", (F.col("fold") == 1).cast("int")), ["a", "b"], "fold", **how).groupBy("fold").agg(F.max("score").alias("m")).collect()
    assert {r.fold: r.m for r in lone}[1] == 0.0


def test_functions_are_told_their_own_part():
    """What all functions of a program are told grows with the program, not with its square, and no finding is lost."""
    import json

    def size(n):
        opened = K.facts(code("mov esi,0x0\ncall 1 <open@plt>\ncall 2 <read@plt>\ncall 3 <send@plt>\nmov DWORD PTR [rbx+0x18],eax\nlea rdi,[rbx+0x20]"))
        return sum(len(json.dumps(x)) for _, x in K.told({f"f{k:04}": opened for k in range(n)}))

    assert size(800) <= 2 * size(400)
    codes = {f: code(text) for f, text in PROGRAM.items()}
    facts = {f: K.facts(c) for f, c in codes.items()}
    whole, own = K.summary(facts), dict(K.told(facts))
    found = lambda about: [(f, kernel(f, c, about(f))) for f, c in codes.items() for kernel in K.PROGRAM_KERNELS.values()]
    assert set(own) == set(codes) and found(own.get) == found(lambda f: whole)


def test_out_of_fold_makes_rows_once(spark):
    """Plans after the first, with the one that draws rows by hash, read stored rows and do not repeat how features are made."""
    from pyspark.sql import functions as F

    from strandline.operators import boost

    rows = spark.range(300).select((F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 2).alias("y"), *(F.contains(F.col("id").cast("string"), F.lit(str(k))).cast("int").alias(f"f{k}") for k in range(9)))
    got = boost.out_of_fold(rows, [f"f{k}" for k in range(9)], "fold", rows=100, rounds=2, depth=2)
    assert "contains" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert got.count() == 300 and got.filter("score > 0 and score < 1").count() == 300


def test_out_of_fold_fits_to_all_rows(spark):
    """Beyond the rows of one task trees are fitted to all rows by tasks that meet, and are the trees that one task makes;
    equal rows count as often as they stand there."""
    from pyspark.sql import functions as F

    from strandline.operators import boost

    mixed = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m))
    rows = spark.range(2000).select("id", (F.col("id") % 3).cast("int").alias("fold"), (mixed(1, 1000) / 7).alias("a"), (mixed(2, 1000) / 7).alias("b"), (mixed(3, 30) == 0).cast("int").alias("c"), F.lit(1.0).alias("d"), (F.col("id") == 3).cast("int").alias("e"))
    rows = rows.withColumn("y", ((F.col("a") > F.col("b")) != (mixed(4, 10) == 0)).cast("int"))
    rows = rows.unionAll(rows.filter("id < 5").crossJoin(spark.range(100).select())).cache()
    how = {"rounds": 15, "depth": 4, "step": 0.3}
    alone, met = ({tuple(r)[:-1]: r.score for r in boost.out_of_fold(df, ["a", "b", "c", "d", "e"], "fold", rows=n, **how).collect()} for df, n in ((rows, 10_000), (rows.repartition(7), 500)))
    assert alone == met and len(met) == 2000 and len(set(met.values())) > 100
    sizes = {k: rows.filter(F.col("fold") != k).count() for k in range(3)}
    sets = rows.select(F.col("fold").alias("__own"), F.lit(1).alias("__w"), F.col("a").cast("double"), F.col("c").cast("double"))
    for k, (a, c) in boost.quantile_cuts(sets, ["a", "c"], sizes).items():
        values = sorted(r.a for r in rows.filter(F.col("fold") != k).collect())
        assert a.tolist() == sorted({values[j * (len(values) - 1) // 64] for j in range(1, 64)} - {values[-1]}) and c.tolist() == [0.0]
    rows.unpersist()
