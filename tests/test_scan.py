"""The whole scan on a small program, the command line, and evaluation operators on fixtures."""

import json

from strandline import cli
from strandline.operators import boost, graph, relational, scan
from strandline.operators import evaluate as E
from strandline.plans.example import PROGRAM
from strandline.sources import artifacts as A


def write_program(folder, name, program):
    place = folder / name / A.STAGE
    place.mkdir(parents=True)
    rows = [{"function": f, "instruction": t, "pc": hex(8 * k), "size": 8} for f, text in program.items() for k, t in enumerate(text.splitlines())]
    (place / f"{name}_disassembly.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_whole_scan(spark, tmp_path, capsys):
    write_program(tmp_path, "p", PROGRAM | {"alone": "call 1 <send@plt>"})
    insns = cli.programs(spark, str(tmp_path), ["p", "missing"])
    assert "missing: no artifacts" in capsys.readouterr().out
    near = {r.function: r.dist for r in scan.recall(insns).collect()}
    assert near["read_it"] == 0 and near["transfer"] == 1 and near["mid"] == 2 and near["near"] == 3 and "far" not in near and "alone" not in near
    tags = {r.function: r.tag for r in scan.endpoints(insns).collect()}
    assert tags["serve"] == "fd_arg" and tags["feeder"] == "fd_table" and tags["queue"] == "fd_queue" and tags["filler"] == "crossbuf"
    screened = spark.createDataFrame([("p", "serve"), ("p", "other")], "target_id string, function string")
    final = {r.function: (r.in_screen, r.recovered, r.tag) for r in scan.integrated(insns, screened).collect()}
    assert final["serve"] == (1, 0, None) and final["other"] == (1, 0, None) and final["feeder"] == (0, 1, "fd_table")
    assert set(final) == {"serve", "other"} | {f for f in tags if f in near and f != "serve"}
    truth = spark.createDataFrame([("p", "serve"), ("p", "feeder"), ("p", "gone")], "target_id string, function string")
    (row,) = scan.stage_counts(insns, screened, scan.integrated(insns, screened), truth).collect()
    assert (row.n_screen, row.n_truth, row.tp, row.fn, row.recovered_truth) == (2, 3, 2, 1, 1) and row.n_final == len(final)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda app: spark)
    write_program(tmp_path, "p", PROGRAM)
    names = [*PROGRAM, *(f"g{k}" for k in range(1200))]
    rows = [("p", f, float(f in ("serve", "feeder")), float(k % 7)) for k, f in enumerate(names)]
    features = spark.createDataFrame(rows, "target_id string, function string, a double, b double")
    features.write.parquet(str(tmp_path / "features"))
    model = boost.train(features.withColumn("y", features.a), ["a", "b"], rounds=2, depth=2)
    model.write().save(str(tmp_path / "model"))
    spark.createDataFrame([("p", "serve"), ("p", "queue")], "target_id string, function string").write.parquet(str(tmp_path / "truth"))
    at = lambda name: str(tmp_path / name)
    assert cli.main(["list", at("features")]) == 0 and f"{len(names)} functions" in capsys.readouterr().out
    assert cli.main(["scan", "p", at("features"), at("model"), "0.0"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == len(names)  # all of them, beyond a thousand, too
    assert cli.main(["scan", "q", at("features"), at("model")]) == 1 and "unknown target q" in capsys.readouterr().out
    assert cli.main(["detector", at(""), "p"]) == 0 and "fd_arg" in capsys.readouterr().out
    assert cli.main(["pipeline", at(""), at("features"), at("model"), at("truth")]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0].startswith("target_id") and out[1].split()[:2] == ["p", "2"]
    assert cli.main(["detector", at(""), "nothing"]) == 1 and cli.main([]) == 1 and cli.main(["scan", "p"]) == 1


def test_cycles(spark):
    """Nodes on cycles, against a search from every node."""
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)] + [(100, 101), (101, 102), (102, 100), (103, 100), (102, 104), (105, 105)]
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def returns(x):
        seen, todo = set(), list(after.get(x, ()))
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += after.get(y, ())
        return x in seen

    got = {r.node for r in graph.on_cycle(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {x for e in edges for x in e if returns(x)}
    assert graph.on_cycle(spark.createDataFrame([(1, 2)], "src bigint, dst bigint")).count() == 0


def test_numbers_and_ranks_do_not_depend_on_tasks(spark):
    import hashlib

    df = spark.range(0, 300, 1, 7).selectExpr("id", "id % 3 as s")
    assert [r.k for r in graph.numbered(df, "id", "k").orderBy("id").collect()] == list(range(1, 301))
    from pyspark.sql import functions as F

    from strandline.operators.positional import hash_rank

    got = {r.id: (r["__k"], r["__n"]) for r in hash_rank(df, ["s"], F.col("id")).collect()}
    for s in range(3):
        order = sorted(range(s, 300, 3), key=lambda x: (hashlib.sha256(str(x).encode()).hexdigest(), x))
        assert [got[x] for x in order] == [(k + 1, 100) for k in range(100)]


def test_resolvable_when_nothing_is_known(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 5)], "prog string, fn int")
    known = spark.createDataFrame([("a", 2), ("a", 2)], "prog string, fn int")
    got = sorted(map(str, map(tuple, relational.resolvable(rows, known, "prog", ["fn"]).collect())))
    assert got == ["('a', 2)", "('b', 1)", "(None, 5)"]


def test_auc_of_one_label_is_null(spark):
    rows = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 0), ("b", 0.1, 1)], "g string, score double, y int")
    assert {r.g: r.auc for r in E.roc_auc(rows, by=["g"]).collect()} == {"a": 0.5, "b": None}
    assert E.roc_auc(rows).first().auc == 0.25
