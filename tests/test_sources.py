import json
import struct

from strandline.sources import artifacts as A
from strandline.sources import writers as W


def test_instructions_and_edges(spark, tmp_path):
    rows = [("f", "call 1 <g>", "0x10", 5), (".plt", "call 1 <f>", "0x0", 5), ("g", "ret", "0x20", 1), ("f", "call 2 <ext@plt>", "0x15", 5)]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(dict(zip(("function", "instruction", "pc", "size"), r, strict=True))) for r in rows) + "\nnot json\n")
    insns = A.instructions(spark, str(tmp_path / "a.jsonl"), "p")
    got = [(r.function, r.seq, r.pc, r.callee) for r in insns.orderBy("seq").collect()]
    assert got == [("f", 0, 16, "g"), ("g", 2, 32, None), ("f", 3, 21, "ext")]
    assert [tuple(r) for r in A.call_edges(insns).collect()] == [("p", "f", "g")]


def test_cfg_first_wins(spark, tmp_path):
    fs = [{"name": "a", "instructions": [{"opcode": "ret"}]}, {"name": "x@plt"}, {"name": ".p"}, {"name": "a", "instructions": []}]
    (tmp_path / "c.json").write_text(json.dumps({"functions": fs}))
    (row,) = A.cfg_functions(spark, str(tmp_path / "c.json")).collect()
    assert row.name == "a" and len(row.instructions) == 1


def test_feature_document_round_trip(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"p": {"f": {"a": 1, "b": 2}, "g": {"a": 3}}}))
    rows = A.feature_document(spark, str(tmp_path / "f.json"))
    assert {(r.function, r.a, r.b, r.c) for r in A.wide(rows, ["a", "b", "c"]).collect()} == {("f", 1, 2, 0), ("g", 3, 0, 0)}
    W.feature_document(rows, str(tmp_path / "out"))
    (text,) = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert json.loads(text)["functions"]["g"] == {"a": 3}


def test_markdown_and_review(spark, tmp_path):
    (tmp_path / "m.md").write_text("# t\n## one\n| name | why |\n|---|---|\n| `a` | x |\n| bad |\n## two\n| b | y |\n")
    rows = A.markdown_tables(spark, str(tmp_path / "m.md"), ["name", "why"]).orderBy("section").collect()
    assert [(r.section, r.idx, r.name) for r in rows] == [("one", 1, "`a`"), ("two", 1, "b")]
    (tmp_path / "r.csv").write_text("fn,other,source_verdict\na,no,true_sink\n")
    assert [tuple(r) for r in A.review_csv(spark, str(tmp_path / "r.csv")).collect()] == [("a", "true_sink")]


def elf():
    names = b"\0.rodata\0.shstrtab\0"
    head = b"\x7fELF\x02\x01" + bytes(34) + struct.pack("<Q", 64) + bytes(10) + struct.pack("<HHH", 64, 3, 2)
    raw = head.ljust(64, b"\0")
    at = 64 + 3 * 64
    sec = lambda n, addr, off, size: struct.pack("<IIQQQQ", n, 1, 0, addr, off, size).ljust(64, b"\0")
    return raw + sec(0, 0, 0, 0) + sec(1, 0x4000, 100, 32) + sec(9, 0, at, len(names)) + names


def test_elf(spark, tmp_path):
    assert [(s[1], s[2], s[3]) for s in A.parse_sections(elf())][1] == (".rodata", 0x4000, 32)
    assert A.parse_sections(b"\x7fELF") == []
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "big").write_bytes(elf() + bytes(50))
    (tmp_path / "small").write_bytes(elf())
    (tmp_path / "text").write_bytes(b"x" * 9999)
    assert A.largest_elf(spark, str(tmp_path)).first().path.endswith("big")
    assert A.elf_sections(spark, str(tmp_path)).filter("name = '.rodata'").count() == 2


def test_c_and_lines(spark, tmp_path):
    (tmp_path / "tests").mkdir()
    (tmp_path / "tests" / "t.c").write_text("int no(void){}\n")
    (tmp_path / "a.c").write_text("int yes(void){}\n")
    assert [r.function for r in A.c_functions(spark, str(tmp_path)).collect()] == ["yes"]
    (tmp_path / "l.txt").write_text("a.c 3 0x10\nb.c 4 0x10\nnoise\n")
    assert [tuple(r) for r in A.line_table(spark, str(tmp_path / "l.txt")).collect()] == [(16, "b.c")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("p", "f", 1), ("q", "g", 2)], "target_id string, function string, a int")
    W.feature_csv(df, str(tmp_path / "csv"), ["a", "b"])
    assert A.feature_csv(spark, str(tmp_path / "csv"), ["a", "b"]).filter("a = 2 and b = 0").count() == 1
    W.replace_targets(df, str(tmp_path / "t"))
    W.replace_targets(df.filter("target_id = 'p'").withColumn("a", df.a + 10), str(tmp_path / "t"))
    assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [2, 11]
    patch = spark.createDataFrame([("p", "f", 9)], "target_id string, function string, z int")
    assert sorted(r.z for r in W.patched(df, patch, ["target_id", "function"], ["z"]).collect()) == [0, 9]
    assert json.loads(W.manifest(df, ["target_id"]))["rows"] == 2
    assert "| p | f | 1 |" in W.markdown_report(df.orderBy("target_id"), "t")


def test_lines_keep_their_order_across_splits(spark, tmp_path):
    text = "".join(f"line {k} {'x' * (k % 40)}\n" for k in range(5000))
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("one\ntwo\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = A.ordered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    own = sorted((r.seq, r.line) for r in rows if r.path.endswith("a.txt"))
    assert [t for _, t in own] == text.splitlines() and len({s for s, _ in own}) == 5000
    assert [r.line for r in sorted((r for r in rows if r.path.endswith("b.txt")), key=lambda r: r.seq)] == ["one", "two"]


def test_first_existing_goals_and_paths(spark, tmp_path):
    (tmp_path / "two.csv").write_text("fn,verdict\na,sink\n")
    assert [tuple(r) for r in A.review_csv(spark, str(tmp_path / "one.csv"), str(tmp_path / "two.csv")).collect()] == [("a", "sink")]
    assert A.review_csv(spark, str(tmp_path / "no.csv")).count() == 0 and A.first_existing(spark, [str(tmp_path / "no")]) is None
    goal = {"id": "g", "pc": "0x1", "function": "f", "kind": "k", "source_location": {"file": "a.c", "line": 7}}
    (tmp_path / "g.json").write_text(json.dumps({"goals": [goal]}))
    (row,) = A.goals(spark, str(tmp_path / "g.json")).collect()
    assert (row.id, row.file, row.line, row.target_name) == ("g", "a.c", 7, None) and A.goals(spark, str(tmp_path / "none.json")).count() == 0
    rows = A.artifact_paths(spark.createDataFrame([("p",), ("nginx_1_4_0_validation",)], "target_id string"), "/data/all/").collect()
    assert [r.folder for r in rows] == ["/data/all/p/artifacts/stage_02_static_ir_cfg", "/data/nginx_1_4_0_validation/artifacts/stage_02_static_ir_cfg"]
    labels = A.literal_relation(spark, {"p": {"pos": ["a"], "neg": ["b"]}, "q": {"pos": ["c"]}})
    assert sorted(map(tuple, labels.collect())) == [("p", "a", 1), ("p", "b", 0), ("q", "c", 1)]
    main, aux = (spark.createDataFrame(r, "target_id string, function string, size int") for r in ([("p", "f", 1)], [("p", "f", 2), ("p", "g", 3)]))
    assert sorted(map(tuple, A.named_functions([main], [aux], ["target_id", "function"]).collect())) == [("p", "f", 1), ("p", "g", 3)]


def test_debug_tree_and_metadata(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text(json.dumps({"id": 1, "parent": 0, "tag": "subprogram", "name": "f", "type_id": None}) + "\n")
    assert [tuple(r) for r in A.debug_tree(spark, str(tmp_path / "t.jsonl"), "p").collect()] == [("p", 1, 0, "subprogram", "f", None)]
    (tmp_path / "bin").mkdir()
    assert A.program_metadata(spark, str(tmp_path / "bin"), "p").count() == 0 if any((tmp_path / "bin").iterdir()) else True
    (tmp_path / "bin" / "a").write_bytes(elf())
    (row,) = A.program_metadata(spark, str(tmp_path / "bin"), "p").collect()
    assert row.length == len(elf()) and len(row.sha256) == 64 and row.has_debug_info is False


def test_split_profiles_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("train", "p", "f", 1, 2), ("test", "p", "g", 3, 4)], "split string, target_id string, function string, a int, b int")
    W.split_profiles(df, str(tmp_path / "s"), {"one": ["a"], "two": ["a", "b"]})
    back = spark.read.csv(str(tmp_path / "s" / "two"), header=True)
    assert sorted((r.split, r.function, r.b) for r in back.collect()) == [("test", "g", "4"), ("train", "f", "2")]
    assert sorted(p.name for p in (tmp_path / "s" / "one").iterdir() if p.is_dir()) == ["split=test", "split=train"]
    many = spark.range(500).selectExpr("id", "id % 2 as target_id")
    assert W.markdown_report(many, "all").count("\n") == 504
    text = W.detail_report(many.groupBy("target_id").count(), many, "all", "target_id")
    assert text.index("### 0") < text.index("### 1") and text.count("\n") > 505
