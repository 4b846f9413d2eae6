"""Feature groups on small artifacts, with values counted by hand."""

from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.operators import features as X
from strandline.operators import measures as M

INSNS = "target_id string, function string, seq bigint, pc bigint, size int, instruction string, callee string"


def insns(spark, rows):
    return spark.createDataFrame([("p", f, k, 0x1000 + 4 * k, 4, t, t.split("<")[1].split("@")[0].rstrip(">") if t.startswith("call") and "<" in t else None) for k, (f, t) in enumerate(rows)], INSNS)


def insn(address, opcode, operands, kind=None, target=None):
    return (address, opcode, operands, f"{opcode} {','.join(operands)}", kind, target)


CFG = "target_id string, name string, instructions array<struct<address:string,opcode:string,operands:array<string>,asm:string,kind:string,target:string>>, basic_blocks array<struct<id:string,instructions:array<string>>>, cfg_edges array<struct<source:string,src:string,target:string,target_address:string,type:string>>"


def function(spark):
    """Blocks a (branch), b (loop body that calls and writes), c (short error return), d (return zero)."""
    code = [
        insn("1", "cmp", ["QWORD PTR [rdi+0x8]", "0x10"]),
        insn("2", "jne", ["c"], "conditional", "7"),
        insn("3", "mov", ["DWORD PTR [rbp-0x4]", "0xfff"]),
        insn("4", "call", ["rax"], "call"),
        insn("5", "add", ["QWORD PTR [rip+0x20]", "rbx"]),
        insn("6", "jne", ["b"], "conditional", "3"),
        insn("7", "mov", ["eax", "-1"]),
        insn("8", "ret", []),
        insn("9", "xor", ["eax", "eax"]),
        insn("a", "lea", ["rcx", "[rdx+rax*4]"]),
        insn("b", "jmp", ["QWORD PTR [rdx+rax*8]"]),
        insn("c", "ret", []),
    ]
    blocks = [("bb_1", ["1", "2"]), ("bb_3", ["3", "4", "5", "6"]), ("bb_7", ["7", "8"]), ("bb_9", ["9", "a", "b"]), ("bb_c", ["c"])]
    edge = lambda s, t, kind: (s, None, t, None, kind)
    edges = [edge("bb_1", "7", "taken"), edge("bb_1", "bb_3", "fall"), edge("bb_3", "3", "taken"), edge("bb_3", "9", "fall"), edge("bb_9", "c", "jump")]
    return spark.createDataFrame([("p", "f", code, blocks, edges), ("p", "empty", [], [], [])], CFG)


def test_cfg_measures(spark):
    rows = {r.function: r.asDict() for r in M.cfg_measures(function(spark)).collect()}
    assert set(rows) == {"f", "empty"} and len(rows["f"]) == 127 and all(v == 0 for k, v in rows["empty"].items() if k not in M.KEY)
    got = rows["f"]
    want = {
        "num_instructions": 12, "num_blocks": 5, "num_edges": 5, "num_calls": 1, "num_cond_jumps": 2, "has_loop": 1, "num_mem_reads": 3, "num_mem_writes": 2, "num_stack_writes": 1,
        "num_non_stack_writes": 1, "num_rip_relative_accesses": 1, "num_arg_based_mem_accesses": 3, "has_page_constant_0xfff": 1, "has_negative_one": 1, "num_cmp": 1, "num_and_or_xor": 1,
        "num_add_sub": 1, "num_lea": 1, "has_call_under_branch": 1, "has_write_under_branch": 1, "has_short_error_return": 1, "has_return_zero": 1, "has_return_negative": 1, "num_indirect_calls": 1,
        "num_indirect_jumps": 1, "has_jump_table_like_pattern": 1, "num_scaled_index_memory_accesses": 2, "num_block_regions": 5, "num_branch_regions": 4, "num_loop_regions": 1,
        "region_max_num_instructions": 4, "region_max_num_successors": 2, "region_max_num_predecessors": 2, "loop_region_max_num_instructions": 4, "loop_region_max_num_successors": 1,
        "loop_region_max_num_predecessors": 1, "loop_region_max_has_call": 1, "branch_region_max_num_instructions": 8, "branch_region_max_has_mem_write": 1, "region_max_has_return_zero": 1,
    }
    assert {k: got[k] for k in want} == want


def test_constants_and_operands(spark):
    texts = ["mov eax,-0x1", "cmp r12,+5", "and eax,0x1000", "mov rax,0xffffffffffffffff", "add eax,+0x10", "x -16 17 0x10"]
    df = spark.createDataFrame([(t,) for t in texts], "asm string").select(M.constants(F.col("asm")).alias("c"))
    got = [[("-" if x.negative else "") + x.digits for x in r.c] for r in df.collect()]
    assert got == [["-1"], ["2", "5"], ["1000"], ["F" * 16], [], ["-10", "11", "10"]]


def test_effects_and_reach(spark):
    rows = [("a", "call 1 <b>"), ("b", "call 1 <setuid@plt>"), ("b", "call 2 <open@plt>"), ("c", "call 1 <a>"), ("c", "call 2 <execve@plt>"), ("d", "ret"), ("e", "call 1 <e>")]
    code = insns(spark, rows)
    eff = {r.function: r for r in X.effect_features(code).collect()}
    assert set(eff) == {"b", "c"} and (eff["b"].eff_total, eff["b"].eff_ncats, eff["b"].eff_file_read, eff["b"].eff_file_mutation) == (2, 2, 1, 1)
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "c", "a"), ("p", "e", "e")], "target_id string, src string, dst string")
    reach = {r.function: (r.reach_ncats, r.reach_dist, r.reach_neff_callees, r.reach_exec, r.reach_file_read) for r in X.reach_features(code, edges).collect()}
    assert reach == {"a": (3, 1, 1, 0, 1), "b": (3, 0, 0, 0, 1), "c": (4, 0, 1, 1, 1)}


def test_literals(spark):
    image = bytes(0x100) + b"/etc/passwd\0ab\0%s plain\0" + b"x" * 300
    sections = spark.createDataFrame([("p", ".text", 0x4000, 0x100, 0, 0), ("p", ".rodata", 0x5000, 400, 0x100, 1)], "target_id string, name string, vma bigint, size bigint, file_off bigint, ord int")
    images = spark.createDataFrame([("p", bytearray(image))], "target_id string, content binary")
    at = lambda k, to: f"lea rdi,[rip+{hex(to - (0x1000 + 4 * k + 4))}]"
    rows = [("f", at(0, 0x5000)), ("f", at(1, 0x500C)), ("f", at(2, 0x500F)), ("g", at(3, 0x5018)), ("g", "movabs rax,0x2f636974617473"), ("g", at(5, 0x4000)), ("g", "mov eax,0x12345678")]
    code = insns(spark, rows)
    found = X.literals_by_reference(code, sections, images)
    assert sorted((r.function, r.literal) for r in found.collect()) == [("f", "%s plain"), ("f", "/etc/passwd")]
    flags = {r.function: r for r in X.string_features(found.unionByName(X.literals_by_immediate(code))).collect()}
    assert (flags["f"].s_count, flags["f"].s_syspath, flags["f"].s_cred, flags["f"].s_fmt) == (2, 1, 1, 1)
    assert (flags["g"].s_count, flags["g"].s_path, flags["g"].s_fmt) == (1, 1, 0)


def test_debug_facts(spark):
    params = spark.createDataFrame([("p", "f", [("passwd", "char *", True), ("n", None, None)]), ("p", "g", None)], "target_id string, function string, params array<struct<name:string,type:string,is_pointer:boolean>>")
    lines = spark.createDataFrame([("p", 0x1000, "src/Auth.c"), ("p", 0x1004, "src/auth.c"), ("p", 0x1008, "a.c")], "target_id string, pc bigint, file string")
    files = X.source_file(insns(spark, [("f", "nop")] * 3 + [("h", "nop")]), lines)
    got = {r.function: r for r in X.debug_features(params, files).collect()}
    assert (got["f"].file_auth, got["f"].pname_passwd, got["f"].ptype_passwd, got["f"].n_str_param) == (1, 1, 0, 1)
    assert set(got) == {"f", "g"} and got["g"].n_str_param == 0
    assert {r.function: (r.p_nparam, r.p_nptr) for r in X.pointer_features(params).collect()} == {"f": (2, 1), "g": (0, 0)}
    tree = [(1, 0, "subprogram", "f", None), (2, 1, "variable", "Crypt_salt", 10), (3, 1, "formal_parameter", "x", 20), (4, 1, "lexical_block", None, None), (5, 4, "variable", "cookie", 10), (10, 0, "pointer", None, 11), (11, 0, "const", None, 12), (12, 0, "structure", "sockaddr_in", None)]
    tree += [(k, 0, "pointer", None, k + 1) for k in range(20, 31)] + [(31, 0, "typedef", "passwd", None)]
    facts = spark.createDataFrame([("p", *r) for r in tree], "target_id string, id bigint, parent bigint, tag string, name string, type_id bigint")
    (row,) = X.local_features(facts).collect()
    assert (row.lv_crypt, row.lv_salt, row.lv_cookie, row.ty_sockaddr, row.ty_passwd) == (1, 1, 0, 1, 0)


def test_order_and_assembly(spark):
    order = X.feature_order()
    assert len(order) == len(set(order)) == 283 and order[0] == "num_instructions" and order[-1] == "ty_ucred"
    base = spark.createDataFrame([("p", "auth_check"), ("p", "g")], "target_id string, function string")
    cfg = M.cfg_measures(function(spark)).withColumn("function", F.when(F.col("function") == "f", "g").otherwise(F.col("function")))
    rows = {r.function: r for r in X.assemble(base, [cfg, X.name_features(base)]).collect()}
    assert rows["auth_check"].name_auth == 1 and rows["auth_check"].num_calls == 0 and rows["auth_check"].reach_dist == 99
    assert rows["g"].num_calls == 1 and len(rows["g"]) == 285


def test_label_sources(spark):
    eff = X.effect_features(insns(spark, [("run", "call 1 <execve@plt>"), ("mem_free", "call 1 <unlink@plt>"), ("tiny", "call 1 <setuid@plt>"), ("lim", "call 1 <setrlimit@plt>")]))
    sizes = spark.createDataFrame([("p", f, n) for f, n in (("run", 8), ("mem_free", 9), ("tiny", 7), ("lim", 20), ("check_auth", 30), ("auth_log", 30), ("verify", 3))], "target_id string, function string, n_instructions int")
    assert [r.function for r in X.concrete_issuers(eff, sizes).collect()] == ["run"]
    assert [r.function for r in X.named_deciders(sizes).collect()] == ["check_auth"]


def test_hints(spark):
    text = "calls `do_it(x) -> run`, `a/b`, `\"quoted\"`, `SITE`, `open@plt`, ngx_http_x and handle_9"
    row = spark.createDataFrame([(text, "`a.c:3-9`, b.c:7, c.h, external libc/glibc, stage 2,")], "t string, h string").select(S.quoted_symbols(F.col("t")).alias("q"), S.symbol_hints(F.col("t")).alias("s"), S.place_hints(F.col("h")).alias("p")).first()
    assert row.q == ["do_it", "quoted"]
    assert row.s == ["SITE", "a/b", "do_it", "do_it(x)", "handle_9", "ngx_http_x", "open@plt", "run"]
    assert [tuple(p) for p in row.p] == [("a.c", 3, 9), ("b.c", 7, 7), ("c.h", None, None)]
