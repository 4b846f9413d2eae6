"""Control-flow measures of functions: sums over instructions, and the largest of each over blocks, branches and loops.

Everything is expressed over four tables of a CFG document, keyed by (target_id, function): instructions (address, n,
opcode, operands, asm, kind, target), blocks (block, ord), members (block, address) and edges (e, src, dst, kind). A
measure is one column expression, used for functions and regions alike, so a table of regions is one aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.graph import regions

KEY = ["target_id", "function"]

# --- Fixed values: opcode and register vocabularies ------------------------------------------------------------------
CONDITIONAL_JUMPS = "ja jae jb jbe jc jcxz je jecxz jg jge jl jle jna jnae jnb jnbe jnc jne jng jnge jnl jnle jno jnp jns jnz jo jp jpe jpo js jz".split()
JUMPS, RETURNS = ("jmp", "jmpq"), ("ret", "retq", "iret", "iretq")
WRITES_TARGET = "add sub and or xor sal sar shl shr inc dec xchg".split()
ARGUMENT_REGISTER = r"\b(?:[re]?(?:di|si|dx|cx)|[dc]l|r[89][dwb]?)\b"
STACK_REGISTER = r"\b[re]?[sb]p\b"
PLAIN_REGISTER = r"^[re]?[abcd]x$|^r(?:[0-9]|1[0-5])$"
CONSTANT = r"(?<![A-Za-z_])([-+]?(?:0x[0-9A-Fa-f]+|\d+)\b)"
RETURN_ZERO = r"\bmov\s+e?ax,0x?0\b|\bxor\s+[re]?ax,[re]?ax\b"
RETURN_NEGATIVE = r"\bmov\s+[re]?ax,-|0xffffffff"
#: Rows at the end of a returning block that are looked at, and the most instructions of a short error block.
TAIL, SHORT_BLOCK = 8, 4

#: The 22 sums and 3 flags that functions and regions share, in the order of the function's measures.
SUMS = "calls cond_jumps mem_reads mem_writes stack_writes non_stack_writes rip_relative_accesses arg_based_mem_accesses small_constants power2_constants cmp test and_or_xor add_sub lea shifts indirect_calls indirect_jumps scaled_index_memory_accesses".split()
FLAGS = "page_constant_0xfff page_size_0x1000 negative_one".split()
#: The suffixes of region measures, in their order.
REGION_SUFFIXES = (
    "num_instructions num_successors num_predecessors num_calls num_cond_jumps num_mem_reads num_mem_writes num_stack_writes num_non_stack_writes "
    "num_rip_relative_accesses num_arg_based_mem_accesses num_small_constants num_power2_constants has_page_constant_0xfff has_page_size_0x1000 has_negative_one "
    "num_cmp num_test num_and_or_xor num_add_sub num_lea num_shifts has_call has_mem_write has_return_zero has_return_negative num_indirect_calls num_indirect_jumps "
    "num_scaled_index_memory_accesses"
).split()
#: The measures of a function, in their order.
FUNCTION_MEASURES = (
    "num_instructions num_blocks num_edges num_calls num_cond_jumps has_loop num_mem_reads num_mem_writes num_stack_writes num_non_stack_writes num_rip_relative_accesses "
    "num_arg_based_mem_accesses num_small_constants num_power2_constants has_page_constant_0xfff has_page_size_0x1000 has_negative_one num_cmp num_test num_and_or_xor "
    "num_add_sub num_lea num_shifts has_call_under_branch has_write_under_branch has_short_error_return has_return_zero has_return_negative num_indirect_calls "
    "num_indirect_jumps has_jump_table_like_pattern num_scaled_index_memory_accesses"
).split()
REGION_COUNTS = "num_block_regions has_block_region num_branch_regions has_branch_region num_loop_regions has_loop_region".split()


# --- columns of one instruction --------------------------------------------------------------------------------------


def is_memory(operand: Column) -> Column:
    return F.contains(operand, F.lit("[")) & F.contains(operand, F.lit("]"))


def count_operands(test) -> Column:
    return F.size(F.filter("operands", lambda o: test(F.lower(o))))


def opens(*prefixes: str) -> Column:
    return reduce(lambda a, b: a | b, (F.startswith(F.col("opcode"), F.lit(p)) for p in prefixes))


def constants(asm: Column) -> Column:
    """Numbers in an instruction text as (negative, hex digits): decimal or hexadecimal, signed, not right after a letter;
    a plus sign before hexadecimal is no number. Beyond 64 bits they saturate."""
    found = F.filter(F.regexp_extract_all(asm, F.lit(CONSTANT), F.lit(1)), lambda x: ~F.startswith(x, F.lit("+0x")))

    def parsed(x):
        bare = F.regexp_replace(x, "^[-+]", "")
        digits = F.when(F.startswith(bare, F.lit("0x")), F.conv(F.substring(bare, 3, 40), 16, 16)).otherwise(F.conv(bare, 10, 16))
        return F.struct(F.startswith(x, F.lit("-")).alias("negative"), digits.alias("digits"))

    return F.transform(found, parsed)


def measured(insns: DataFrame) -> DataFrame:
    """``insns`` with one column for each of SUMS and FLAGS, returns_zero, returns_negative and is_call."""
    first = F.lower(F.get("operands", F.lit(0)))
    bare = F.trim(F.regexp_replace(first, "(?:qword|dword|word|byte) ptr", ""))
    indirect = F.coalesce(F.col("target"), F.lit("")).eqNullSafe(F.lit("")) & (F.size("operands") > 0) & (is_memory(bare) | bare.rlike(PLAIN_REGISTER))
    call = opens("call") | F.col("kind").eqNullSafe(F.lit("call"))
    rows = insns.withColumns({"opcode": F.coalesce("opcode", F.lit("")), "operands": F.coalesce("operands", F.array().cast("array<string>")), "asm": F.coalesce("asm", F.lit(""))})
    rows = rows.withColumns({"consts": constants(F.col("asm")), "mems": F.when(opens("lea"), 0).otherwise(count_operands(is_memory)), "is_call": call, "indirect": F.coalesce(indirect, F.lit(False))})
    writes_first = F.coalesce(is_memory(first), F.lit(False)) & (opens("mov", "stos", "set") | F.col("opcode").isin(WRITES_TARGET))
    same = F.size(F.filter("operands", lambda o: o == F.get("operands", F.lit(0))))
    writes = F.when(F.col("mems") == 0, 0).when(opens("pop"), F.coalesce(is_memory(first), F.lit(False)).cast("int")).when(opens("push"), 0).when(writes_first, same).otherwise(0)
    rows = rows.withColumn("mem_writes", writes)
    again = F.when(opens("mov", "set") | opens("pop") | opens("push"), 0).otherwise(F.col("mem_writes"))
    reads = F.when(F.col("mems") == 0, 0).when(opens("pop") & (F.col("mem_writes") > 0), 0).otherwise(F.col("mems") - F.col("mem_writes") + again)
    on_stack = F.coalesce(first.rlike(STACK_REGISTER), F.lit(False))
    number = lambda test: F.size(F.filter("consts", test))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    rows = rows.withColumns(
        {
            "calls": flag(F.col("is_call")),
            "cond_jumps": flag(F.col("opcode").isin(CONDITIONAL_JUMPS) | F.col("kind").eqNullSafe(F.lit("conditional"))),
            "mem_reads": reads,
            "stack_writes": F.when(on_stack, F.col("mem_writes")).otherwise(0),
            "non_stack_writes": F.when(on_stack, 0).otherwise(F.col("mem_writes")),
            "rip_relative_accesses": count_operands(lambda o: is_memory(o) & F.contains(o, F.lit("rip"))),
            "arg_based_mem_accesses": count_operands(lambda o: is_memory(o) & o.rlike(ARGUMENT_REGISTER)),
            "scaled_index_memory_accesses": count_operands(lambda o: o.rlike(r"\[[^\]]*\*[248][^\]]*\]")),
            "small_constants": number(lambda c: c["digits"].rlike("^(?:[0-9A-F]|10)$")),
            "power2_constants": number(lambda c: c["digits"].rlike("^[1248]0*$")),
            "page_constant_0xfff": flag(F.exists("consts", lambda c: ~c["negative"] & (c["digits"] == "FFF"))),
            "page_size_0x1000": flag(F.exists("consts", lambda c: ~c["negative"] & (c["digits"] == "1000"))),
            "negative_one": flag(F.exists("consts", lambda c: c["negative"] & (c["digits"] == "1"))),
            "cmp": flag(opens("cmp")), "test": flag(opens("test")), "and_or_xor": flag(opens("and", "or", "xor")), "add_sub": flag(opens("add", "sub")),
            "lea": flag(opens("lea")), "shifts": flag(opens("shl", "shr", "sal", "sar")),
            "indirect_calls": flag(F.col("is_call") & F.col("indirect")), "indirect_jumps": flag(F.col("opcode").isin(*JUMPS) & F.col("indirect")),
            "returns_zero": flag(F.lower("asm").rlike(RETURN_ZERO)), "returns_negative": flag(F.lower("asm").rlike(RETURN_NEGATIVE)),
        }
    )
    return rows.drop("consts", "mems", "indirect")


def _summed() -> list[Column]:
    return [F.sum(c).cast("bigint").alias(f"num_{c}") for c in SUMS] + [F.max(c).cast("bigint").alias(f"has_{c}") for c in FLAGS]


# --- tables of a document --------------------------------------------------------------------------------------------


def tables(cfg: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(instructions, blocks, members, edges) of CFG functions (target_id, name, instructions, basic_blocks, cfg_edges).

    An edge of a block whose last instruction is conditional is cond_true if taken, else cond_false; others are jumps.
    """
    f = cfg.withColumnRenamed("name", "function")
    insns = f.select(*KEY, F.posexplode("instructions").alias("n", "i")).select(*KEY, "n", "i.*")
    blocks = f.select(*KEY, F.posexplode("basic_blocks").alias("ord", "b")).select(*KEY, F.col("b.id").alias("block"), "ord", F.col("b.instructions").alias("addresses"))
    members = blocks.select(*KEY, "block", F.posexplode("addresses").alias("at", "address"))
    to = F.col("x.target")
    dst = F.when(F.coalesce(to, F.lit("")) != "", F.when(F.startswith(to, F.lit("bb_")), to).otherwise(F.concat(F.lit("bb_"), to))).otherwise(F.concat(F.lit("bb_"), F.col("x.target_address")))
    edges = f.select(*KEY, F.posexplode("cfg_edges").alias("e", "x")).select(*KEY, "e", F.coalesce(F.nullif("x.source", F.lit("")), "x.src").alias("src"), dst.alias("dst"), F.col("x.type").alias("type")).filter("src is not null and dst is not null")
    last = members.join(_by_address(insns).select(*KEY, "address", "kind"), [*KEY, "address"]).groupBy(*KEY, "block").agg(F.max_by("kind", "at").alias("last_kind"))
    kind = F.when(F.col("last_kind") == "conditional", F.when(F.col("type") == "taken", "cond_true").otherwise("cond_false")).otherwise("jump")
    edges = edges.join(last.withColumnRenamed("block", "src"), [*KEY, "src"], "left").select(*KEY, "e", "src", "dst", kind.alias("kind"))
    return insns, blocks.drop("addresses"), members, edges


def _by_address(insns: DataFrame) -> DataFrame:
    """The last instruction of each address."""
    rest = [c for c in insns.columns if c not in (*KEY, "address", "n")]
    return insns.groupBy(*KEY, "address").agg(F.max_by(F.struct(*rest), "n").alias("x")).select(*KEY, "address", "x.*")


def branch_regions(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, region, block): what grows from the end of each conditional edge along edges into blocks of one predecessor."""
    node = lambda c: F.to_json(F.struct(*KEY, F.col(c).alias("block")))
    known = blocks.select(*KEY, F.col("block").alias("dst"))
    inner = edges.join(known, [*KEY, "dst"], "left_semi")
    seeds = inner.filter("kind in ('cond_true', 'cond_false')").select(F.to_json(F.struct(*KEY, "e")).alias("region"), node("dst").alias("node"))
    entered = edges.groupBy(*KEY, "dst").agg(F.count("*").alias("n")).filter("n > 1").select(node("dst").alias("node"))
    grown = regions(inner.select(node("src").alias("src"), node("dst").alias("dst")), seeds, entered)
    held = F.from_json("node", "target_id string, function string, block string")
    return grown.select("region", held.alias("x")).select("x.target_id", "x.function", "region", "x.block")


def loop_regions(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, region, block): for each edge back to a block at or before its own, all blocks from one to the other in
    layout order."""
    at = lambda c: blocks.select(*KEY, F.col("block").alias(c), F.col("ord").alias(f"{c}_ord"))
    back = edges.join(at("src"), [*KEY, "src"]).join(at("dst"), [*KEY, "dst"]).filter("dst_ord <= src_ord")
    spans = back.select(*KEY, F.col("e").cast("string").alias("region"), F.explode(F.sequence("dst_ord", "src_ord")).alias("ord"))
    return spans.join(blocks, [*KEY, "ord"]).select(*KEY, "region", "block")


def region_measures(membership: DataFrame, block_insns: DataFrame, edges: DataFrame, prefix: str) -> DataFrame:
    """(key, ``prefix``suffixes): the measures of each region (key, region, block), then the largest of each by itself over
    a function's regions. Successors and predecessors are edges that leave or enter the region."""
    own = membership.distinct()
    rows = own.join(block_insns, [*KEY, "block"], "left").groupBy(*KEY, "region").agg(F.count("address").alias("num_instructions"), *_summed(), F.max("returns_zero").alias("has_return_zero"), F.max("returns_negative").alias("has_return_negative"))
    end = lambda c: own.select(*KEY, "region", F.col("block").alias(c), F.lit(1).alias(f"in_{c}"))
    leave = end("src").join(edges, [*KEY, "src"]).join(end("dst"), [*KEY, "region", "dst"], "left").filter("in_dst is null").groupBy(*KEY, "region").agg(F.count("*").alias("num_successors"))
    enter = end("dst").join(edges, [*KEY, "dst"]).join(end("src"), [*KEY, "region", "src"], "left").filter("in_src is null").groupBy(*KEY, "region").agg(F.count("*").alias("num_predecessors"))
    rows = rows.join(leave, [*KEY, "region"], "left").join(enter, [*KEY, "region"], "left")
    rows = rows.withColumns({"has_call": (F.col("num_calls") > 0).cast("int"), "has_mem_write": (F.col("num_mem_writes") > 0).cast("int")})
    return rows.groupBy(*KEY).agg(*(F.coalesce(F.max(s), F.lit(0)).cast("bigint").alias(f"{prefix}{s}") for s in REGION_SUFFIXES))


def cfg_measures(cfg: DataFrame) -> DataFrame:
    """(target_id, function, and 125 measures as bigint): 32 of the function, 29 region maxima for blocks, branches and
    loops, and six counts and flags of regions. A function without blocks, edges or instructions has zeros for them."""
    insns, blocks, members, edges = tables(cfg)
    rows = measured(insns)
    by_block = members.join(_by_address(rows), [*KEY, "address"])
    whole = rows.groupBy(*KEY).agg(F.count("*").alias("num_instructions"), *_summed())
    counted = lambda df, name: df.groupBy(*KEY).agg(F.count("*").alias(name))
    branches, loops = branch_regions(blocks, edges), loop_regions(blocks, edges)
    n_regions = lambda df, name: df.groupBy(*KEY).agg(F.countDistinct("region").alias(name))
    under = edges.filter("kind in ('cond_true', 'cond_false')").select(*KEY, F.col("dst").alias("block")).distinct()
    each = by_block.groupBy(*KEY, "block").agg(F.count("*").alias("n"), F.max("calls").alias("call"), F.max(F.when(F.col("mem_writes") > 0, 1).otherwise(0)).alias("write"), F.max("returns_negative").alias("negative"))
    under = under.join(each, [*KEY, "block"]).groupBy(*KEY).agg(F.max("call").alias("has_call_under_branch"), F.max("write").alias("has_write_under_branch"), F.max(F.when((F.col("n") <= SHORT_BLOCK) & (F.col("negative") == 1), 1).otherwise(0)).alias("has_short_error_return"))
    # blocks that return, and those that jump to one: what their last rows set
    ends = by_block.groupBy(*KEY, "block").agg(F.max_by("opcode", "at").alias("last"), F.slice(F.sort_array(F.collect_list(F.struct("at", "returns_zero", "returns_negative")), asc=False), 1, TAIL).alias("tail"))
    returns = ends.filter(F.col("last").isin(*RETURNS)).select(*KEY, "block")
    to_return = edges.filter("kind = 'jump'").join(returns.withColumnRenamed("block", "dst"), [*KEY, "dst"], "left_semi").select(*KEY, F.col("src").alias("block"))
    tails = ends.join(returns.unionByName(to_return).distinct(), [*KEY, "block"], "left_semi").groupBy(*KEY).agg(*(F.max(F.array_max(f"tail.returns_{k}")).alias(f"has_return_{k}") for k in ("zero", "negative")))
    single = blocks.select(*KEY, F.col("block").alias("region"), "block")
    parts = [
        whole, counted(blocks, "num_blocks"), counted(edges, "num_edges"), under, tails, n_regions(branches, "num_branch_regions"), n_regions(loops, "num_loop_regions"),
        _block_maxima(single, by_block, edges), region_measures(branches, by_block, edges, "branch_region_max_"), region_measures(loops, by_block, edges, "loop_region_max_"),
    ]
    names = cfg.select("target_id", F.col("name").alias("function"))
    wide = reduce(lambda a, b: a.join(b, KEY, "left"), parts, names)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    some = lambda c: (zero(c) > 0).cast("bigint")
    table_like = (zero("num_indirect_jumps") > 0) & (zero("num_scaled_index_memory_accesses") > 0) & (zero("num_rip_relative_accesses") > 0)
    wide = wide.withColumns({"has_loop": some("num_loop_regions"), "has_loop_region": some("num_loop_regions"), "has_branch_region": some("num_branch_regions"), "num_block_regions": zero("num_blocks"), "has_block_region": some("num_blocks"), "has_jump_table_like_pattern": table_like.cast("bigint")})
    return wide.select(*KEY, *(zero(c).cast("bigint").alias(c) for c in measure_names()))


def _block_maxima(single: DataFrame, by_block: DataFrame, edges: DataFrame) -> DataFrame:
    """Region maxima of single blocks, whose successors and predecessors are all their edges, loops on themselves too."""
    rows = region_measures(single, by_block, edges, "region_max_").drop("region_max_num_successors", "region_max_num_predecessors")
    known = lambda c: single.select(*KEY, F.col("block").alias(c))
    degree = lambda c, name: edges.join(known(c), [*KEY, c], "left_semi").groupBy(*KEY, c).agg(F.count("*").alias("n")).groupBy(*KEY).agg(F.max("n").alias(name))
    return rows.join(degree("src", "region_max_num_successors"), KEY, "left").join(degree("dst", "region_max_num_predecessors"), KEY, "left")


def measure_names() -> list[str]:
    """The 125 measures in their order."""
    return [*FUNCTION_MEASURES, *(f"{p}region_max_{s}" for p in ("", "branch_", "loop_") for s in REGION_SUFFIXES), *REGION_COUNTS]
