"""Readers of analysis artifacts as DataFrames. Paths go to Spark, so any store that Spark reads will do."""

from __future__ import annotations

import struct
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.operators import kernels
from strandline.operators.relational import by_precedence

INSN = "function string, instruction string, pc string, size int"
CFG = "functions array<struct<name:string,instructions:array<struct<address:string,opcode:string,operands:array<string>,asm:string,kind:string,target:string>>,basic_blocks:array<struct<id:string,instructions:array<string>>>,cfg_edges:array<struct<source:string,src:string,target:string,target_address:string,type:string>>>>"
DWARF = "functions map<string,struct<name:string,params:array<struct<name:string,type:string,is_pointer:boolean>>>>, structs map<string,struct<members:array<struct<name:string,offset:bigint,byte_size:bigint,is_pointer:boolean,pointee:string,type:string>>>>"
DFG = "dfg struct<nodes:array<struct<id:string,opcode:string,asm:string,uses:struct<registers:array<struct<register:string>>>>>,edges:array<struct<source:string,target:string>>>"
FEATURES = "map<string,map<string,map<string,int>>>"
PLT = (".plt", ".plt.sec")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, line) of text files: ``seq`` rises with a line's place in its file. Files are split among tasks, and a
    line is numbered from where its split begins, so numbers may leave gaps between splits, never within one."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    first = lines.groupBy("path", "start").agg(F.min("id").alias("first"))  # a row for each split
    # a line has a byte at least, so a split that begins at byte b has fewer lines before it than b
    met = lines.join(first, ["path", "start"])
    return met.select("path", (F.col("start") + F.col("id") - F.col("first")).alias("seq"), F.col("value").alias("line"))


def instructions(spark: SparkSession, path: str, target_id: str, artifact: str = "main", keep_plt: bool = False) -> DataFrame:
    """JSONL of instructions as (target_id, artifact, function, seq, pc, size, instruction), calls with their ``callee``.

    ``seq`` rises with the row's place in its file, which is all the order that there is; files are split among tasks.
    Lines that are not JSON, or without a function, are left out; pc is parsed from hex as unsigned below 2**63.
    """
    lines = ordered_lines(spark, path)
    rec = lines.select("seq", F.from_json("line", INSN).alias("r")).filter("r.function is not null")
    out = rec.select(
        F.lit(target_id).alias("target_id"), F.lit(artifact).alias("artifact"), F.col("r.function").alias("function"), F.col("seq").cast("bigint").alias("seq"),
        F.conv(F.regexp_replace("r.pc", "^0x", ""), 16, 10).cast("bigint").alias("pc"), F.col("r.size").alias("size"), F.col("r.instruction").alias("instruction"),
    )
    out = out.withColumn("callee", F.when(F.startswith("instruction", F.lit("call")), S.callee(F.col("instruction"))))
    return out if keep_plt else out.filter(~F.col("function").isin(*PLT))


def call_edges(insns: DataFrame) -> DataFrame:
    """Distinct (target_id, src, dst) between functions of one target; tail jumps are not calls."""
    known = insns.select("target_id", F.col("function").alias("dst")).distinct()
    calls = insns.filter("callee is not null").select("target_id", F.col("function").alias("src"), F.col("callee").alias("dst")).distinct()
    return calls.join(known, ["target_id", "dst"], "left_semi").select("target_id", "src", "dst")


def cfg_functions(spark: SparkSession, path: str) -> DataFrame:
    """(name, instructions, basic_blocks, cfg_edges) of a CFG document; names with @ or a leading dot are left out and the
    first definition of a name wins."""
    rows = spark.read.schema(CFG).json(path, multiLine=True).select(F.posexplode("functions").alias("k", "f"))
    rows = rows.filter("f.name is not null and not contains(f.name, '@') and not startswith(f.name, '.')")
    return rows.groupBy("f.name").agg(F.min_by("f", "k").alias("f")).select("f.*")


def dwarf_names(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct function names of one or more debug-fact documents."""
    docs = (spark.read.schema(DWARF).json(p, multiLine=True) for p in paths)
    return reduce(DataFrame.unionByName, docs).select(F.explode(F.map_values("functions")).alias("f")).select("f.name").filter("name is not null").distinct()


def dwarf_params(spark: SparkSession, path: str) -> DataFrame:
    """(name, params) by function; of names that repeat the first id counts."""
    rows = spark.read.schema(DWARF).json(path, multiLine=True).select(F.explode("functions").alias("id", "f"))
    return rows.groupBy("f.name").agg(F.min_by("f.params", "id").alias("params"))


def struct_members(spark: SparkSession, path: str) -> DataFrame:
    """(struct, ordinal, name, offset, byte_size, is_pointer, pointee, type) in document order."""
    rows = spark.read.schema(DWARF).json(path, multiLine=True).select(F.explode("structs").alias("struct", "s"))
    return rows.select("struct", F.posexplode("s.members").alias("ordinal", "m")).select("struct", "ordinal", "m.*")


def dfg(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a data-flow document."""
    doc = spark.read.schema(DFG).json(path, multiLine=True)
    nodes = doc.select(F.explode("dfg.nodes").alias("n")).select("n.id", "n.opcode", "n.asm", F.col("n.uses.registers.register").alias("registers"))
    return nodes, doc.select(F.explode("dfg.edges").alias("e")).select("e.source", "e.target")


def feature_document(spark: SparkSession, path: str) -> DataFrame:
    """(target_id, function, feature, value) of a program-function-feature document."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", FEATURES).alias("d"))
    return doc.select(F.explode("d").alias("target_id", "fs")).select("target_id", F.explode("fs").alias("function", "xs")).select("target_id", "function", F.explode("xs").alias("feature", "value"))


def wide(features: DataFrame, order: list[str]) -> DataFrame:
    """One row a function and one column a feature, in order; missing is 0. The names are given, so no pass finds them."""
    cols = [F.coalesce(F.max(F.when(F.col("feature") == c, F.col("value"))), F.lit(0)).alias(c) for c in order]
    return features.groupBy("target_id", "function").agg(*cols)


def feature_csv(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """The wide CSV of strings as (target_id, function, doubles)."""
    raw = spark.read.csv(path, header=True)
    return raw.select("target_id", "function", *(F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(0.0)).alias(c) if c in raw.columns else F.lit(0.0).alias(c) for c in order))


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of several paths that is there, in any store that Spark reads; None if none is."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(conf).exists(place):
            return path
    return None


def review_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """(function, verdict) of the first of ``paths`` that is there: the first column, and source_verdict or else the
    second. No rows if none is there."""
    path = first_existing(spark, list(paths))
    if path is None:
        return spark.createDataFrame([], "function string, verdict string")
    raw = spark.read.csv(path, header=True)
    verdict = "source_verdict" if "source_verdict" in raw.columns else raw.columns[1]
    return raw.select(F.col(f"`{raw.columns[0]}`").alias("function"), F.col(f"`{verdict}`").alias("verdict"))


def markdown_tables(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(section, idx, columns...) of pipe tables under ``## section`` headings. Rules, header rows and rows with another
    number of cells are left out; idx counts rows in a section from 1."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    order = Window.partitionBy(F.lit(0)).orderBy("line")  # one small document
    section = F.last(F.nullif(F.regexp_extract("text", r"^##\s+(.+?)\s*$", 1), F.lit("")), ignorenulls=True).over(order)
    cells = F.transform(F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.withColumn("section", section).filter("startswith(trim(text), '|') and section is not null").withColumn("cells", cells)
    rows = rows.filter((F.size("cells") == len(columns)) & ~F.col("text").rlike(r"^[\s|:-]+$") & (F.lower(F.get("cells", F.lit(0))) != columns[0].lower()))
    idx = F.row_number().over(Window.partitionBy("section").orderBy("line"))
    return rows.select("section", idx.alias("idx"), *(F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(columns)))


def largest_elf(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the largest file under ``path`` that starts as an ELF does."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    elf = files.filter(F.substring("content", 1, 4) == F.lit(b"\x7fELF"))
    return elf.agg(F.max_by(F.struct("path", "length", F.sha2("content", 256).alias("sha256")), F.struct("length", "path")).alias("b")).filter("b is not null").select("b.*")


def parse_sections(raw: bytes) -> list[tuple[int, str, int, int, int]]:
    """(ordinal, name, address, size, file offset) of a 64-bit little-endian ELF's sections; none for other bytes."""
    if raw[:6] != b"\x7fELF\x02\x01" or len(raw) < 64:
        return []
    (table,) = struct.unpack_from("<Q", raw, 40)
    each, count, names = struct.unpack_from("<HHH", raw, 58)
    if not table or table + each * count > len(raw):
        return []
    heads = [struct.unpack_from("<IIQQQQ", raw, table + k * each) for k in range(count)]
    base = heads[names][4] if names < count else 0
    return [(k, raw[base + n : raw.index(b"\0", base + n)].decode("latin-1"), addr, size, off) for k, (n, _, _, addr, off, size) in enumerate(heads)]


def elf_sections(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, name, vma, size, file_off) of each ELF file."""

    def run(batches):
        for pdf in batches:
            rows = [(p, *s) for p, c in zip(pdf.path, pdf.content, strict=True) for s in parse_sections(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "ord", "name", "vma", "size", "file_off"], dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, ord int, name string, vma bigint, size bigint, file_off bigint")


def line_table(spark: SparkSession, path: str) -> DataFrame:
    """(pc, file) of a dumped line table; the last line written for an address wins."""
    lines = ordered_lines(spark, path).withColumnRenamed("seq", "k")
    pattern = r"^(\S+\.\w+)\s+\d+\s+0x([0-9a-f]+)"
    rows = lines.filter(F.col("line").rlike(pattern)).select("k", F.regexp_extract("line", pattern, 1).alias("file"), F.conv(F.regexp_extract("line", pattern, 2), 16, 10).cast("bigint").alias("pc"))
    return rows.groupBy("pc").agg(F.max_by("file", "k").alias("file"))


def c_functions(spark: SparkSession, path: str, skip: tuple[str, ...] = ("test", "tests", "doc", "docs")) -> DataFrame:
    """(path, function, first_line, last_line, body) of the C files under ``path``, outside directories in ``skip``."""

    def run(batches):
        for pdf in batches:
            rows = [(p, *f) for p, t in zip(pdf.path, pdf.value, strict=True) for f in kernels.c_functions(t)]
            yield pd.DataFrame(rows, columns=["path", "function", "first_line", "last_line", "body"], dtype=object)

    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.c").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    files = files.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip))))
    return files.mapInPandas(run, "path string, function string, first_line int, last_line int, body string")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(target_id, function) of nested JSONL candidates that are worth it: their resolved matches."""
    schema = "target_id string, label struct<worth_attack:int>, binary_resolution struct<stage03_matches:array<struct<function:string>>>"
    rows = spark.read.schema(schema).json(path).filter("label.worth_attack = 1")
    return rows.select("target_id", F.explode("binary_resolution.stage03_matches.function").alias("function")).filter("function is not null").distinct()


def goals(spark: SparkSession, path: str) -> DataFrame:
    """(id, pc, function, target_name, target_kind, kind, category, file, line) of a goal document; no rows if it is
    missing."""
    schema = "goals array<struct<id:string,pc:string,function:string,target_name:string,target_kind:string,kind:string,category:string,source_location:struct<file:string,line:int,raw:string>>>"
    if first_existing(spark, [path]) is None:
        doc = spark.createDataFrame([], schema)
    else:
        doc = spark.read.schema(schema).json(path, multiLine=True)
    rows = doc.select(F.explode("goals").alias("g")).select("g.*")
    return rows.select(*(c for c in rows.columns if c != "source_location"), "source_location.file", "source_location.line")


def debug_tree(spark: SparkSession, path: str, target_id: str) -> DataFrame:
    """(target_id, id, parent, tag, name, type_id) of debug information extracted to JSON lines, an entry each."""
    rows = spark.read.schema("id bigint, parent bigint, tag string, name string, type_id bigint").json(path)
    return rows.select(F.lit(target_id).alias("target_id"), "id", "parent", "tag", "name", "type_id")


#: Programs whose folder stands beside the folder of all others, and where artifacts are within a program's.
BESIDE = ("nginx_1_4_0_validation",)
STAGE = "artifacts/stage_02_static_ir_cfg"
FILES = (("disassembly", "*_disassembly.jsonl"), ("cfg", "*_cfg.json"), ("dwarf", "*_dwarf.json"))


def artifact_paths(targets: DataFrame, root: str, beside: tuple[str, ...] = BESIDE) -> DataFrame:
    """(target_id, folder, disassembly, cfg, dwarf): where each target's artifacts are, by rule but for special cases."""
    root = root.rstrip("/")
    base = F.when(F.col("target_id").isin(*beside), F.lit(root.rpartition("/")[0])).otherwise(F.lit(root)) if beside else F.lit(root)
    folder = F.concat(base, F.lit("/"), F.col("target_id"), F.lit(f"/{STAGE}"))
    return targets.select("target_id", folder.alias("folder"), *(F.concat(folder, F.lit(f"/{file}")).alias(c) for c, file in FILES))


def program_metadata(spark: SparkSession, path: str, target_id: str) -> DataFrame:
    """(target_id, path, length, sha256, has_debug_info): the largest ELF under a path, its digest, and whether it has
    sections of debug information. No row if there is no ELF."""
    best = largest_elf(spark, path)
    debug = elf_sections(spark, path).groupBy("path").agg(F.max(F.startswith("name", F.lit(".debug_"))).alias("has_debug_info"))
    return best.join(debug, "path", "left").select(F.lit(target_id).alias("target_id"), "path", "length", "sha256", F.coalesce("has_debug_info", F.lit(False)).alias("has_debug_info"))


def literal_relation(spark: SparkSession, labels: dict[str, dict[str, list[str]]]) -> DataFrame:
    """(target_id, function, y) of labels given in code: {target: {"pos": [...], "neg": [...]}}."""
    rows = [(t, f, y) for t, sides in sorted(labels.items()) for y, side in ((1, "pos"), (0, "neg")) for f in sides.get(side, ())]
    return spark.createDataFrame(rows, "target_id string, function string, y int")


def named_functions(primary: list[DataFrame], auxiliary: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of primary artifacts, and of auxiliary ones for keys that no primary one has; the first source wins."""
    return by_precedence([*primary, *auxiliary], key).drop("precedence")
