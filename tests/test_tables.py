from strandline.functions import tables
from tests.test_sources import elf


def test_table_functions(spark):
    tables.register(spark)
    rows = spark.sql("select n, place, token from values ('getUserID_2x'), (null), ('') as t(n), lateral name_tokens(n)").collect()
    assert [(r.place, r.token) for r in rows] == [(0, "get"), (1, "user"), (2, "id"), (3, "2x")]
    (row,) = spark.sql("select * from c_functions('int f(int a)\n{ return a; }')").collect()
    assert (row.function, row.first_line, row.last_line) == ("f", 2, 2)


def test_data_sources(spark, tmp_path):
    tables.register(spark)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a").write_bytes(elf())
    (tmp_path / "d" / "l.txt").write_text("a.c 3 0x10\nnoise\nb.c 4 0x20\n")
    got = spark.read.format("elf_sections").load(str(tmp_path)).filter("name = '.rodata'").collect()
    assert [(r.ord, r.vma, r.size) for r in got] == [(1, 0x4000, 32)]
    lines = spark.read.format("line_table").load(str(tmp_path / "d" / "l.txt")).collect()
    assert [(r.place, r.file, r.line, r.pc) for r in lines] == [(0, "a.c", 3, 16), (2, "b.c", 4, 32)]
    (tmp_path / "none").mkdir()
    assert spark.read.format("elf_sections").load(str(tmp_path / "none")).count() == 0
