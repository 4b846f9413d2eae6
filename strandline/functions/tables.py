"""Table functions and data sources that SQL can name once they are registered."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from strandline.operators import kernels


@udtf(returnType="place int, token string")
class NameTokens:
    """``name_tokens(name)``: the words of a camel- or snake-case name, lower-cased, numbered from 0; none for null."""

    def eval(self, name: str):
        spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name or "")
        yield from enumerate(re.findall(r"[a-z0-9]+", spaced.lower()))


@udtf(returnType="function string, first_line int, last_line int, body string")
class CFunctions:
    """``c_functions(source)``: the functions of a C text; none for null."""

    def eval(self, source: str):
        yield from kernels.c_functions(source or "")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Files(DataSourceReader):
    """Reads the files under a folder that executors see, a task each."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        found = [self.path] if os.path.isfile(self.path) else sorted(p for p in glob.glob(f"{self.path}/**", recursive=True) if os.path.isfile(p))
        return [_File(p) for p in found] or [_File("")]


class _ElfReader(_Files):
    def read(self, partition: _File) -> Iterator[tuple]:
        from strandline.sources.artifacts import parse_sections

        if partition.path:
            with open(partition.path, "rb") as f:
                yield from ((partition.path, *s) for s in parse_sections(f.read()))


class ElfSections(DataSource):
    """``spark.read.format("elf_sections").load(folder)``: the sections of the ELF files under a folder."""

    @classmethod
    def name(cls) -> str:
        return "elf_sections"

    def schema(self) -> str:
        return "path string, ord int, name string, vma bigint, size bigint, file_off bigint"

    def reader(self, schema) -> DataSourceReader:
        return _ElfReader(self.options["path"])


class _LineReader(_Files):
    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.path:
            with open(partition.path, encoding="utf-8", errors="replace") as f:
                for k, line in enumerate(f):
                    if m := re.match(r"(\S+\.\w+)\s+(\d+)\s+0x([0-9a-f]+)", line):
                        yield partition.path, k, m[1], int(m[2]), int(m[3], 16)


class LineTable(DataSource):
    """``spark.read.format("line_table").load(folder)``: the rows of dumped line tables under a folder."""

    @classmethod
    def name(cls) -> str:
        return "line_table"

    def schema(self) -> str:
        return "path string, place int, file string, line int, pc bigint"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the table functions and data sources known to a session."""
    spark.udtf.register("name_tokens", NameTokens)
    spark.udtf.register("c_functions", CFunctions)
    spark.dataSource.register(ElfSections)
    spark.dataSource.register(LineTable)
