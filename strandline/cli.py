"""Command line.

python -m strandline.cli list FEATURES                                  programs and how many functions each has
python -m strandline.cli scan TARGET FEATURES MODEL [THRESHOLD]         functions that the model flags, ranked
python -m strandline.cli detector ROOT PROGRAM...                       endpoints that rules find in programs
python -m strandline.cli pipeline ROOT FEATURES MODEL TRUTH PROGRAM...  screen and rules together, against ground truth

FEATURES is a Parquet table (target_id, function, features), TRUTH one of (target_id, function), ROOT the folder of the
programs' artifacts. Every row is printed, fetched a partition at a time.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import boost, scan
from strandline.session import session
from strandline.sources import artifacts

THRESHOLD = 0.38473260402679443


def screened(rows: DataFrame, model, least: float = THRESHOLD) -> DataFrame:
    """Rows that the model scores at least ``least``; features that a table lacks are 0."""
    return boost.score(model, rows, model.stages[0].getInputCols()).filter(F.col("score") >= least)


def programs(spark: SparkSession, root: str, names: list[str]) -> DataFrame | None:
    """Instructions of the programs that have artifacts; a message for each that has none."""
    paths = artifacts.artifact_paths(spark.createDataFrame([(n,) for n in names], "target_id string"), root).collect()
    found = []
    for r in paths:
        if artifacts.first_existing(spark, [r.folder]) is None:
            print(f"{r.target_id}: no artifacts")
        else:
            found.append(artifacts.instructions(spark, r.disassembly, r.target_id))
    return reduce(DataFrame.unionByName, found) if found else None


def _list(spark: SparkSession, features: str) -> int:
    for r in spark.read.parquet(features).groupBy("target_id").count().orderBy("target_id").toLocalIterator():
        print(f"{r.target_id:28s} {r['count']} functions")
    return 0


def _scan(spark: SparkSession, target: str, features: str, path: str, least: str = str(THRESHOLD)) -> int:
    rows = spark.read.parquet(features).filter(F.col("target_id") == target)
    if rows.isEmpty():
        print(f"unknown target {target}")
        return 1
    for r in screened(rows, PipelineModel.load(path), float(least)).orderBy(F.desc("score"), F.desc("function")).select("function", "score").toLocalIterator():
        print(f"{r.score:.3f}  {r.function}")
    return 0


def _detector(spark: SparkSession, root: str, *names: str) -> int:
    insns = programs(spark, root, list(names))
    if insns is None:
        return 1
    for r in scan.endpoints(insns).orderBy("target_id", "tag", "function").toLocalIterator():
        print(f"{r.target_id:28s} {r.tag:10s} {r.function}")
    return 0


def _pipeline(spark: SparkSession, root: str, features: str, path: str, truth: str, *names: str) -> int:
    known = spark.read.parquet(truth).select("target_id", "function")
    asked = list(names) or [r.target_id for r in known.select("target_id").distinct().orderBy("target_id").toLocalIterator()]
    insns = programs(spark, root, asked)
    if insns is None:
        return 1
    flagged = screened(spark.read.parquet(features).filter(F.col("target_id").isin(asked)), PipelineModel.load(path)).select("target_id", "function")
    final = scan.integrated(insns, flagged)
    counts = scan.stage_counts(insns, flagged, final, known.filter(F.col("target_id").isin(asked))).orderBy("target_id")
    print("  ".join(counts.columns))
    for r in counts.toLocalIterator():
        print("  ".join(map(str, r)))
    return 0


#: Commands with the fewest and the most arguments that each takes.
COMMANDS = {"list": (_list, 1, 1), "scan": (_scan, 3, 4), "detector": (_detector, 2, None), "pipeline": (_pipeline, 4, None)}


def main(args: list[str]) -> int:
    command, least, most = COMMANDS.get(args[0] if args else "", (None, 0, 0))
    if command is None or len(args) - 1 < least or most is not None and len(args) - 1 > most:
        print(__doc__)
        return 1
    return command(session("strandline-cli"), *args[1:])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
