"""Writers. None of them overwrites what it reads: patched tables are new versions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def feature_document(features: DataFrame, path: str) -> None:
    """(target_id, function, feature, value) as JSON lines, one program a row, maps nested. A program's functions go to
    one row because the document has them so."""
    inner = features.groupBy("target_id", "function").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "value")))).alias("xs"))
    doc = inner.groupBy("target_id").agg(F.map_from_entries(F.collect_list(F.struct("function", "xs"))).alias("functions"))
    doc.write.mode("errorifexists").json(path)


def json_sorted(df: DataFrame, path: str) -> None:
    """JSON lines with keys in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").json(path)


def feature_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV with a header and a fixed column order; missing columns and nulls are 0."""
    cols = [F.coalesce(F.col(c), F.lit(0)).alias(c) if c in df.columns else F.lit(0).alias(c) for c in order]
    df.select("target_id", "function", *cols).write.mode("errorifexists").csv(path, header=True)


def by_split(df: DataFrame, path: str) -> None:
    """Parquet partitioned by split."""
    df.write.mode("errorifexists").partitionBy("split").parquet(path)


def split_profiles(df: DataFrame, path: str, profiles: dict[str, list[str]]) -> None:
    """CSV with a header, a folder for each profile (its columns, after target_id and function) and in it one for each
    split."""
    for name, columns in profiles.items():
        df.select("split", "target_id", "function", *columns).write.mode("errorifexists").partitionBy("split").csv(f"{path}/{name}", header=True)


def replace_targets(df: DataFrame, path: str) -> None:
    """Replace the partitions of the targets in ``df`` and leave the others: delete by key, then append."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target_id").parquet(path)


def patched(base: DataFrame, patch: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``base`` with ``columns`` taken from ``patch`` where it has the key, else as they were, or 0 if they are new."""
    renamed = patch.select(*key, *(F.col(c).alias(f"__new_{c}") for c in columns))
    joined = base.join(renamed, key, "left")
    keep = [F.coalesce(f"__new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns]
    return joined.select(*keep, *(F.coalesce(f"__new_{c}", F.lit(0)).alias(c) for c in columns if c not in base.columns))


def manifest(df: DataFrame, by: list[str]) -> str:
    """Counts by each column and overall as JSON text: as many rows come to the driver as there are values."""
    out = {"rows": df.count()}
    for c in by:
        out[c] = {str(r[c]): r["count"] for r in df.groupBy(c).count().orderBy(c).collect()}
    return json.dumps(out, sort_keys=True, indent=1)


def markdown_report(df: DataFrame, title: str) -> str:
    """A small aggregate as a Markdown table, whole: rows are fetched a partition at a time."""
    head = f"## {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join(str(x) for x in r) + " |\n" for r in df.toLocalIterator())


def detail_report(summary: DataFrame, details: DataFrame, title: str, section: str) -> str:
    """A Markdown report: the table of all sections, then a table of the details of each, in the order of ``section``."""
    parts, last = [markdown_report(summary.orderBy(section), title)], None
    columns = [c for c in details.columns if c != section]
    for r in details.orderBy(section, *columns).toLocalIterator():
        if r[section] != last:
            last = r[section]
            parts.append(f"\n### {last}\n\n| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n")
        parts.append("| " + " | ".join(str(r[c]) for c in columns) + " |\n")
    return "".join(parts)


def save_model(model, path: str, spec: dict) -> None:
    """A fitted pipeline and its specification (feature order, threshold) beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(spec, sort_keys=True),)], "spec string").write.mode("overwrite").text(f"{path}/spec")
