"""Sinks: partitioned files, triples of results, reports. Lists and maps become JSON text only here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlens.functions import text as T


def cells_as_text(df: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON, for files that hold only text and numbers."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    return df.withColumns({c: F.to_json(c) for c in nested})


def write_by_group(df: DataFrame, group: str, path: str, kind: str = "parquet") -> None:
    """One folder per group, named by its slug. Rows are spread by group and a hash of the row, so that a large group is
    written by several tasks."""
    keyed = df.withColumn("group_slug", F.coalesce(F.nullif(T.slug(F.col(group)), F.lit("")), F.lit("none")))
    keyed.write.mode("overwrite").partitionBy("group_slug").format(kind).save(path)


def write_triple(df: DataFrame, keep: str, groups: Sequence[str], path: str) -> DataFrame:
    """``all``, ``kept`` and ``summary``; the first is written once and the others are made from it. Returns the summary."""
    cells_as_text(df).write.mode("overwrite").parquet(f"{path}/all")
    every = df.sparkSession.read.parquet(f"{path}/all")
    every.filter(F.col(keep)).write.mode("overwrite").parquet(f"{path}/kept")
    summary = every.groupBy(*groups).agg(F.count("*").alias("total"), F.sum(F.col(keep).cast("int")).alias("kept"), F.round(100 * F.avg(F.col(keep).cast("int")), 2).alias("pct"))
    summary.write.mode("overwrite").parquet(f"{path}/summary")
    return df.sparkSession.read.parquet(f"{path}/summary")


def write_csv(df: DataFrame, path: str, places: int = 6) -> None:
    """CSV with numbers to so many places and blanks for nulls."""
    numbers = {c: T.number_text(F.col(c), places) for c, t in df.dtypes if t in ("double", "float")}
    cells_as_text(df.withColumns(numbers)).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def exported(df: DataFrame, drop: Sequence[str] = (), rename: Mapping[str, str] | None = None, first: Sequence[str] = ()) -> DataFrame:
    """Columns dropped, renamed and put in order for export; unknown names are ignored."""
    kept = df.drop(*drop).withColumnsRenamed(dict(rename or {}))
    front = [c for c in first if c in kept.columns]
    return kept.select(*front, *[c for c in kept.columns if c not in front])


def swap_id(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """One id for another; reading fails if the new one was there before."""
    clash = F.assert_true(F.coalesce(F.col(column) != new, F.lit(True)), F.lit(f"{new} exists"))
    return df.withColumn(column, F.when(clash.isNotNull(), F.col(column)).when(F.col(column) == old, new).otherwise(F.col(column)))


def write_report(path: str, title: str, tables: Mapping[str, DataFrame], most_rows: int = 200) -> str:
    """A Markdown report of small aggregates; tables longer than ``most_rows`` are refused."""
    parts = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name}: more than {most_rows} rows")
        parts += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        parts += ["| " + " | ".join("" if v is None else str(v).replace("|", "/").replace("\n", " ") for v in r) + " |" for r in rows]
        parts.append("")
    text = "\n".join(parts)
    Path(path).write_text(text)
    return text


def outputs_present(paths: Sequence[str]) -> list[tuple[str, bool]]:
    """Whether each expected output is there."""
    return [(p, Path(p).exists()) for p in paths]
