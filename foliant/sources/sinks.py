"""Results as files: JSON and Parquet by table, tables as CSV, HTML or markdown, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tables


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One JSON object a row; nulls are kept out."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_text(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("errorifexists").text(path)


def table_files(found: DataFrame) -> DataFrame:
    """(doc_id, table_id, csv, html, markdown) of each table."""
    return found.select("doc_id", "table_id", tables.csv(F.col("rows")).alias("csv"), tables.html(F.col("rows")).alias("html"), tables.markdown(F.col("rows")).alias("markdown"))


def tables_index(found: DataFrame, preview: int = 4) -> DataFrame:
    """(doc_id, html): a list of a document's tables with their first rows (the preview is the index's feature)."""
    one = F.concat(F.lit("<h2>"), "table_id", F.lit("</h2>"), tables.html(F.slice("rows", 1, preview)))
    return found.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_id", one.alias("h")))), lambda x: x["h"]), "\n").alias("html"))


def write_results(results: dict[str, DataFrame], path: str) -> None:
    """Every result of a run below path, one folder a name."""
    for name, df in results.items():
        write_parquet(df, f"{path}/{name}")
