"""Sinks: JSON, JSON lines, CSV, Parquet, text, and tables that take a run once or in place of another."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillframe.functions.text import indented_json, trimmed


def write_json(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """JSON lines, null fields kept, a folder for each value of the columns in by; mode append adds files."""
    out = df.write.mode(mode).option("ignoreNullFields", "false")
    (out.partitionBy(*by) if by else out).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def write_text(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_files(df: DataFrame, root: str, folder: str, name: str, value: str) -> None:
    """A text file a row in a folder of the columns folder and name: root/folder=../name=..txt, from all tasks at once.

    Spark's writer opens a folder and two files a row and lists them one task each. Where root is a path of a file
    system that all executors mount, tasks write the files themselves, each put in place whole, so that a task
    that runs again changes nothing. Other roots have Spark's files, one below root/folder=../name=../. Values
    must be fit for names of files.
    """
    rows = df.select(*[F.col(c).cast("string") for c in (folder, name, value)]).repartition(4 * df.sparkSession.sparkContext.defaultParallelism, name)
    if re.match(r"(?!file:)\w[\w+.-]+:", root):
        rows.write.partitionBy(folder, name).text(root)
        return
    at = unquote(re.sub(r"^file:/*", "/", root)) if root.startswith("file:") else root

    def run(part: Iterator[Row]) -> None:
        for of, own, text in part:
            os.makedirs(within := f"{at}/{folder}={of}", exist_ok=True)
            whole, half = f"{within}/{name}={own}.txt", f"{within}/_{own}.{os.getpid()}"
            with open(half, "w", encoding="utf-8", newline="") as file:
                file.write(text + "\n")
            os.replace(half, whole)

    os.makedirs(at)
    rows.foreachPartition(run)


def write_parquet(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Snappy Parquet; an existing table is kept unless overwrite, and no rows are an error."""
    if df.isEmpty():  # a look at one row, before anything is replaced
        raise ValueError("no rows to write")
    df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "snappy").parquet(path)


def split_rejects(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, index and reason of the others) of sources.files.samples()."""
    return samples.where("reason is null").drop("reason"), samples.where("reason is not null").select("index", "reason")


def with_run(old: DataFrame, new: DataFrame, keys: list[str], replace: bool = True) -> DataFrame:
    """old and new together; replace: without the rows of old that have the keys of new. Null keys match no row."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti") if replace else old
    return kept.unionByName(new, allowMissingColumns=True)


def once(existing: DataFrame, df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows of df to append: their keys are not in existing, and their value is not blank."""
    return df.where(trimmed(F.col(value)) != "").join(existing.select(*keys).distinct(), keys, "left_anti")


def write_page_report(rows: DataFrame, path: str) -> None:
    """rows (folder, pdf_path, pages) as CSV at path/pages, and the counts of all, readable and unreadable papers as JSON at path/summary."""
    write_csv(rows.select("folder", "pdf_path", "pages"), f"{path}/pages")
    readable = F.col("pages") > 0
    write_json(rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(readable).alias("readable"), F.count_if(~readable).alias("unreadable")), f"{path}/summary", mode="overwrite")


def write_papers(df: DataFrame, path: str, key: str, v: str, mode: str = "errorifexists") -> None:
    """One file a paper, in a folder of its key: the variant v as JSON with a field a line."""
    rows = df.select(key, indented_json(F.col(v)).alias("value"))
    rows.repartition(key).write.mode(mode).partitionBy(key).text(path)
