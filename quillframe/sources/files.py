"""Scans of folders of JSON, JSON-lines and text files.

Every scan is a distributed read: a row per file (or line) with its path, and the value as a variant
where it is JSON. Files come in no order; sort by path where one is wanted. Defined cases: an empty
folder raises Spark's path error, a file that is no JSON has a null variant, blank files see scan_json.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.parse import json_value
from quillframe.functions.text import trimmed


#: Two code points that are no characters and so stand in no text.
ASIDE = "\ufdd0\ufdd1"


def scan_text(spark: SparkSession, root: str, name: str = "*", recursive: bool = True) -> DataFrame:
    """path, file, folder (the one that holds the file) and value, the whole text, of files whose name matches a glob."""
    path = F.col("_metadata.file_path")
    files = spark.read.option("pathGlobFilter", name).option("recursiveFileLookup", recursive).text(root, wholetext=True)
    return files.select(path.alias("path"), F.col("_metadata.file_name").alias("file"), F.element_at(F.split(path, "/"), -2).alias("folder"), "value")


def scan_trimmed(spark: SparkSession, root: str, name: str = "*.txt") -> DataFrame:
    return scan_text(spark, root, name).withColumn("value", trimmed(F.col("value")))


def scan_json(spark: SparkSession, root: str, name: str = "*.json", lenient: bool = False) -> DataFrame:
    """path, file, folder and v, a variant; null where the text is no JSON.

    lenient: bytes that are not UTF-8 are dropped, and a blank file is {}.
    """
    text = F.col("value")
    if lenient:  # U+FFFD of the text itself stands aside while bytes that are no text become U+FFFD and go
        text = F.replace(F.make_valid_utf8(F.replace(text, F.lit("\ufffd"), F.lit(ASIDE))), F.lit("\ufffd"), F.lit(""))
        text = F.replace(text, F.lit(ASIDE), F.lit("\ufffd"))
        text = F.when(trimmed(text) == "", F.lit("{}")).otherwise(text)
    return scan_text(spark, root, name).select("path", "file", "folder", json_value(text).alias("v"))


def in_named_folders(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The files of this name one level below root, with the folder that has each."""
    return scan_text(spark, f"{root}/*/{name}", recursive=False)


def folders(files: DataFrame) -> DataFrame:
    """The folders that hold a file; Spark does not see empty ones, see all_folders()."""
    return files.select("folder").distinct()


def all_folders(spark: SparkSession, root: str) -> DataFrame:
    """folder and path of every folder right below root, empty ones too, in order of names. The file system lists
    one level, page by page, which is no work on files; the driver holds as many names as there are papers."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    listed, found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatusIterator(at), []
    while listed.hasNext():
        entry = listed.next()
        if entry.isDirectory():
            found.append((entry.getPath().getName(), entry.getPath().toString()))
    return spark.createDataFrame(sorted(found), "folder string, path string")


def tagged(files: DataFrame, tag: str) -> DataFrame:
    """Files whose name holds tag."""
    return files.where(F.col("file").contains(tag))


def tagged_or_exact(files: DataFrame, exact: str, tag: str) -> DataFrame:
    """The files named exact, where there are any, else those whose name holds tag; none below a folder ending in _detect or _eval."""
    kept = files.where(~F.exists(F.split("path", "/"), lambda part: part.rlike("(_detect|_eval)$")))
    some = kept.agg(F.coalesce(F.bool_or(F.col("file") == exact), F.lit(False)).alias("__exact"))  # one row
    wanted = F.when(F.col("__exact"), F.col("file") == exact).otherwise(F.col("file").contains(tag))
    return kept.join(some).where(wanted).drop("__exact")


def matching(files: DataFrame, **parts: str | None) -> DataFrame:
    """Files whose columns equal the parts given; None asks nothing of a column."""
    for column, wanted in parts.items():
        if wanted is not None:
            files = files.where(F.col(column) == wanted)
    return files


def preferred(files: DataFrame, names: list[str]) -> DataFrame:
    """Of each folder, the file that stands first in names; folders with none are left out."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("file"))
    return files.where(rank > 0).groupBy("folder").agg(F.min_by(F.struct("path", "file"), rank).alias("f")).select("folder", "f.*")


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def content(v: Column) -> Column:
    """The blocks of a document, at content or at paper.content."""
    kind = "array<variant>"
    return F.coalesce(F.try_variant_get(v, "$.content", kind), F.try_variant_get(v, "$.paper.content", kind))


def samples(docs: DataFrame, keys: list[str]) -> DataFrame:
    """path, index (from 0), v and reason of the elements of JSON arrays; reason is null for objects that have all keys."""
    rows = docs.select("path", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("index", "v"))
    lacks = F.concat_ws(", ", *[F.when(F.try_variant_get("v", f"$.{k}", "string").isNull(), F.lit(k)) for k in keys])
    return rows.withColumn("reason", F.when(~is_object(F.col("v")), "not an object").when(lacks != "", F.concat(F.lit("missing "), lacks)))


def scan_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """v, a variant, of each line that is a JSON object; other lines are passed over."""
    lines = spark.read.text(path).select(json_value(F.col("value")).alias("v"))
    return lines.where(is_object(F.col("v")))


def first_in_order(files: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n files in an order; the limit is what is asked for."""
    return files.orderBy(*order).limit(n)
