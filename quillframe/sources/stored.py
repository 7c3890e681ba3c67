"""Stored runs of papers: a table that is updated in place, whole or not at all.

A table is a folder of versions. Rows lie in buckets by a hash of the paper; an update reads and writes the
buckets of its papers only, into a folder of its own, and then puts a list of all buckets' folders in place
with one rename that fails if the version exists. Until then readers see the version before, so a writer
that dies leaves files that no version names, and two writers of one version cannot both win: the second
gets an error and may run again. Each run has pos, its place among its paper's runs.

The list of a version has a line a bucket, a parameter of the table, so the driver reads as much at any size.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

POS, BUCKET = "pos", "__bucket"
#: Ways in which new runs meet old ones, see merged().
HOW = ("first", "all", "again", "keep", "fresh", "remove", "append")


class Conflict(Exception):
    """Another writer has stored this version."""


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions that are stored, the oldest first."""
    fs, at = _files(spark, f"{root}/versions")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _listed(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{root}/versions/{version:010}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, root: str, version: int, listed: dict) -> None:
    jvm = spark._jvm
    fs, part = _files(spark, f"{root}/versions/_{version}-{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(json.dumps(listed).encode()))
    out.close()
    end = jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{version:010}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(part, end, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:  # the JVM's, whose class depends on the file system
        fs.delete(part, False)
        raise Conflict(f"version {version} of {root} exists") from error


def _write(rows: DataFrame, root: str, version: int) -> str:
    """Writes rows with a bucket to a folder that no version names yet."""
    name = f"data/{version:010}-{uuid.uuid4().hex}"
    rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{root}/{name}")
    return name


def create(runs: DataFrame, root: str, paper: str, order: list[str], buckets: int = 64) -> int:
    """Stores runs as version 1 of a new table: pos counts a paper's runs from 0 in this order."""
    if POS in runs.columns or BUCKET in runs.columns:
        raise ValueError(f"the input has a column {POS} or {BUCKET}")
    placed = runs.withColumn(POS, F.row_number().over(Window.partitionBy(paper).orderBy(*order)) - 1)
    name = _write(placed.withColumn(BUCKET, _bucket(paper, buckets)), root, 1)
    held = {str(b): name for b in range(buckets)}
    _commit(runs.sparkSession, root, 1, {"paper": paper, "schema": json.loads(placed.schema.json()), "buckets": held})
    return 1


def _bucket(paper: str, buckets: int):
    return F.pmod(F.xxhash64(paper), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, root: str, listed: dict, wanted: list[int] | None = None) -> DataFrame:
    """The rows of the wanted buckets, or of all, from the folders that a version lists."""
    schema = StructType.fromJson(listed["schema"])
    by_folder: dict[str, list[int]] = {}
    for b, name in listed["buckets"].items():
        if wanted is None or int(b) in wanted:
            by_folder.setdefault(name, []).append(int(b))
    out = spark.createDataFrame([], schema)
    for name, own in by_folder.items():  # as many as updates that still hold a bucket
        part = spark.read.schema(StructType([*schema.fields]).add(BUCKET, IntegerType())).parquet(f"{root}/{name}")
        out = out.unionByName(part.where(F.col(BUCKET).isin(own)).drop(BUCKET))
    return out


def load(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The runs of a version, or of the last one."""
    return _rows(spark, root, _listed(spark, root, versions(spark, root)[-1] if version is None else version))


def merged(old: DataFrame, new: DataFrame, paper: str, keys: list[str], order: list[str], how: str) -> DataFrame:
    """old, with pos, and new in one table; runs of the same paper and keys meet, nulls being equal.

    first: a new run takes the place of the first old one it meets, and the others stay. all: it takes the
    place of each of them. again: old ones that are met go. keep: new runs that meet none are added, the
    others are not. fresh: all old runs of the new runs' papers go. remove: old ones that are met go, and no
    new ones come. append: nothing meets. New runs that take no place follow the paper's others in order. Of
    new runs that meet each other the last counts, except in append.
    """
    if how not in HOW:
        raise ValueError(f"{how} is none of {HOW}")
    columns, same, all_of = old.columns, Window.partitionBy(paper, *keys), Window.partitionBy(paper)
    rows = old.withColumn("__new", F.lit(False)).unionByName(new.withColumns({POS: F.lit(None).cast("int"), "__new": F.lit(True)}))
    last = F.row_number().over(Window.partitionBy(paper, *keys, "__new").orderBy(*[F.desc(c) for c in order])) == 1
    places = F.array_sort(F.collect_list(POS).over(same))
    rows = rows.withColumns({"__met": F.max("__new").over(same), "__paper": F.max("__new").over(all_of), "__top": F.coalesce(F.max(POS).over(all_of), F.lit(-1)), "__last": last, "__places": places})
    met, none = F.col("__met"), F.size("__places") == 0
    stays = {"first": ~met | (F.col(POS) != F.get("__places", F.lit(0))), "fresh": ~F.col("__paper"), "keep": F.lit(True), "append": F.lit(True)}.get(how, ~met)
    comes = F.lit(False) if how == "remove" else F.lit(True) if how == "append" else F.col("__last") & none if how == "keep" else F.col("__last")
    rows = rows.where(F.when(F.col("__new"), comes).otherwise(stays))
    taken = {"first": F.slice("__places", 1, 1), "all": F.col("__places")}.get(how, F.slice("__places", 1, 0))
    rows = rows.withColumn("__at", F.explode_outer(F.when(F.col("__new"), taken).otherwise(F.array(POS))))
    turn = F.row_number().over(Window.partitionBy(paper, F.col("__at").isNull()).orderBy(*order))
    return rows.withColumn(POS, F.coalesce("__at", F.col("__top") + turn).cast("int")).select(*columns)


def stage(new: DataFrame, root: str, keys: list[str], order: list[str], how: str = "first") -> tuple[int, dict]:
    """Writes the buckets of merged() for the next version, and returns its number and list; no reader sees them yet. new is read twice."""
    spark = new.sparkSession
    version = versions(spark, root)[-1]
    listed = _listed(spark, root, version)
    paper, n = listed["paper"], len(listed["buckets"])
    touched = [r[0] for r in new.select(_bucket(paper, n).alias("b")).distinct().collect()]  # at most a row a bucket
    out = merged(_rows(spark, root, listed, touched), new, paper, keys, order, how)
    name = _write(out.withColumn(BUCKET, _bucket(paper, n)), root, version + 1)
    listed["buckets"] |= {str(b): name for b in touched}
    return version + 1, listed


def update(new: DataFrame, root: str, keys: list[str], order: list[str], how: str = "first", tag: str | None = None) -> int:
    """Stores merged() as the next version and returns its number.

    tag names the update: one that the table has taken already, in any version, is not taken again, so a
    writer that does not know whether it ended may run again.
    """
    spark = new.sparkSession
    held = versions(spark, root)[-1]
    if tag is not None and tag in _listed(spark, root, held).get("tags", []):
        return held
    version, listed = stage(new, root, keys, order, how)
    listed["tags"] = [*listed.get("tags", []), *([tag] if tag is not None else [])]
    _commit(spark, root, version, listed)
    return version


def prune(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Deletes all but the last versions, and the folders that none of these names. No writer may be at work."""
    left = versions(spark, root)[-keep:]
    named = {name for v in left for name in _listed(spark, root, v)["buckets"].values()}
    fs, at = _files(spark, f"{root}/data")
    for f in fs.listStatus(at):
        if f"data/{f.getPath().getName()}" not in named:
            fs.delete(f.getPath(), True)
    for v in versions(spark, root)[:-keep]:
        fs.delete(_files(spark, f"{root}/versions/{v:010}.json")[1], False)
