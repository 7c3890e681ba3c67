"""Detection scores: matching, precision and recall, macro and micro breakdowns, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.numeric import f1, ratio, sample_std


def breakdown(df: DataFrame, paper: str, dims: list[str], matched: Column) -> DataFrame:
    """dim, value, paper_count, total, matched, rate (micro) and macro_rate for each dimension.

    Two levels of aggregation: per paper and value, then per value. Each dimension is unpivoted, so
    one pass serves all of them.
    """
    rows = df.select(paper, matched.cast("int").alias("hit"), F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])).alias("e"))
    rows = rows.select(paper, "hit", "e.dim", "e.value").where("value is not null")
    per = rows.groupBy(paper, "dim", "value").agg(F.count(F.lit(1)).alias("t"), F.sum("hit").alias("m"))
    out = per.groupBy("dim", "value").agg(F.count(F.lit(1)).alias("paper_count"), F.sum("t").alias("total"), F.sum("m").alias("matched"), F.avg(F.col("m") / F.col("t")).alias("macro_rate"))
    return out.withColumn("rate", ratio(F.col("matched"), F.col("total")))


def in_order(buckets: DataFrame) -> DataFrame:
    """breakdown() in order of dimensions and values, with nth, a value's place in its dimension from 1."""
    nth = F.row_number().over(Window.partitionBy("dim").orderBy("value"))  # a row a value
    return buckets.withColumn("nth", nth).orderBy("dim", "nth")


def head(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group in an order: a head sample, whose limit is what is asked for."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__nth") <= n).drop("__nth")


def overall(df: DataFrame, paper: str, matched: Column) -> DataFrame:
    per = df.groupBy(paper).agg(F.count(F.lit(1)).alias("t"), F.sum(matched.cast("int")).alias("m"))
    return per.agg(F.count(F.lit(1)).alias("paper_count"), F.sum("t").alias("total"), F.sum("m").alias("matched"), ratio(F.sum("m"), F.sum("t")).alias("micro_rate"), F.avg(F.col("m") / F.col("t")).alias("macro_rate"))


def per_paper_scores(df: DataFrame) -> DataFrame:
    """df (hits, gt, matched_preds, findings) with recall, precision, f1."""
    df = df.withColumn("recall", ratio(F.col("hits"), F.col("gt"))).withColumn("precision", ratio(F.col("matched_preds"), F.col("findings")))
    return df.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def dataset_scores(df: DataFrame) -> DataFrame:
    """Means over papers; avg_f1 is of the means, macro_f1 the mean of the papers'."""
    out = df.agg(F.avg("recall").alias("avg_recall"), F.avg("precision").alias("avg_precision"), F.avg("f1").alias("macro_f1"), ratio(F.avg("matched_preds"), F.avg("findings")).alias("match_success_rate"))
    return out.withColumn("avg_f1", f1(F.col("avg_precision"), F.col("avg_recall")))


def metric_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), sample_std(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def drop_rate_lift(df: DataFrame, kind: str, drop: Column) -> DataFrame:
    """Per kind its rate of drops, and the lift of its share among drops over that among the rest."""
    out = df.groupBy(kind).agg(F.sum(drop.cast("int")).alias("d"), F.sum((~drop).cast("int")).alias("n"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sd, sn = (F.greatest(F.sum(c).over(every), F.lit(1)) for c in ("d", "n"))
    return out.withColumns({"drop_rate": ratio(F.col("d"), F.col("d") + F.col("n")), "lift": (F.col("d") / sd + 1e-9) / (F.col("n") / sn + 1e-9)})


def bucket_shares(df: DataFrame, bucket: str, value: str) -> DataFrame:
    out = df.groupBy(bucket, value).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(bucket)))


def histogram(df: DataFrame, value: str, width: int) -> DataFrame:
    """Equal-width bins from 1 to the largest value, empty ones too; values up to 0 are left out."""
    rows = df.where(F.col(value) > 0).groupBy(F.ceil(F.col(value) / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = rows.agg(F.max("bin").alias("top")).where("top is not null").select(F.explode(F.sequence(F.lit(1), "top")).alias("bin"))
    return bins.join(rows, "bin", "left").select(((F.col("bin") - 1) * width + 1).alias("low"), (F.col("bin") * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows whose key new has, and new, each read once; null keys are equal."""
    both = old.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)))
    met = both.withColumn("__met", F.max("__new").over(Window.partitionBy(*keys)))
    return met.where(F.col("__new") | ~F.col("__met")).drop("__new", "__met")


def removed(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows whose key gone has."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def repair_ids(df: DataFrame, key: str, pos: str, given: str) -> DataFrame:
    """Keeps given ids of 1 or more; the others get, in order, the smallest numbers that are unused."""
    in_turn = Window.partitionBy(key).orderBy(pos)  # one order for all, so that a task sorts its rows once
    w = in_turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ok = F.when(F.col(given) >= 1, F.col(given).cast("int"))
    turn = F.sum(F.col("ok").isNull().cast("int")).over(in_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("ok", ok).withColumns({"used": F.collect_set("ok").over(w), "size": F.count(F.lit(1)).over(w), "turn": turn})
    free = F.array_except(F.sequence(F.lit(1), (F.col("size") + F.size("used")).cast("int")), F.col("used"))
    return df.withColumn("fixed_id", F.coalesce("ok", F.get(free, F.col("turn").cast("int") - 1))).drop("turn").drop("ok", "used", "size")
