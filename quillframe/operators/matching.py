"""Joins of edits, findings and blocks within a paper. All are equi-joins on the paper, so no pair leaves it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.operators.search import in_cells, occurrences


def applied_edits(edits: DataFrame, results: DataFrame, key: str, id_: str) -> DataFrame:
    """The edits whose id was applied; all edits of a paper that has no applied one."""
    done = results.where("applied").groupBy(key, id_).agg(F.lit(True).alias("__hit"))
    some = done.select(key).distinct().withColumn("__some", F.lit(True))
    out = edits.join(done, [key, id_], "left").join(some, [key], "left")
    return out.where("__some is null or __hit").drop("__some", "__hit")


def first_containing(blocks: DataFrame, needles: DataFrame, key: str, pos: str, text: str, needle: str, around: int = 120) -> DataFrame:
    """needles, repeated rows too, with pos of the first block of the paper that contains each (null if
    none), its offset from 0, and up to around characters before and after the match. An empty needle is
    found nowhere.

    Each different needle of a paper is searched once, all of a cell's needles at a time, and a cell hands
    on a row a needle.
    """
    once = needles.where(F.col(needle) != "").select(F.col(key), F.col(needle).alias("__needle")).distinct()
    kind = {c: blocks.schema[c].dataType.simpleString() for c in (key, pos)}

    def look(b: pa.Table, n: pa.Table) -> pa.Table:
        texts, wanted, place = b[text].to_pylist(), n["__needle"].to_pylist(), b[pos].to_pylist()
        first: dict[int, tuple] = {}
        for i, w, o in zip(*(x.tolist() for x in occurrences(texts, wanted))):
            if i not in first or (place[w], o) < first[i][:2]:
                first[i] = place[w], o, w
        own = [(texts[w], o, o + len(wanted[i])) for i, (_, o, w) in first.items()]
        return pa.table({
            key: pa.array(n[key].to_pylist()[:1] * len(first), n[key].type), "__needle": pa.array([wanted[i] for i in first], pa.string()),
            "pos": pa.array([x[0] for x in first.values()], b[pos].type), "offset": pa.array([x[1] for x in first.values()], pa.int32()),
            "before": pa.array([t[max(0, a - around) : a] for t, a, _ in own], pa.string()), "after": pa.array([t[e : e + around] for t, _, e in own], pa.string()),
        })

    held = blocks.where(F.col(text).isNotNull() & F.col(pos).isNotNull()).select(key, pos, text)
    found = in_cells(held, once, key, F.col(text), F.col("__needle"), look, f"`{key}` {kind[key]}, __needle string, pos {kind[pos]}, offset int, before string, after string")
    first = found.groupBy(F.col(key).alias("__of"), "__needle").agg(F.min(F.struct("pos", "offset", "before", "after")).alias("__hit")).select("__of", "__needle", "__hit.*")
    return needles.join(first, (needles[key] == F.col("__of")) & (needles[needle] == F.col("__needle")), "left").drop("__of", "__needle")


def in_first_run(blocks: DataFrame, runs: DataFrame, key: str, index: str, wanted: str) -> DataFrame:
    """The blocks from start_index to end_index of each paper's first run whose title contains wanted, in any case."""
    found = runs.where(F.lower("title").contains(wanted.lower()))
    first = found.groupBy(key).agg(F.min(F.struct("start_index", "end_index")).alias("r")).select(key, "r.*")
    return blocks.join(first, key).where(F.col(index).between(F.col("start_index"), F.col("end_index"))).drop("start_index", "end_index")


def hit_flags(matches: Column, n: Column) -> Column:
    """Flags of n ground truths by the matches (gt_index, matched): an index in 0 .. n - 1 is taken as it
    is, n as n - 1; the k-th match with no such index takes the k-th place, and nothing beyond n."""
    index = F.transform(matches, lambda m: F.when(m["gt_index"].between(0, n - 1), m["gt_index"]).when(m["gt_index"] == n, n - 1))
    turn = lambda i: F.size(F.filter(F.slice(index, F.lit(1), i + 1), lambda x: x.isNull())) - 1
    at = F.transform(index, lambda x, i: F.coalesce(x, turn(i)))
    hit = F.filter(F.arrays_zip(at.alias("at"), F.transform(matches, lambda m: F.coalesce(m["matched"], F.lit(False))).alias("hit")), lambda z: z["hit"])
    taken = F.transform(hit, lambda z: z["at"])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.array_contains(taken, i))).otherwise(F.array().cast("array<boolean>"))
