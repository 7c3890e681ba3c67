"""Reply forests in one read and as ranked lists, against a plain walk."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.operators import replies as R

SCHEMA = "forum string, id string, parent string, time long"


def plain(rows):
    out = []
    for forum in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == forum], key=lambda r: (r[3] or 0, r[1], r[2] is not None, r[2] or ""))
        first = {}
        for i, r in enumerate(own):
            first.setdefault(r[1], i)
        up = [first.get(r[2], i) if r[2] is not None else i for i, r in enumerate(own)]
        place, n = {}, 0

        def walk(i, root, depth):
            nonlocal n
            place[i], n = (root, depth, n), n + 1
            for k in range(len(own)):
                if up[k] == i and k != i:
                    walk(k, root, depth + 1)

        for i in range(len(own)):
            if up[i] == i:
                walk(i, own[i][1], 0)
        out += [(*own[i][:3], *place.get(i, (None, None, None))) for i in range(len(own))]
    return sorted(out, key=repr)


def awkward():
    rng = np.random.default_rng(7)
    rows = [("c", "a", "b", 1), ("c", "b", "a", 2), ("c", "x", "a", 3), ("c", "r", None, 4), ("c", "s", "s", None), ("c", "q", "gone", 0), ("c", "y", "r", 9), ("c", "y", "r", 9), ("c", "z", "y", 5), ("c", "y", "q", 1)]
    rows += [(None, "n", None, 3), (None, "m", "n", 1), ("one", "o", None, None)]
    for f in range(4):
        for i in range(60):
            parent = None if i == 0 or rng.random() < 0.05 else f"n{rng.integers(0, i if f % 2 else 60)}"
            rows.append((f"f{f}", f"n{i}", parent, int(rng.integers(0, 9)) if rng.random() < 0.9 else None))
    rows += [("chain", f"k{i:03}", f"k{i - 1:03}" if i else None, 200 - i) for i in range(90)] + [("star", f"s{i:03}", "s000" if i else None, 0) for i in range(90)]
    return rows


@pytest.mark.parametrize("whole", [1 << 20, 30, 0])
def test_forests(spark, monkeypatch, whole):
    monkeypatch.setattr(R, "WHOLE", whole)
    table = spark.createDataFrame(awkward(), SCHEMA).repartition(5)
    got = sorted(map(tuple, R.forest(table, "forum", "id", "parent", "time").collect()), key=repr)
    assert got == plain(awkward())


def test_a_million_notes_in_a_chain_and_in_a_star(spark):
    n, i = 1_000_000, F.col("id").cast("string")
    began = time.time()
    rows = spark.range(n).select(F.lit("chain").alias("f"), i.alias("i"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("p"), F.col("id").alias("t"))
    rows = rows.unionByName(spark.range(n).select(F.lit("star").alias("f"), i.alias("i"), F.when(F.col("id") > 0, F.lit("0")).alias("p"), F.col("id").alias("t")))
    out = R.forest(rows, "f", "i", "p", "t").groupBy("f").agg(F.max("depth").alias("depth"), F.max("place").alias("place"), F.count_if(F.col("place").cast("string") == F.col("i")).alias("same"))
    assert sorted(map(tuple, out.collect())) == [("chain", n - 1, n - 1, n), ("star", 1, n - 1, n)]
    assert time.time() - began < 150
