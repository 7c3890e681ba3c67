"""Exact order statistics of a column without one task that sees all rows.

The range in which a rank lies is narrowed by rounds: a sketch of its values gives pivots, one aggregate
counts the rows between and at the pivots, and the rank's interval is the next range. A round divides a
range by about PIVOTS, so a column of 10^12 values needs five; equal values end in a pivot, however many
they are. The driver sees as many rows a round as there are pivots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIVOTS = 256
#: Different values of a range that are counted one by one.
FEW = 4096


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> dict[int, object]:
    """The values at ranks, from 0, of a column in rising order; nulls are left out, NaN comes last. Ranks beyond the rows have no value."""
    rows = df.select(F.col(column).alias("v")).where("v is not null")
    out: dict[int, object] = {}
    todo = [(rows, 0, sorted(set(ranks)))]
    while todo:
        part, before, wanted = todo.pop()
        few = part.groupBy("v").agg(F.count(F.lit(1)).alias("n")).limit(FEW + 1)
        sketch = part.agg(F.approx_count_distinct("v").alias("d"), F.percentile_approx("v", [(i + 0.5) / PIVOTS for i in range(PIVOTS)], 8 * PIVOTS).alias("p")).first()
        counted = sorted(((r["v"], r["n"]) for r in few.collect()), key=lambda x: _key(x[0])) if sketch["d"] <= FEW // 2 else []
        if sketch["d"] <= FEW // 2 and len(counted) <= FEW:
            for v, n in counted:
                out |= {k: v for k in wanted if before <= k < before + n}
                before += n
            continue
        pivots = sorted(set(sketch["p"]), key=_key)
        held = F.array(*[F.lit(p) for p in pivots])
        below = F.size(F.filter(held, lambda p: p < F.col("v")))  # as many pivots as the parameter says
        place = 2 * below + F.coalesce(F.get(held, below) == F.col("v"), F.lit(False)).cast("int")
        for place, n in sorted(tuple(r) for r in part.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()):
            here = [k for k in wanted if before <= k < before + n]
            if here and place % 2:
                out |= {k: pivots[place // 2] for k in here}
            elif here:
                low, high = place // 2 - 1, place // 2
                inner = part.where(F.col("v") > F.lit(pivots[low])) if low >= 0 else part
                todo.append((inner.where(F.col("v") < F.lit(pivots[high])) if high < len(pivots) else inner, before, here))
            before += n
    return out


def _key(v: object) -> tuple:
    return (v != v, v)


def median(df: DataFrame, column: str) -> float | None:
    """The middle value of a column, or the mean of the middle two; None without values."""
    n = df.agg(F.count(column)).first()[0]
    found = order_statistics(df, column, [(n - 1) // 2, n // 2]) if n else {}
    return (float(found[(n - 1) // 2]) + float(found[n // 2])) / 2 if found else None
