"""Rectangles on pages, as structs of x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])


def from_size(x: Column, y: Column, width: Column, height: Column) -> Column:
    """The box of a corner and a size; null unless both sides are positive."""
    return F.when((width > 0) & (height > 0), box(x, y, x + width, y + height))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def overflow(outer: Column, inner: Column) -> Column:
    """The most that inner sticks out of outer on a side, in shares of outer's width or height."""
    wide, high = (F.greatest(F.lit(1e-6), outer[f"{a}1"] - outer[f"{a}0"]) for a in "xy")
    return F.greatest(F.lit(0.0), (outer["x0"] - inner["x0"]) / wide, (inner["x1"] - outer["x1"]) / wide, (outer["y0"] - inner["y0"]) / high, (inner["y1"] - outer["y1"]) / high)


def contains(outer: Column, inner: Column, pixels: float = 2, share: float = 0.1) -> Column:
    """inner lies in outer, but for some pixels or a share of outer's size on each side."""
    near = F.greatest(outer["x0"] - inner["x0"], outer["y0"] - inner["y0"], inner["x1"] - outer["x1"], inner["y1"] - outer["y1"]) <= pixels
    return near | (overflow(outer, inner) <= share)


def on_page(b: Column, page: Column) -> Column:
    """b with the page it is on."""
    return F.struct(*[b[n].alias(n) for n in ("x0", "y0", "x1", "y1")], page.cast("int").alias("page"))
