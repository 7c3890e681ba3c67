"""Boxes on pages: those within larger ones that are kept go, from large to small.

A page's boxes come sorted by falling area and pass through a task one by one. Kept boxes lie in grids, one
for each power of two of their longer side, in the few cells that they reach over with their tolerance. A box
within another has its middle there, so it is held against the boxes of one cell a grid, not against all.
A task holds the kept boxes of one page at a time.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


class Kept:
    """The kept boxes of a page."""

    def __init__(self, pixels: float, share: float):
        self.pixels, self.share = pixels, share
        self.grids: dict[int, dict[tuple[int, int], list[tuple]]] = {}

    def _reach(self, b: tuple) -> tuple[float, float]:
        """How far a box may stick out of b to each side."""
        return max(self.pixels, self.share * max(1e-6, b[2] - b[0])), max(self.pixels, self.share * max(1e-6, b[3] - b[1]))

    def add(self, b: tuple) -> None:
        dx, dy = self._reach(b)
        level = math.frexp(max(b[2] - b[0] + 2 * dx, b[3] - b[1] + 2 * dy, 1e-6))[1]
        grid, side = self.grids.setdefault(level, defaultdict(list)), 2.0**level
        for i in range(math.floor((b[0] - dx) / side), math.floor((b[2] + dx) / side) + 1):
            for j in range(math.floor((b[1] - dy) / side), math.floor((b[3] + dy) / side) + 1):
                grid[i, j].append(b)

    def holds(self, b: tuple) -> bool:
        """Whether b lies in a larger kept box, but for the tolerance."""
        x, y = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
        for level, grid in self.grids.items():
            side = 2.0**level
            for k in grid.get((math.floor(x / side), math.floor(y / side)), ()):
                if self._area(k) > self._area(b) and self._within(k, b):
                    return True
        return False

    def _within(self, k: tuple, b: tuple) -> bool:
        out = k[0] - b[0], b[2] - k[2], k[1] - b[1], b[3] - k[3]
        if max(out) <= self.pixels:
            return True
        wide, high = max(1e-6, k[2] - k[0]), max(1e-6, k[3] - k[1])
        return max(0.0, out[0] / wide, out[1] / wide, out[2] / high, out[3] / high) <= self.share

    @staticmethod
    def _area(b: tuple) -> float:
        return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def without_parts(boxes: DataFrame, page: list[str], box: str, order: list[str], pixels: float = 2, share: float = 0.1) -> DataFrame:
    """The rows of boxes whose box (x0, y0, x1, y1) lies in no larger kept one of its page: from large to small,
    ties by order. Null pages are one page; rows without a box go.

    A box may stick out by some pixels to all sides, or by a share of the larger one's size. Rows of a page
    meet in one task, which reads them in order and holds what it keeps.
    """
    area = F.greatest(F.lit(0.0), F.col(f"{box}.x1") - F.col(f"{box}.x0")) * F.greatest(F.lit(0.0), F.col(f"{box}.y1") - F.col(f"{box}.y0"))
    sides = [F.col(f"{box}.{s}").cast("double").alias(f"__{s}") for s in SIDES]
    rows = boxes.where(F.col(box).isNotNull()).select("*", *sides, area.alias("__area"))
    rows = rows.repartition(*page).sortWithinPartitions(*page, F.desc("__area"), *order)

    columns = boxes.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, kept = None, Kept(pixels, share)
        for frame in frames:
            stays = []
            pages = zip(*(frame[c].astype(object).where(frame[c].notna(), None) for c in page)) if page else [()] * len(frame)
            for now, b in zip(pages, frame[[f"__{s}" for s in SIDES]].itertuples(index=False, name=None)):
                if now != at:
                    at, kept = now, Kept(pixels, share)
                stays.append(not kept.holds(b))
                if stays[-1]:
                    kept.add(b)
            yield frame[stays][columns]

    return rows.mapInPandas(run, boxes.schema)
