"""Many needles in the blocks of many papers, in time linear in the texts, the needles and what is found.

A paper's blocks and needles meet in cells of bounded size: a paper with more text or needles than a cell
holds has several cells, each with one part of either, so no task holds a large paper. A cell hashes all
windows of the lengths 1, 2, 4, ... that its needles call for, each from two windows of half the length.
A needle of a length from w to below 2 w is named by its length, its first w characters and its last w; it
stands where both windows do. What hashes say is checked on the texts, so results are exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of texts and of needles that a cell holds on average.
CELL_TEXT, CELL_NEEDLES = 2_000_000, 1_000_000
BASE = 0x9E3779B97F4A7C15


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _windows(codes: np.ndarray, width: int) -> np.ndarray:
    """The hash of the width characters from each place on; width is a power of two, places too near the end have none."""
    h, at, factor = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1, BASE
    h ^= h >> np.uint64(32)
    while at < width and len(h) > at:
        h = h[:-at] * np.uint64(factor) + h[at:]
        at, factor = at * 2, factor * factor & (1 << 64) - 1
    return h if at == width else h[:0]


def _mixed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    x = (first ^ (last >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + last
    return x ^ (x >> np.uint64(31))


def occurrences(texts: list[str], needles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """needle, text and offset of the first place of each needle in each text that has it, by number and in order. Empty needles are nowhere."""
    codes = [_points(t) for t in texts]
    starts = np.cumsum([0, *map(len, codes)])
    flat = np.concatenate([*codes, np.zeros(0, dtype="<u4")])
    found = [np.zeros((3, 0), dtype=np.int64)]
    sizes = np.array([len(n) for n in needles], dtype=np.int64)
    for power in range(int(sizes.max()).bit_length() if len(sizes) else 0):
        width = 1 << power
        own = np.flatnonzero((sizes >= width) & (sizes < 2 * width))
        if not len(own) or len(flat) < width:
            continue
        grams = _windows(flat, width)
        ends = np.array([[_windows(p[:width], width)[0], _windows(p[-width:], width)[0]] for p in (_points(needles[i]) for i in own)], dtype=np.uint64)
        begins = np.flatnonzero(np.isin(grams, ends[:, 0]))
        for size in np.unique(sizes[own]).tolist():
            mine = own[sizes[own] == size]
            keys = _mixed(*ends[sizes[own] == size].T)
            order = np.argsort(keys, kind="stable")
            keys, mine = keys[order], mine[order]
            at = begins[begins + size <= len(flat)]
            here = _mixed(grams[at], grams[at + size - width])
            low, high = np.searchsorted(keys, here, side="left"), np.searchsorted(keys, here, side="right")
            hit = high > low
            at, low, count = at[hit], low[hit], (high - low)[hit]
            which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found.append(np.array([mine[which], np.repeat(at, count), np.full(len(which), size)]))
    needle, at, size = np.concatenate(found, axis=1)
    text = np.searchsorted(starts, at, side="right") - 1
    inside = at + size <= starts[text + 1] if len(at) else np.zeros(0, dtype=bool)
    needle, text, at = needle[inside], text[inside], at[inside]
    order = np.lexsort((at, text, needle))
    needle, text, at = needle[order], text[order], at[order]
    first = np.ones(len(at), dtype=bool)
    first[1:] = (needle[1:] != needle[:-1]) | (text[1:] != text[:-1])
    needle, text, at = needle[first], text[first], at[first] - starts[text[first]]
    sure = np.array([texts[t].startswith(needles[n], o) for n, t, o in zip(needle.tolist(), text.tolist(), at.tolist())], dtype=bool)
    if not sure.all():  # hashes agreed where texts do not: this needle's first place lies further on, or nowhere
        at = np.array([o if ok else texts[t].find(needles[n]) for n, t, o, ok in zip(needle, text, at, sure)], dtype=np.int64)
        needle, text, at = needle[at >= 0], text[at >= 0], at[at >= 0]
    return needle, text, at


def in_cells(blocks: DataFrame, needles: DataFrame, key: str, text: Column, needle: Column, look: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """look(blocks, needles) of each cell of each paper; text and needle are what a cell's size is measured by. Papers without blocks or without needles have no cell, null is no paper."""
    count = lambda df, size, most, name: df.groupBy(key).agg(F.greatest(F.lit(1), F.ceil(F.sum(F.length(size)) / most)).cast("int").alias(name))
    cells = count(blocks, text, CELL_TEXT, "__chunks").join(count(needles, needle, CELL_NEEDLES, "__packs"), key)
    part = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = [key, "__chunk", "__pack"]
    own = lambda df, cols: df.select(*[F.col(c).alias(c) for c in cols], "__chunk", "__pack")  # noqa: E731  both sides may come from one table
    b = own(blocks.join(cells, key).withColumn("__chunk", part(blocks, "__chunks")).withColumn("__pack", every("__packs")), blocks.columns)
    n = own(needles.join(cells, key).withColumn("__pack", part(needles, "__packs")).withColumn("__chunk", every("__chunks")), needles.columns)
    return b.groupBy(*at).cogroup(n.groupBy(*at)).applyInArrow(look, schema)
