"""Exact deduplication against a minimal perfect hash over historical distinct digests.

A batch that has been processed before (the history) is reduced to its distinct SHA-256 digests,
each with the locator of its winner (smallest doc_id, then row number) and its number of rows. The
digests are dealt by hash to shards; each shard gets a minimal perfect hash (levels of bit arrays:
a digest settles on the first level where it alone hits a bit, and its slot is the rank of that
bit). Slot arrays hold the full 32-byte digest, the winner's locator and the group's size. A new
batch is pre-aggregated by digest, so a group of copies sends one row; it is probed shard by shard,
and a hit counts only if all 32 bytes in the slot agree. Members become repeats of the historical
winner, the others form their own groups.

Defined cases: null text counts as empty; texts are equal when identical after each run of white
space became one space; null doc_ids come after all others; rows that repeat both doc_id and text
are told apart by their row number, so exactly one row of a group is kept; an empty history or
batch gives an empty side; extra columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import SPACES, cut, documents, fan_out, refuse, text_or_empty

#: Distinct digests that one shard's hash holds on average, about 60 bytes each.
SHARD_KEYS = 20_000
#: Bits a level has for each digest still unplaced.
GAMMA = 2.0

RESOLVED = "digest binary, has_id boolean, keep_id long, keep_row long, group_size long, hit boolean"


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests, built and probed with numpy."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = [int(x.sum()) for x in levels]
        self.starts = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)
        self.ranks = [np.cumsum(x) - 1 for x in levels]

    @staticmethod
    def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        """The bit that each digest (four 64-bit words) hits on a level."""
        salt = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = words[:, level % 4] ^ (words[:, (level // 4 + 1) % 4] * salt)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return (x % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        levels, left = [], words
        while len(left):
            size = max(8, int(len(left) * GAMMA))
            at = cls._place(left, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[at]]
        return cls(levels)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 where no level claims it."""
        out, todo = np.full(len(words), -1, dtype=np.int64), np.arange(len(words))
        for level, bits in enumerate(self.levels):
            if not len(todo):
                break
            at = self._place(words[todo], level, len(bits))
            here = bits[at]
            out[todo[here]] = self.starts[level] + self.ranks[level][at[here]]
            todo = todo[~here]
        return out

    def dump(self) -> tuple[bytes, bytes]:
        return np.array([len(x) for x in self.levels], dtype=np.int64).tobytes(), b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        levels, at = [], 0
        for n in np.frombuffer(sizes, dtype=np.int64):
            step = (int(n) + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(bits, dtype=np.uint8, count=step, offset=at), count=int(n)).astype(bool))
            at += step
        return cls(levels)


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    words = _words(pdf["digest"])
    mph = PerfectHash.build(words)
    order = np.argsort(mph.slots(words))
    sizes, bits = mph.dump()
    locators = pdf[["has_id", "keep_id", "keep_row", "group_size"]].to_numpy(dtype=np.int64)[order]
    return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0]), "sizes": sizes, "bits": bits, "digests": words[order].tobytes(), "locators": locators.tobytes()}])


def _frame(words: np.ndarray, locators: np.ndarray, hit: np.ndarray) -> pd.DataFrame:
    raw = words.tobytes()
    return pd.DataFrame({
        "digest": [raw[i : i + 32] for i in range(0, len(raw), 32)],
        "has_id": locators[:, 0].astype(bool), "keep_id": locators[:, 1], "keep_row": locators[:, 2], "group_size": locators[:, 3], "hit": hit,
    })


def _probe_shard(index: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    """Every historical group with the batch's rows added, then the batch's own groups."""
    words = _words(batch["digest"]) if len(batch) else np.zeros((0, 4), dtype="<u8")
    found = batch[["has_id", "keep_id", "keep_row", "group_size"]].to_numpy(dtype=np.int64).reshape(-1, 4)
    if not len(index):
        return _frame(words, found, np.zeros(len(words), dtype=bool))
    row = index.iloc[0]
    held = np.frombuffer(row["digests"], dtype="<u8").reshape(-1, 4)
    slots = np.frombuffer(row["locators"], dtype=np.int64).reshape(-1, 4).copy()
    at = PerfectHash.load(row["sizes"], row["bits"]).slots(words)
    member = at >= 0
    member[member] = (held[at[member]] == words[member]).all(axis=1)  # all 32 bytes
    np.add.at(slots[:, 3], at[member], found[member, 3])
    touched = np.zeros(len(held), dtype=bool)
    touched[at[member]] = True
    return pd.concat([_frame(held, slots, touched), _frame(words[~member], found[~member], np.zeros(int((~member).sum()), dtype=bool))])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the normalised text, and a row number; small, computed once."""
    norm = F.regexp_replace(text_or_empty(), SPACES, " ")
    return cut(docs.select("doc_id", F.unhex(F.sha2(norm, 256)).alias("digest"), F.monotonically_increasing_id().alias("row_no")))


def _groups(rows: DataFrame, shards: int) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_no"))
    return rows.groupBy("digest").agg(first.alias("w"), F.count(F.lit(1)).alias("group_size")).select(
        F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"), "digest",
        F.col("w.doc_id").isNotNull().alias("has_id"), F.coalesce("w.doc_id", F.lit(0)).alias("keep_id"), F.col("w.row_no").alias("keep_row"), "group_size",
    )


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the perfect hash and the slot arrays of the history's distinct digests."""
    schema = "shard int, sizes binary, bits binary, digests binary, locators binary"
    return _groups(history, shards).groupBy("shard").applyInPandas(_build_shard, schema)


def probe(index: DataFrame, batch: DataFrame, shards: int) -> DataFrame:
    """One row per distinct digest of history and batch: who stays, and how many rows there are.

    A historical winner stays whatever the batch holds; hit says that the batch repeats it.
    """
    return index.groupBy("shard").cogroup(_groups(batch, shards).groupBy("shard")).applyInPandas(_probe_shard, RESOLVED)


def shard_count(rows: DataFrame) -> int:
    return max(4 * fan_out(rows), rows.count() // SHARD_KEYS)


def deduplicate(rows: DataFrame) -> DataFrame:
    """rows of digests() with keep_id, group_size and kept.

    The lower half of the doc_ids is the history, the rest the batch that meets it, so that a
    historical winner always has the smallest doc_id of its group. The last join moves rows of
    about 50 bytes and is a plain sort-merge join, whose hot digests adaptive execution splits.
    """
    shards = shard_count(rows)
    middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    old = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    resolved = probe(build_index(rows.where(old), shards), rows.where(~old), shards)
    keep = F.when(F.col("has_id"), F.col("keep_id"))
    return rows.join(resolved, "digest").select("doc_id", keep.alias("keep_id"), "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), "digest")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(digests(documents(spark, sf_dir)))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""


def stage(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one per group of equal texts, with the columns of docs.

    Rows are judged once. Only the keys of rows that go meet the texts, as the hashed side of a join
    through which whole texts pass without a sort. It refuses a table with a column of its own names.
    """
    refuse(docs, "__digest", "__id", "__of")
    judged = cut(deduplicate(digests(docs)))
    gone, stays = (judged.where(c).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__of")) for c in ("not kept", "kept"))
    own = F.unhex(F.sha2(F.regexp_replace(text_or_empty(), SPACES, " "), 256))
    # A lost row whose doc_id and text both equal a kept row's must not take that one along; only then are whole rows compared.
    twins = cut(gone.join(stays, gone["__id"].eqNullSafe(stays["__id"]) & (gone["__of"] == stays["__of"]), "left_semi").distinct())
    out = docs.withColumn("__digest", own)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__of"))
    if not twins.isEmpty():
        gone = gone.join(twins, gone["__id"].eqNullSafe(twins["__id"]) & (gone["__of"] == twins["__of"]), "left_anti")
        once = out.join(twins, same, "left_semi").dropDuplicates(["doc_id", "__digest"])
        out = out.join(twins, same, "left_anti").unionByName(once)
    return out.join(gone.distinct().hint("shuffle_hash"), same, "left_anti").drop("__digest")
