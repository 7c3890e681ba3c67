"""Mixing sources to target weights, with DataFrame functions only.

Every source's documents form one stream of words, cut into blocks of BLOCK_WORDS words; the last
block of a source may be shorter. A source gives as many whole passes over its blocks as fit in its
target, and the start of one more, its slots being numbered 0, 1, 2, ... A pass visits the whole
blocks in the order of a pseudorandom permutation of their indices and the short block last. Every
output shard of SHARD_SLOTS places draws its counts of the sources from the multinomial distribution
of the targets, by hashes, so reruns agree; the differences between the sums of these counts and the
targets are then settled. A shard's places are its sources' next slots, and join the blocks' pieces
of documents by block index.

Defined cases: null text has no words; a null source is a source of its own, ordered last;
documents without words are in no block and are taken 0 times; repeated rows are separate rows of
the stream; a source without words has target 0; empty tables give empty results; extra columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm.common import WORD, cut, documents, refuse, text_or_empty, two_level_sum

BLOCK_WORDS = 512
SHARD_SLOTS = 256
#: Places made in a task; numbers of a cell.
PART_SLOTS, CELL = 1 << 16, 1024
MOST_REPEATS = 3
SEED = 20


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a tie-breaking hash of the text; computed once."""
    return cut(docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("tie")))


def targets(rows: DataFrame) -> DataFrame:
    """One row per source: sid, source, source_size, target; as many rows as there are sources.

    Weights 1, 2, 3 repeat in code point order. The capped shares are the level at which
    sum(min(3 * size, level * weight)) is the sum of all sizes, found in one pass over the sources
    in order of 3 * size / weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", "sid")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name))
    s = s.withColumn("weight", 1 + F.pmod(F.col("sid") - 1, F.lit(3))).withColumn("cap", F.col("source_size") * MOST_REPEATS)
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(every) - before) / weights)
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "sid", "level"))).over(every)["level"]
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))).select("sid", "source", "source_size", "target")


def _draw(*parts: Column) -> Column:
    return F.xxhash64(F.lit(SEED), *parts)


def permuted(index: Column, n: Column, key: list[Column]) -> Column:
    """A pseudorandom permutation of 0 .. n - 1, chosen by key, as one expression.

    Twelve steps in turn rotate by a drawn distance, then multiply by a drawn odd number and fold
    by a shift the indices below the largest power of two up to n; each step is one-to-one. n must
    be below 2^31.
    """
    bits = F.length(F.bin(n)) - 1
    mask = F.pow(F.lit(2.0), bits).cast("long") - 1
    fold = F.floor(bits / 2 + 1).cast("int")

    def step(x: Column, r: Column) -> Column:
        odd = _draw(r, *key).bitwiseAND(F.lit(0x3FFFFFFF)).bitwiseOR(F.lit(1))
        turned = F.when(r % 3 == 1, (x * odd).bitwiseAND(mask)).otherwise(x.bitwiseXOR(F.call_function("shiftrightunsigned", x, fold)))
        return F.when(r % 3 == 0, F.pmod(x + F.pmod(_draw(r, *key), n), n)).when(x > mask, x).otherwise(turned)

    return F.aggregate(F.sequence(F.lit(0), F.lit(11)), index.cast("long"), step)


def _drawn(s: DataFrame, total: int) -> DataFrame:
    """One row per place of the mix, with its shard and the source it draws.

    A place draws a number below the total of all sources' slots, and the source whose interval of
    numbers has it; so a shard's counts of sources are a multinomial draw by the targets. Numbers meet
    intervals by cells of CELL numbers, an equi-join in which no cell is larger than others.
    """
    cells = s.withColumn("cell", F.explode(F.expr(f"sequence(first div {CELL}, (first + n_slots - 1) div {CELL})")))
    places = s.sparkSession.range(0, total, 1, max(1, -(-total // PART_SLOTS))).withColumn("x", F.pmod(_draw(F.lit("source"), F.col("id")), F.lit(max(1, total))))
    places = places.select(F.expr(f"id div {SHARD_SLOTS}").alias("shard"), "id", "x", F.expr(f"x div {CELL}").alias("cell"))
    return places.join(cells.hint("merge"), "cell").where("x >= first and x < first + n_slots").drop("cell", "x", "first")


def slots(sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per slot of the mix: sid, slot, pass, block_index, words taken from its start, shard.

    A source's places number its slots in a pseudorandom order. A source that was drawn more often than
    its target wants gives its last places, which lie in any shards, to sources drawn less often: the
    totals are settled exactly, and only about the square root of all places change hands.
    """
    own = ["sid", "n_slots", "want", "source_size", "full", "tail", "blocks"]
    s = sources.where("source_size > 0").withColumns({"want": F.floor("target").cast("long"), "full": F.expr(f"source_size div {block}"), "tail": F.col("source_size") % block})
    s = s.withColumns({"blocks": F.col("full") + (F.col("tail") > 0).cast("int"), "passes": F.expr("want div source_size"), "rest": F.col("want") % F.col("source_size")})
    s = s.withColumn("n_slots", (F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block)).cast("long")).where("n_slots > 0")
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    s = cut(s.select(*own, F.coalesce(F.sum("n_slots").over(before), F.lit(0)).alias("first")))
    total = s.agg(F.sum("n_slots")).first()[0] or 0
    drawn = _drawn(s, total)
    drawn = drawn.withColumn("spread", F.pmod(_draw(F.lit("order"), F.col("id")), F.lit(max(16, math.isqrt(total)))))
    placed = cut(two_level_sum(drawn, ["sid"], "spread", ["id"], F.lit(1).cast("long"), "slot").select("shard", "slot", *own))

    got = placed.groupBy("sid").agg(F.count(F.lit(1)).alias("got"))
    settled = s.join(got.hint("merge"), "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    settled = settled.withColumns({"over": F.greatest(F.lit(0), F.col("got") - F.col("n_slots")), "under": F.greatest(F.lit(0), F.col("n_slots") - F.col("got"))})
    settled = cut(settled.withColumns({f"{c}_from": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("over", "under")}))
    spare = settled.where("over > 0").select("sid", "over_from")
    spare = placed.where("slot >= n_slots").join(spare.hint("merge"), "sid").select("shard", (F.col("over_from") + F.col("slot") - F.col("n_slots")).alias("number"))
    lacking = settled.where("under > 0").withColumn("number", F.explode(F.expr("sequence(under_from, under_from + under - 1)")))
    lacking = lacking.select("number", (F.col("got") + F.col("number") - F.col("under_from")).alias("slot"), *own)
    moved = spare.join(lacking.hint("merge"), "number").select("shard", "slot", *own)
    s = placed.where("slot < n_slots").unionByName(moved)

    s = s.withColumns({"pass": F.expr("slot div blocks"), "turn": F.expr("slot % blocks")})
    whole = F.col("turn") < F.col("full")
    s = s.withColumn("block_index", F.when(whole, permuted(F.col("turn"), F.greatest("full", F.lit(1)), [F.col("sid"), F.col("pass")])).otherwise(F.col("full")))
    start = F.col("pass") * F.col("source_size") + F.col("turn") * block
    length = F.when(whole, F.lit(block)).otherwise(F.col("tail"))
    s = s.withColumn("words", F.least(length, F.col("want") - start).cast("long"))
    return s.where("words > 0").select("sid", "slot", "pass", "block_index", "words", "shard")


def pieces(rows: DataFrame, sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The documents' parts in their source's blocks: rows' columns, sid, at, block_index, lo, hi.

    at is the document's place in its source's stream; lo and hi bound the part within the block.
    """
    buckets = F.lit(max(16, int(rows.count() ** 0.5)))
    s = sources.select("sid", F.col("source").alias("__source"), "source_size", "target")
    d = rows.join(s, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    some = d.where("size > 0").withColumn("spread", F.pmod(F.xxhash64("doc_id", "tie", "size"), buckets))
    some = two_level_sum(some, ["sid"], "spread", ["doc_id", "tie", "size"], F.col("size"), "at")
    some = some.withColumn("block_index", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    base = F.col("block_index") * block
    return some.withColumns({"lo": F.greatest(F.col("at"), base) - base, "hi": F.least(F.col("at") + F.col("size"), base + block) - base}).drop("spread")


def mix(rows: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix: (shard, sid, slot) joined by block index with the parts of documents it takes.

    Columns: shard, sid, slot, pass, block_index, doc_id, source, at, lo, take; a slot takes the words
    lo .. lo + take of the block from that document.
    """
    sources = cut(targets(rows))
    found = pieces(rows, sources, block).join(slots(sources, block).hint("merge"), ["sid", "block_index"])
    take = F.least("hi", "words") - F.col("lo")
    return found.withColumn("take", take).where("take > 0").select("shard", "sid", "slot", "pass", "block_index", "doc_id", "source", "at", "lo", "take")


def taken(rows: DataFrame) -> DataFrame:
    """rows with source_size, target and taken, the words the mix takes of each document."""
    sources = cut(targets(rows))
    keys = ["doc_id", "tie", "sid", "at", "size", "source_size", "target"]
    got = pieces(rows, sources).join(slots(sources).hint("merge"), ["sid", "block_index"], "left")
    take = F.greatest(F.lit(0), F.least("hi", F.coalesce("words", F.lit(0))) - F.col("lo"))
    got = got.groupBy(*keys).agg(F.sum(take).alias("taken")).select("doc_id", "tie", "size", "source_size", "target", "taken")
    s = sources.select(F.col("source").alias("__source"), "source_size", "target")
    none = rows.where("size = 0").join(s, F.col("source").eqNullSafe(F.col("__source"))).select("doc_id", "tie", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return got.unionByName(none)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(sizes(documents(spark, sf_dir))).drop("tie")


def stage(docs: DataFrame) -> DataFrame:
    """docs as the mix has them, with the columns of docs: whole documents, repeated or left out.

    A document of which the mix takes n times its size, n a fraction, stands floor(n + u) times, u
    being a draw from 0 to 1 by hash, so each source's words come near its target in documents, too.
    Documents without words, which no mix takes, are left out. A document is a doc_id and a text; rows
    equal in both stand as often each. It refuses a table with a column __id, __tie, __copies or __copy.
    """
    refuse(docs, "__id", "__tie", "__copies", "__copy")
    per = taken(sizes(docs)).where("size > 0").groupBy("doc_id", "tie").agg((F.sum("taken") / F.sum("size")).alias("n"))
    per = per.select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), F.floor(F.col("n") + F.pmod(_draw(F.lit("round"), F.col("doc_id"), F.col("tie")), F.lit(1 << 30)) / float(1 << 30)).cast("int").alias("__copies"))
    per = per.where("__copies > 0")
    out = docs.join(per, F.col("doc_id").eqNullSafe(F.col("__id")) & F.xxhash64("text").eqNullSafe(F.col("__tie")))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
