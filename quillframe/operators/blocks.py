"""Operators on ordered blocks of a document: budgets, runs, labels, repeated lines, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.text import bound, norm_line, split_lines, trimmed


def _running(key: str, pos: str) -> Window:
    return Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def budget_prefix(df: DataFrame, key: str, pos: str, cost: Column, budget: int) -> DataFrame:
    """The blocks before the first whose running cost passes the budget."""
    return df.withColumn("cum_cost", F.sum(cost).over(_running(key, pos))).where(F.col("cum_cost") <= budget)


def soft_budget_prefix(df: DataFrame, key: str, pos: str, cost: Column, budget: int, most: int, parts: Column | None = None, blank: Column | None = None) -> DataFrame:
    """As budget_prefix, but the block that passes 1.05 times the budget, or reaches `most` parts, still
    stays. parts is what a block counts, 1 by default; where blank is true, a block does not stop the run."""
    run = _running(key, pos)
    df = df.withColumn("cum_cost", F.sum(cost).over(run)).withColumn("cum_parts", F.sum(F.lit(1) if parts is None else parts).over(run))
    stop = (F.col("cum_cost") > int(1.05 * budget)) | (F.col("cum_parts") >= most)
    stop = stop if blank is None else stop & ~blank
    earlier = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("stopped", F.coalesce(F.max(stop).over(earlier), F.lit(False))).where(~F.col("stopped")).drop("stopped")


def section_runs(df: DataFrame, key: str, index: str, title: str) -> DataFrame:
    """Contiguous runs of one title: key, run, title, start_index, end_index.

    Untitled blocks without a gap before them extend the run; untitled ones after a gap are dropped.
    Indices must be unique per key.
    """
    w = Window.partitionBy(key).orderBy(index)
    gap = F.coalesce(F.col(index) != F.lag(index).over(w) + 1, F.lit(True))
    df = df.withColumn("island", F.sum(gap.cast("int")).over(w))
    filled = F.last(title, ignorenulls=True).over(Window.partitionBy(key, "island").orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("filled", filled).where("filled is not null")
    w2 = Window.partitionBy(key, "island").orderBy(index)
    change = F.coalesce(F.col("filled") != F.lag("filled").over(w2), F.lit(True))
    df = df.withColumn("run", F.sum(change.cast("int")).over(w))
    return df.groupBy(key, "run").agg(F.first("filled").alias("title"), F.min(index).alias("start_index"), F.max(index).alias("end_index"))


def fill_labels(df: DataFrame, key: str, pos: str, label: str, default: str) -> DataFrame:
    return df.withColumn("filled", F.coalesce(F.last(label, ignorenulls=True).over(_running(key, pos)), F.lit(default)))


RECORD = "struct<id: int, applied: boolean, pos0: int, offset: int, before: string, after: string>"


def apply_edits(texts: Column, edits: Column, around: int = 120) -> Column:
    """Applies edits (id, find, replacement) in order to an array of texts, null for blocks that are no
    text: a struct of the texts and a record of each edit.

    An edit changes the first occurrence in the first text that has it and sees what earlier edits made.
    Its record says whether it was applied, in which text (from 0), at which offset, and what stood
    around characters before and after. An empty find is at the start of the first text.
    """

    def one(state: Column, e: Column) -> Column:
        held = F.transform(state["texts"], lambda t: F.coalesce(F.contains(t, e["find"]), F.lit(False)))
        hit = F.array_position(held, F.lit(True)).cast("int")
        text = F.when(hit > 0, F.get(state["texts"], hit - 1))
        at = F.position(e["find"], text)
        start, end = F.greatest(F.lit(1), at - around), at + F.length(e["find"])
        new = F.concat(F.substr(text, F.lit(1), at - 1), e["replacement"], F.substr(text, end))
        place = F.when(hit > 0, hit - 1)
        record = F.struct(
            e["id"].cast("int").alias("id"), (hit > 0).alias("applied"), place.alias("pos0"), (at - 1).alias("offset"),
            F.substr(text, start, at - start).alias("before"), F.substr(text, end, F.lit(around)).alias("after"),
        )
        after = F.transform(state["texts"], lambda t, i: F.when(i == place, new).otherwise(t))
        return F.struct(after.alias("texts"), F.concat(state["records"], F.array(record)).alias("records"))

    return F.aggregate(edits, F.struct(texts.alias("texts"), F.array().cast(f"array<{RECORD}>").alias("records")), one)


def header_footer(blocks: DataFrame, key: str, pos: str, least: int = 3, share: float = 0.15) -> DataFrame:
    """key, norm, n, n_blocks: lines that open or close at least `least` blocks and that share of the
    text blocks (key, pos, type, text) that have a line.

    A block gives its first and last line, once if they are equal, and a mark that it has lines; nothing
    else of its text is moved.
    """

    def marks(lines: Column) -> Column:
        edges = F.transform(F.array(F.get(lines, F.lit(0)), F.element_at(lines, -1)), norm_line)
        return F.when(F.size(lines) > 0, F.concat(F.array(F.lit("")), F.filter(F.array_distinct(edges), lambda x: x != "")))  # the empty form counts blocks

    per = blocks.where("type = 'text'").select(key, F.explode(bound(split_lines(F.coalesce("text", F.lit(""))), marks)).alias("norm")).groupBy(key, "norm").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("n_blocks", F.max(F.when(F.col("norm") == "", F.col("n"))).over(Window.partitionBy(key)))
    return per.where((F.col("norm") != "") & (F.col("n") >= least) & (F.col("n") / F.col("n_blocks") >= share)).select(key, "norm", "n", "n_blocks")


def strip_header_footer(blocks: DataFrame, key: str, pos: str, least: int = 3, share: float = 0.15) -> DataFrame:
    """blocks (key, pos, type, text) without the later repeats of header and footer lines, wherever they stand.

    Papers without such lines stay as they are; in others text blocks are joined anew and trimmed, and
    those that end empty go. A paper has few such lines, 2 / share at most, so they and the places where
    each stands first are small arrays that meet the blocks by key; lines are not rows.
    """
    forms = header_footer(blocks, key, pos, least, share).groupBy(F.col(key).alias("__of")).agg(F.collect_set("norm").alias("__forms"))
    own = blocks.where("type = 'text'").select(key, pos, split_lines(F.coalesce("text", F.lit(""))).alias("__lines")).join(forms, F.col(key) == F.col("__of"))
    hits = F.filter(F.transform("__lines", lambda x, i: F.struct(norm_line(x).alias("norm"), i.alias("i"))), lambda h: F.array_contains(F.col("__forms"), h["norm"]))
    found = own.select("__of", pos, F.explode(hits).alias("h")).groupBy("__of", "h.norm").agg(F.min(F.struct(F.col(pos).alias("pos"), F.col("h.i").alias("i"))).alias("at"))
    firsts = found.groupBy("__of").agg(F.collect_set("norm").alias("__forms"), F.collect_set("at").alias("__firsts"))
    out = blocks.join(firsts, F.col(key) == F.col("__of"), "left")
    repeats = lambda x, i: F.array_contains(F.col("__forms"), norm_line(x)) & ~F.array_contains(F.col("__firsts"), F.struct(F.col(pos).alias("pos"), i.alias("i")))
    kept = F.filter(split_lines(F.coalesce("text", F.lit(""))), lambda x, i: ~repeats(x, i))
    told = F.col("__of").isNotNull() & (F.col("type") == "text")
    out = out.withColumn("text", F.when(told, trimmed(F.array_join(kept, "\n"))).otherwise(F.col("text")))
    return out.where(~F.coalesce(told & (F.col("text") == ""), F.lit(False))).select(*blocks.columns)
