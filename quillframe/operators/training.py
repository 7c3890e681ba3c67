"""From edited papers to training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.functions.parse import json_value
from quillframe.operators.checks import truth_fault
from quillframe.session import checkpointed

#: Around the text in an instruction: fixed values.
TEXT_MARK, RULE = "### Text to Review ###", "---"


def usable(papers: DataFrame, flag: str = "synthetic") -> DataFrame:
    """Papers whose flag is true; null is not."""
    return papers.where(F.coalesce(F.col(flag), F.lit(False)))


def local_edits(edits: DataFrame) -> DataFrame:
    """edits with an id that need no other section; where that is not said, they do."""
    return edits.where(F.col("id").isNotNull() & ~F.coalesce("needs_cross_section", F.lit(True)))


def edited_text(edits: DataFrame, records: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """edits with text, the block that each changed, as it is now: by the first record (key, ord, id, pos0)
    of its id, whose block has the number (index1) pos0 + 1. Edits without a record, a place or a text
    that is not empty are left out; of blocks of one number the first (ord) counts."""
    first = records.groupBy(key, "id").agg(F.min(F.struct("ord", "pos0"))["pos0"].alias("pos0")).where("pos0 is not null")
    found = blocks.groupBy(key, "index1").agg(F.min_by("text", "ord").alias("text")).where("text <> ''")
    return edits.join(first, [key, "id"]).withColumn("index1", F.col("pos0") + 1).join(found, [key, "index1"]).drop("pos0", "index1")


def grouped(edits: DataFrame, key: list[str], order: str, fields: list[str]) -> DataFrame:
    """A row a text of a paper with errors, its edits in order, and first, the order of the first. A paragraph's edits are few."""
    rows = F.array_sort(F.collect_list(F.struct(order, *fields)))
    return edits.groupBy(*key, "text").agg(F.min(order).alias("first"), F.transform(rows, lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias("errors"))


def samples(groups: DataFrame, key: list[str], instruction: str, kind: str = "corruption_type") -> DataFrame:
    """Numbered samples (key, sample, instruction, output, error_count, text_length, error_types) of groups
    of grouped(). instruction is a template with {text}; output is the JSON of the errors, located by what
    replaced the text. Groups without a text or an error are left out."""
    before, after = instruction.split("{text}")
    groups = groups.where((F.col("text") != "") & (F.size("errors") > 0))
    of = lambda e, f: F.coalesce(e[f], F.lit(""))
    errors = F.transform("errors", lambda e: F.struct(of(e, "replacement").alias("error_location"), of(e, kind).alias("error_type"), of(e, "error_explanation").alias("error_explanation")))
    return groups.select(
        *key, F.concat(F.lit(before), "text", F.lit(after)).alias("instruction"), F.to_json(errors).alias("output"), F.size("errors").alias("error_count"),
        F.length("text").alias("text_length"), F.transform("errors", lambda e: e[kind]).alias("error_types"), "first",
    )


def numbered(rows: DataFrame, order: list[str], out: str = "sample") -> DataFrame:
    """rows with 'sample_1', 'sample_2', ... in order, without one task that sorts them all: rows are dealt to
    ranges by all columns of order, numbered within their range, and shifted by the counts of the ranges before."""
    dealt = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order))  # so that ranges stay as they are
    at = dealt.withColumn("__at", F.monotonically_increasing_id())  # the range, and below 33 bits the place in it
    at = at.withColumns({"__part": F.shiftright("__at", 33), "__nth": F.col("__at").bitwiseAND((1 << 33) - 1) + 1})
    counts = at.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out_rows = at.join(F.broadcast(before), "__part")  # a row a range
    return out_rows.withColumn(out, F.concat(F.lit("sample_"), (F.col("__nth") + F.col("__before")).cast("string"))).drop("__part", "__nth", "__before", "__at")


def instruction_rows(rows: DataFrame) -> DataFrame:
    """instruction, input (empty) and output of samples."""
    return rows.select("instruction", F.lit("").alias("input"), "output")


def reward_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instruction, input, ground_truth) of samples whose output is a JSON array of whole errors, and the
    others with their fault. input is the text in the instruction."""
    truths = F.try_variant_get(json_value(T.trimmed(F.col("output"))), "$", "array<variant>")
    read = rows.withColumn("__truths", truths).withColumn("fault", F.when(json_value(T.trimmed(F.col("output"))).isNull(), "no JSON").otherwise(truth_fault(F.col("__truths"))))
    whole = "array<struct<error_location: string, error_type: string, error_explanation: string>>"
    good = read.where("fault is null").select(T.trimmed(F.col("instruction")).alias("instruction"), T.between_markers(T.trimmed(F.col("instruction")), TEXT_MARK, RULE).alias("input"), F.from_json("output", whole).alias("ground_truth"))
    return good, read.where("fault is not null").drop("__truths")


def sample_ok(instruction: Column, output: Column) -> Column:
    """A sample with an instruction that is not blank and a JSON array as output."""
    return F.coalesce((T.trimmed(instruction) != "") & F.schema_of_variant(json_value(output)).startswith("ARRAY"), F.lit(False))


def sample_stats(rows: DataFrame) -> DataFrame:
    """One row: samples, errors, mean errors, samples with several, and their per cent; no row of no samples."""
    several = F.count_if(F.col("error_count") > 1)
    n = F.count(F.lit(1))
    out = rows.agg(n.alias("samples"), F.sum("error_count").alias("errors"), F.avg("error_count").alias("mean_errors"), several.alias("several"), F.try_divide(100.0 * several, n).alias("several_pct"))
    return out.where("samples > 0")


def error_types(rows: DataFrame) -> DataFrame:
    """error_type and n, the most frequent first, then in order of the type."""
    return rows.select(F.explode("error_types").alias("error_type")).groupBy("error_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error_type")


def applied_counts(records: DataFrame, key: str) -> DataFrame:
    return records.groupBy(key).agg(F.count_if("applied").alias("n_applied"))


def applied_distribution(counts: DataFrame) -> DataFrame:
    """n_applied, papers with so many, and over all papers: total, least, most and mean."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = counts.groupBy("n_applied").agg(F.count(F.lit(1)).alias("papers"))  # as many rows as different counts
    total = F.sum("papers").over(every)
    return per.withColumns({"total": total, "least": F.min("n_applied").over(every), "most": F.max("n_applied").over(every), "mean": F.sum(F.col("n_applied") * F.col("papers")).over(every) / total})


def to_run(papers: DataFrame, done: DataFrame, key: str, least: int) -> DataFrame:
    """papers that have no count of applied edits in done (key, n_applied), or too small a one."""
    return papers.join(done, key, "left").where(F.col("n_applied").isNull() | (F.col("n_applied") < least)).drop("n_applied")
