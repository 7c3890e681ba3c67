"""Which work is done already: predicates on the outputs of earlier runs, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.text import trimmed
from quillframe.operators.checks import kind
from quillframe.sources.files import is_object


def has_field(v: Column, field: str) -> Column:
    """An object that has the field, null or not."""
    return is_object(v) & kind(v, field).isNotNull()


def flagged(v: Column, flag: str, field: str) -> Column:
    """An object whose flag is true and that has the field."""
    return F.coalesce(has_field(v, field) & (kind(v, flag) == "BOOLEAN") & F.try_variant_get(v, f"$.{flag}", "boolean"), F.lit(False))


def has_run(v: Column, key: Column) -> Column:
    """An object with a run of this configuration key."""
    return F.coalesce(F.exists(F.try_variant_get(v, "$.runs", "array<variant>"), lambda r: F.try_variant_get(r, "$.config_key", "string") == key), F.lit(False))


def long_enough(size: Column, least: int = 50) -> Column:
    return F.coalesce(size > least, F.lit(False))


def no_findings(v: Column) -> Column:
    """An object whose findings are an empty list: such a run may be tried again."""
    return F.coalesce(is_object(v) & (F.size(F.try_variant_get(v, "$.findings", "array<variant>")) == 0), F.lit(False))


def left_to_do(work: DataFrame, outputs: DataFrame, key: str, done: Column) -> DataFrame:
    """work (key, ...) without the rows whose output (key, ...) is done."""
    return work.join(outputs.where(done).select(key), key, "left_anti")


def sample_state(records: DataFrame, sample: str, pos: str, kind_: str, status: str, prediction: str) -> DataFrame:
    """What a log of predictions and judgements leaves to do: whether a sample has either, whether the last of
    each succeeded, and the last prediction in either that is not blank. Samples with other records alone have neither."""
    of = lambda k: F.col(kind_) == k
    told = F.col(kind_).isin("pred", "judge") & (trimmed(F.col(prediction)) != "")
    last = lambda k: F.coalesce(F.max_by(F.when(of(k), F.col(status)), F.when(of(k), F.col(pos))) == "success", F.lit(False))
    done = lambda k: F.coalesce(F.bool_or(of(k)), F.lit(False))
    return records.groupBy(sample).agg(
        done("pred").alias("pred_done"), last("pred").alias("pred_success"), done("judge").alias("judge_done"), last("judge").alias("judge_success"),
        F.max_by(F.when(told, F.col(prediction)), F.when(told, F.col(pos))).alias("prediction"),
    )


def final_records(records: DataFrame, sample: str, pos: str, kind_: str) -> DataFrame:
    """The last judgement of each sample, or its last prediction where it has none: a full join of both in one pass."""
    rows = records.where(F.col(kind_).isin("pred", "judge"))
    rank = F.struct((F.col(kind_) == "judge").alias("judge"), pos)
    whole = F.struct(*[c for c in records.columns if c != sample])
    return rows.groupBy(sample).agg(F.max_by(whole, rank).alias("__r")).select(sample, "__r.*").select(*records.columns)
