"""Number rules: guarded ratios, clamps, rewards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillframe.functions import text as T
from quillframe.functions.parse import json_value, stable_json


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def sample_std(x: Column) -> Column:
    """Sample deviation; 0 for one value, null for none."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def clamp01(x: Column, default: float | None = 0.5) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.try_cast("double"), F.lit(default).cast("double"))))


def delta_bucket(delta: Column) -> Column:
    return F.when(delta.isNull(), "UNKNOWN").when(delta < 0, "DROP").otherwise("NON_DROP")


@F.pandas_udf(DoubleType())
def round_half_even_binary(x: pd.Series) -> pd.Series:
    """Rounds to two places as IEEE doubles do when printed exactly; no native function gives these values."""
    return x.map(lambda v: round(v, 2), na_action="ignore")


#: Weights of a reward, and what rows get that cannot be judged: fixed values.
PRECISION_WEIGHT, CONCISENESS_WEIGHT = 0.6, 0.4
NO_OUTPUT, NO_TRUTH, NO_ANSWER = -0.5, -0.3, 0.0


def reward(precision: Column, conciseness: Column) -> Column:
    return PRECISION_WEIGHT * precision + CONCISENESS_WEIGHT * conciseness


def judged_reward(output: Column, truth: Column, scores: Column) -> Column:
    """The reward of an output against a truth's JSON text by a judge's scores, a variant: the penalty of
    the first that fails of a blank output, a truth that is no JSON, and a judge without an answer;
    missing scores are 0."""
    blank = lambda c: T.trimmed(F.coalesce(c, F.lit(""))) == ""
    score = lambda n: F.coalesce(F.try_variant_get(scores, f"$.{n}", "double"), F.lit(0.0))
    out = F.when(blank(output), NO_OUTPUT).when(blank(truth) | json_value(T.trimmed(truth)).isNull(), NO_TRUTH)
    return out.when(scores.isNull(), NO_ANSWER).otherwise(reward(score("precision"), score("conciseness")))


def config_key(parts: list[str]) -> Column:
    """SHA-1 of the parts, nested ones too, as JSON with the keys of all records in order and numbers as Python writes them."""
    return F.sha1(stable_json(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})))


def finite01(x: Column) -> Column:
    """x within 0 to 1; null for what is no finite number."""
    v = x.try_cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def tokens_estimate(text: Column, per_token: float = 3.5) -> Column:
    return F.floor(F.length(text) / per_token).cast("int")


def completion_budget(context: Column, used: Column, spare: int, most: int, least: int = 100) -> Column:
    return F.greatest(F.lit(least), F.least(context - used - spare, F.lit(most)))


def prompt_mark(prompt: Column, n: int = 10) -> Column:
    """The first characters of a prompt's SHA-1."""
    return F.substring(F.sha1(prompt), 1, n)


def reward_key(output: Column, truth: Column) -> Column:
    """What rewards are kept by: the MD5 of an output and a truth; the mark between them is fixed."""
    return F.md5(F.concat(output, F.lit("|||"), truth))


def iso_now(now: Column) -> Column:
    """A time in UTC as ISO text with a Z; give the time, so that results can be repeated."""
    return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def cut_tokens(text: Column, ids: Column, most: int, decoded: Column) -> Column:
    """text where ids are at most `most`, else decoded, what the first `most` ids stand for, with the
    bracket closed that opens it."""
    short = decoded
    short = F.when(short.startswith("[") & ~short.endswith("]"), F.concat(short, F.lit("]"))).when(short.startswith("{") & ~short.endswith("}"), F.concat(short, F.lit("}"))).otherwise(short)
    return F.when(F.size(ids) <= most, text).otherwise(short)
