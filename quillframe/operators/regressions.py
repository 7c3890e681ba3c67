"""Runs that compare reviews: reading old and new forms, filters, joins of reviews, and containers of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import numeric as N
from quillframe.functions import text as T
from quillframe.sources.files import is_object

#: Measures of an alignment, fields of a configuration that name a group, and names of variants: fixed values.
MEASURES = ["strength_coverage_recall", "weakness_coverage_recall", "ai_extra_major_points_rate", "symmetric_coverage_similarity"]
GROUP_FIELDS = ["metric", "judge_model", "review_agent", "ai_model", "ai_review_file", "temperature", "max_tokens", "timeout_s"]
LEGACY_FIELDS = ["judge_model", "review_agent", "ai_model", "ai_review_file", "metric"]
ORIGIN, SYNTHETIC = "paper_origin", "paper_synth_"


def number(v: Column, path: str) -> Column:
    """A double at a path of a variant, from a number or a string; null for other values."""
    return F.coalesce(F.try_variant_get(v, path, "double"), T.trimmed(F.try_variant_get(v, path, "string")).try_cast("double"))


def got(v: Column, path: list[str], kind: str, default: Column) -> Column:
    """The value at the end of a path of names, default where a step is missing."""
    return F.coalesce(F.try_variant_get(v, "$." + ".".join(path), kind), default)


def alignment(v: Column) -> Column:
    """The measures of an alignment within 0 to 1 and rounded to two places, 0 where they are no numbers, and its note."""
    scores = [N.round_half_even_binary(N.clamp01(number(v, f"$.{m}"), 0.0)).alias(m) for m in MEASURES]
    return F.struct(*scores, T.trimmed(F.coalesce(F.try_variant_get(v, "$.note", "string"), F.lit(""))).alias("note"))


def runs(v: Column) -> Column:
    """The runs of a file's variant, as variants: its list of runs, or one made of the fields of an old
    file that has an alignment of its own; else none."""
    listed = F.filter(F.try_variant_get(v, "$.runs", "array<variant>"), is_object)
    config = F.concat_ws(",", *[F.concat(F.lit(f'"{f}":'), F.coalesce(F.to_json(F.try_variant_get(v, f"$.{f}", "variant")), F.lit('"unknown"' if f == "metric" else "null"))) for f in LEGACY_FIELDS])
    old = F.parse_json(F.concat(F.lit('{"config":{'), config, F.lit('},"config_key":null,"alignment":'), F.to_json(F.try_variant_get(v, "$.alignment", "variant")), F.lit("}")))
    single = F.when(is_object(F.try_variant_get(v, "$.alignment", "variant")), F.array(old))
    return F.coalesce(F.when(F.size(F.try_variant_get(v, "$.runs", "array<variant>")) > 0, listed), single, F.array().cast("array<variant>"))


def group_config(config: Column) -> Column:
    """The fields of a configuration's variant that name a group, those it has, as a map to JSON."""
    had = F.array(*[F.struct(F.lit(f).alias("k"), F.to_json(F.try_variant_get(config, f"$.{f}", "variant")).alias("v")) for f in GROUP_FIELDS])
    return F.map_from_entries(F.filter(had, lambda e: e["v"].isNotNull()))


def group_key(config_key: Column, config: Column) -> Column:
    """What groups runs: their key, or the JSON of group_config() in order of names."""
    entries = F.array_sort(F.transform(F.map_entries(config), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])))
    return F.when(F.coalesce(config_key, F.lit("")) != "", F.concat(F.lit("config_key:"), config_key)).otherwise(F.concat(F.lit("config:{"), F.array_join(entries, ", "), F.lit("}")))


def whole_rows(rows: DataFrame, measures: list[str]) -> DataFrame:
    """rows whose measures are all finite numbers, each within 0 to 1."""
    out = rows.withColumns({m: N.finite01(F.col(m)) for m in measures})
    for m in measures:
        out = out.where(F.col(m).isNotNull())
    return out


def filtered(rows: DataFrame, **wanted: str) -> DataFrame:
    """rows whose columns equal what is wanted; an empty string asks nothing."""
    for column, value in wanted.items():
        if value:
            rows = rows.where(F.col(column) == value)
    return rows


def by_drop(rows: DataFrame, delta: str, unknown: bool = False, least_drop: float = 0.0) -> DataFrame:
    """rows with bucket (DROP, NON_DROP, UNKNOWN): without UNKNOWN unless asked for, and without drops smaller than least_drop."""
    out = rows.withColumn("bucket", N.delta_bucket(F.col(delta)))
    out = out if unknown else out.where("bucket <> 'UNKNOWN'")
    return out.where((F.col("bucket") != "DROP") | (F.col(delta) <= -least_drop)) if least_drop > 0 else out


def compared(rates: DataFrame, kind: str) -> DataFrame:
    """Rows of scoring.drop_rate_lift(), the highest rate first, then the most rows, then by kind."""
    return rates.withColumn("total", F.col("d") + F.col("n")).orderBy(F.desc("drop_rate"), F.desc("total"), kind)


def counted(rows: DataFrame, bucket: str, value: str, most: int) -> DataFrame:
    """bucket, value, n, pct of the bucket: the `most` most frequent values of each bucket, ties by value."""
    per = rows.groupBy(bucket, value).agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy(bucket)
    per = per.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(of)).withColumn("nth", F.row_number().over(of.orderBy(F.desc("n"), value)))
    return per.where(F.col("nth") <= most)


def variant_name(model: Column) -> Column:
    """The folder of a paper's variant: the original, or the one made by a model."""
    return F.when(F.coalesce(model, F.lit("")) == "", ORIGIN).otherwise(F.concat(F.lit(SYNTHETIC), model))


def eval_path(paper: Column, mode: Column, detector: Column, stem: Column, judge: Column) -> Column:
    """Where the evaluation of a paper lies: the form is fixed."""
    return F.concat(paper, F.lit("/detect/"), mode, F.lit("_eval/"), detector, F.lit("/"), stem, F.lit("/eval_"), T.model_tag(judge), F.lit(".json"))


def eval_keys(path: Column) -> Column:
    """paper, mode, detector, stem and judge of such a path; null if it is none."""
    pattern = r"^(.*)/detect/([^/]*)_eval/([^/]*)/([^/]*)/eval_([^/]*)\.json$"
    fields = [F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(("paper", "mode", "detector", "stem", "judge"))]
    return F.when(path.rlike(pattern), F.struct(*fields))


def reviewed(human: DataFrame, machine: DataFrame, key: str, text: str) -> DataFrame:
    """Papers that have both reviews, with human and machine text; blank ones count as missing."""
    a, b = (df.where(T.trimmed(F.col(text)) != "").select(key, F.col(text).alias(n)) for df, n in ((human, "human"), (machine, "machine")))
    return a.join(b, key)


def before_and_after(reviews: DataFrame, key: list[str], stage: str, text: str, first: str = "baseline", last: str = "final") -> DataFrame:
    """The first and the last review of each paper and variant that has both, read once."""
    of = lambda name: F.max(F.when(F.col(stage) == name, F.col(text)))
    return reviews.groupBy(*key).agg(of(first).alias("baseline"), of(last).alias("final")).where("baseline is not null and final is not null")


def with_keyed_run(old: DataFrame, new: DataFrame, paper: str, key: str, overwrite: bool = False) -> DataFrame:
    """Runs of containers by paper: new runs are added; overwrite drops the old ones of the same paper and
    key, otherwise papers that have the key keep theirs and take no new one."""
    if overwrite:
        return old.join(new.select(paper, key), [paper, key], "left_anti").unionByName(new)
    return old.unionByName(new.join(old.select(paper, key), [paper, key], "left_anti"))


def with_fresh_container(old: DataFrame, new: DataFrame, paper: str, overwrite: bool = False) -> DataFrame:
    """Runs of containers by paper: new runs are added; overwrite drops all old runs of their papers."""
    return (old.join(new.select(paper), paper, "left_anti") if overwrite else old).unionByName(new)


def copied_names(selected: DataFrame, name: str, order: list[str]) -> DataFrame:
    """selected with target: the name for the first of its name, name__1, name__2, ... for the next."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    return selected.withColumn("target", F.when(nth == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("__"), nth.cast("string"))))
