"""Ground truths, findings and their matches: projections, repairs and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import numeric as N
from quillframe.functions import text as T
from quillframe.operators.checks import kind, string
from quillframe.operators.matching import applied_edits
from quillframe.sources.files import is_object

#: Fields of a finding and of a ground truth in a judge's prompt, and the kinds of risk a planner may name: fixed values.
FINDING_FIELDS = ["id", "type", "section_location", "error_location", "explanation", "confidence", "proposed_fix"]
TRUTH_FIELDS = ["id", "difficulty", "section_location", "error_location", "explanation", "needs_cross_section"]
NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def truths(edits: DataFrame, results: DataFrame, key: str, order: str) -> DataFrame:
    """Ground truths of the edits (key, order, id, difficulty, location, target_find, error_explanation,
    needs_cross_section) that results (key, id, applied) say were applied, or of all edits of a paper
    where none was: renamed, trimmed, and numbered anew from 1."""
    kept = applied_edits(edits, results, key, "id")
    number = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return kept.select(
        key, number.alias("id"), "difficulty", T.trimmed(F.col("location")).alias("section_location"), T.trimmed(F.coalesce("target_find", F.lit(""))).alias("error_location"),
        T.trimmed(F.coalesce("error_explanation", F.lit(""))).alias("explanation"), "needs_cross_section",
    )


def minimal(items: Column, fields: list[str]) -> Column:
    """An array of structs with only these fields, as JSON, null fields kept."""
    return F.to_json(F.transform(items, lambda x: F.struct(*[x[f].alias(f) for f in fields])), {"ignoreNullFields": "false"})


def enriched(matches: DataFrame, truths_: DataFrame, key: str, pos: str) -> DataFrame:
    """matches with the columns of the ground truth of the same place; null where there is none."""
    return matches.join(truths_.select(key, pos, *TRUTH_FIELDS[1:]), [key, pos], "left")


def paper_counts(matches: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """key, gt, hits, matched_preds (different numbers of findings that matches name) and findings, of
    matches (key, matched, matched_pred_indices) and findings (key, ...)."""
    named = matches.select(key, F.explode("matched_pred_indices").alias("i")).groupBy(key).agg(F.countDistinct("i").alias("matched_preds"))
    of = matches.groupBy(key).agg(F.count(F.lit(1)).alias("gt"), F.count_if("matched").alias("hits"))
    n = findings.groupBy(key).agg(F.count(F.lit(1)).alias("findings"))
    out = of.join(named, key, "left").join(n, key, "left")
    return out.select(key, "gt", "hits", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("matched_preds", "findings")])


def stored_or_derived(evals: DataFrame, v: str = "v") -> DataFrame:
    """evals with gt, findings, matched_preds, recall, precision and f1 of each paper: as stored in the
    variant v where they are numbers, else derived from its matches and counts, else 0."""
    at = F.col(v)
    whole = lambda f: F.when(kind(at, f).isin("BIGINT", "BOOLEAN"), F.coalesce(F.try_variant_get(at, f"$.{f}", "bigint"), F.try_variant_get(at, f"$.{f}", "boolean").cast("bigint")))
    number = lambda f: F.when(kind(at, f).rlike(NUMBER), F.try_variant_get(at, f"$.{f}", "double"))
    matches = F.try_variant_get(at, "$.matches", "array<variant>")
    hits = F.size(F.filter(matches, lambda m: F.coalesce(F.try_variant_get(m, "$.matched", "boolean") & (kind(m, "matched") == "BOOLEAN"), F.lit(False))))
    named = F.flatten(F.transform(matches, lambda m: F.coalesce(F.try_variant_get(m, "$.matched_pred_indices", "array<variant>"), F.array().cast("array<variant>"))))
    named = F.filter(F.transform(named, lambda x: F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "bigint"))), lambda x: x.isNotNull())
    out = evals.withColumns({"gt": F.coalesce(whole("ground_truth_count"), F.lit(0)), "findings": F.coalesce(whole("finding_count"), F.lit(0))})
    derived = F.when(matches.isNotNull(), F.size(F.array_distinct(named)).cast("long"))
    out = out.withColumn("matched_preds", F.coalesce(whole("matched_pred_count"), derived, F.lit(0)))
    out = out.withColumn("recall", F.coalesce(number("detection_rate"), F.when(matches.isNotNull(), N.ratio(hits, F.col("gt"))), F.lit(0.0)))
    out = out.withColumn("precision", F.coalesce(number("precision"), N.ratio(F.col("matched_preds"), F.col("findings"))))
    return out.withColumn("f1", F.coalesce(number("f1_score"), N.f1(F.col("precision"), F.col("recall"))))


def truth_items(v: Column) -> Column:
    """The ground truths of a paper's variant as (corruption_type, difficulty, location, needs_cross_section):
    its applied results, or without any its ground_truth list, or else all edits of its log; those that
    lack one of the first three are left out."""
    listed = lambda path: F.try_variant_get(v, path, "array<variant>")
    objects = lambda xs: F.filter(xs, is_object)
    applied = F.filter(listed("$.apply_results"), lambda g: is_object(g) & F.coalesce((kind(g, "applied") == "BOOLEAN") & F.try_variant_get(g, "$.applied", "boolean"), F.lit(False)))
    others = F.coalesce(objects(listed("$.ground_truth")), objects(listed("$.audit_log.edits")), F.array().cast("array<variant>"))
    source = T.bound(applied, lambda xs: F.when(F.size(xs) > 0, xs).otherwise(others))
    text = lambda g, f: T.trimmed(F.try_variant_get(g, f"$.{f}", "string"))

    def item(g: Column) -> Column:
        type_ = T.bound(text(g, "corruption_type"), lambda x: F.when(x != "", x).otherwise(text(g, "type")))
        place = F.coalesce(text(g, "location"), text(g, "section_location"))
        cross = F.coalesce(F.try_variant_get(g, "$.needs_cross_section", "boolean"), F.lit(False))
        return F.struct(type_.alias("corruption_type"), text(g, "difficulty").alias("difficulty"), place.alias("location"), cross.alias("needs_cross_section"))

    return F.filter(F.transform(source, item), lambda g: F.coalesce((g["corruption_type"] != "") & (g["difficulty"] != "") & (g["location"] != ""), F.lit(False)))


def findings(v: Column, default_type: str | None = "other", section: Column | None = None) -> Column:
    """The findings of an answer's variant: those with a section, a place and an explanation that are not
    blank, confidence within 0 to 1 and 0.5 where it is no number. A single object counts as a list.

    default_type stands for a missing type; None leaves such findings out. section is the place of
    findings that name none. Where several of these are asked of one answer, name read_findings() as a column.
    """
    return kept_findings(read_findings(v), default_type, section)


def read_findings(v: Column) -> Column:
    """All findings of an answer's variant with their texts trimmed, empty where they are missing or no text."""
    listed = F.coalesce(F.try_variant_get(v, "$.findings", "array<variant>"), F.when(kind(v, "findings").startswith("OBJECT"), F.array(F.try_variant_get(v, "$.findings", "variant"))), F.array().cast("array<variant>"))
    clean = lambda f, name: T.trimmed(F.coalesce(string(f, name), F.lit("")))

    def one(f: Column) -> Column:
        said = F.try_variant_get(f, "$.confidence", "double")  # of texts too
        fields = {n: N.clamp01(said) if n == "confidence" else clean(f, n) for n in FINDING_FIELDS[1:]}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    return F.transform(F.filter(listed, is_object), one)


def kept_findings(read: Column, default_type: str | None = "other", section: Column | None = None) -> Column:
    """What findings() keeps of read_findings()."""
    stand_in = {"type": None if default_type is None else F.lit(default_type), "section_location": section}

    def one(f: Column) -> Column:
        fields = {n: f[n] if stand_in.get(n) is None else F.when(f[n] == "", stand_in[n]).otherwise(f[n]) for n in FINDING_FIELDS[1:]}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    def whole(f: Column) -> Column:
        ok = (f["error_location"] != "") & (f["explanation"] != "")
        for n, other in stand_in.items():
            ok = ok & (f[n] != "") if other is None else ok & ((f[n] != "") | (other != ""))
        return ok

    return F.transform(F.filter(read, whole), one)


def tasks(v: Column, risks: list[str]) -> Column:
    """A planner's tasks: missing ids are task_001, ... and missing sections Section 1, ...; unknown risks
    are other; hints that are an object are its values, and none if neither that nor a list."""

    def one(t: Column, i: Column) -> Column:
        field = lambda f: F.try_variant_get(t, f"$.{f}", "string")
        hints = F.coalesce(F.try_variant_get(t, "$.hints", "array<string>"), F.map_values(F.try_variant_get(t, "$.hints", "map<string, string>")), F.array().cast("array<string>"))
        nth = (i + 1).cast("string")
        return F.struct(
            F.coalesce(field("task_id"), F.concat(F.lit("task_"), F.lpad(nth, 3, "0"))).alias("task_id"), F.coalesce(field("section"), F.concat(F.lit("Section "), nth)).alias("section"),
            F.coalesce(F.try_variant_get(t, "$.pages", "array<int>"), F.array().cast("array<int>")).alias("pages"), F.when(field("risk_dimension").isin(risks), field("risk_dimension")).otherwise("other").alias("risk_dimension"), hints.alias("hints"),
        )

    return F.transform(F.coalesce(F.try_variant_get(v, "$.tasks", "array<variant>"), F.array().cast("array<variant>")), one)


def web_evidence(query: Column, answer: Column) -> Column:
    """The text of an answer found by a search; null for a blank one."""
    q, a = T.trimmed(F.coalesce(query, F.lit(""))), T.trimmed(F.coalesce(answer, F.lit("")))
    return F.when(a != "", F.when(q != "", F.concat(F.lit("[WEB] Q: "), q, F.lit("\nA: "), a)).otherwise(F.concat(F.lit("[WEB] "), a)))


def all_evidence(paper: Column, web: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(paper, none), F.filter(F.coalesce(web, none), lambda x: x.isNotNull()))


def phases(named: dict[str, DataFrame], order: str) -> DataFrame:
    """All findings of all phases, with phase and phase_no; nothing is dropped."""
    out = None
    for i, (name, df) in enumerate(named.items()):
        rows = df.withColumns({"phase_no": F.lit(i), "phase": F.lit(name)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def with_prior(tasks_: DataFrame, prior: DataFrame, key: str, section: str, order: str, fields: list[str]) -> DataFrame:
    """tasks_ with prior, the earlier findings of exactly their section, in order; empty if there are none."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__order"), *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    held = prior.groupBy(key, section).agg(rows.alias("prior"))
    return tasks_.join(held, [key, section], "left").withColumn("prior", F.coalesce("prior", F.slice(F.array(F.struct(*[F.lit(None).cast(prior.schema[f].dataType).alias(f) for f in fields])), 1, 0)))


def merged_or_given(given: Column, merged: Column) -> Column:
    """What a merger answered, or what it was given where that is empty or null."""
    return F.when(F.coalesce(F.size(merged), F.lit(0)) > 0, merged).otherwise(given)


def batch_summary(df: DataFrame, status: Column) -> DataFrame:
    """One row: total, ok, failed and skipped."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(status == s).alias(s) for s in ("ok", "failed", "skipped")])
