"""Checks of model output held as variants: each gives the first fault of an array, null if it has none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions.text import bound, trimmed
from quillframe.sources.files import is_object

#: Fields that an edit must have: fixed values.
EDIT_FIELDS = ["id", "corruption_type", "difficulty", "location", "rationale", "error_explanation", "target_find", "replacement", "needs_cross_section"]
DIFFICULTIES = ["easy", "medium", "hard"]
#: Fields that a match must have: fixed values.
MATCH_FIELDS = ["gt_index", "matched", "matched_pred_indices", "rationale"]
#: Fields that a ground-truth entry must have: fixed values.
TRUTH_FIELDS = ["error_location", "error_type", "error_explanation"]


def kind(v: Column, field: str) -> Column:
    """The type of a field as schema_of_variant names it; null if the field is missing."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))


def string(v: Column, field: str) -> Column:
    """A field's value where it is a string."""
    return F.when(kind(v, field) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))


def lacks(v: Column, fields: list[str]) -> Column:
    return ~F.coalesce(is_object(v), F.lit(False)) | F.array_contains(F.array(*[kind(v, f).isNull() for f in fields]), F.lit(True))


def filled(v: Column, field: str) -> Column:
    return F.coalesce(trimmed(string(v, field)) != "", F.lit(False))


def first_fault(items: Column, fault: Callable[[Column, Column], Column]) -> Column:
    return F.get(F.filter(F.transform(items, fault), lambda x: x.isNotNull()), F.lit(0))


def edit_fault(edits: Column, types: list[str], least: int, most: int, snippet: int = 2000, replacement: int = 2000, location: int = 100, explanation: int = 2000) -> Column:
    """Of an array of edits; null edits are no list. One bad edit is a fault of the whole set."""
    texts = [f for f in EDIT_FIELDS if f not in ("id", "needs_cross_section")]

    def read(e: Column) -> Column:
        """Each field got once: the texts, null for what is none, the ids, and what is missing or of another type."""
        def kinds(x: Column) -> Column:
            named = [F.when(F.schema_of_variant(x[f]) == "STRING", F.try_variant_get(x[f], "$", "string")).alias(f) for f in texts]
            missing = x["id"].isNull() | x["needs_cross_section"].isNull()
            for f in texts:
                missing = missing | x[f].isNull()
            return F.struct(missing.alias("missing"), (F.schema_of_variant(x["needs_cross_section"]) == "BOOLEAN").alias("crosses"), F.to_json(F.struct(x["id"].alias("id"))).alias("id"), *named)

        return bound(F.struct(*[F.try_variant_get(e, f"$.{f}", "variant").alias(f) for f in EDIT_FIELDS]), kinds)

    def judged(rows: Column) -> Column:
        ids = F.transform(rows, lambda e: e["id"])
        return bound(ids, lambda ids: first_fault(rows, lambda e, i: fault(e, i, ids)))

    def fault(e: Column, i: Column, ids: Column) -> Column:
        out = F.when(e["missing"], "missing fields")
        out = out.when(~F.coalesce(e["corruption_type"].isin(types), F.lit(False)), "corruption_type")
        out = out.when(~F.coalesce(e["difficulty"].isin(DIFFICULTIES), F.lit(False)), "difficulty").when(~e["crosses"], "needs_cross_section")
        for field, size in (("location", location), ("rationale", None), ("error_explanation", explanation), ("target_find", snippet)):
            out = out.when(F.coalesce(trimmed(e[field]), F.lit("")) == "", field)
            if size:
                out = out.when(F.length(e[field]) > size, f"{field} too long")
        out = out.when(e["replacement"].isNull(), "replacement").when(F.length(e["replacement"]) > replacement, "replacement too long")
        return out.when(F.array_position(ids, e["id"]) < i + 1, "duplicate id")

    return F.when(edits.isNull(), "no list").when(~F.size(edits).between(least, most), "count").otherwise(bound(F.transform(edits, read), judged))


def match_fault(matches: Column, truths: Column) -> Column:
    """Of an array of matches against the number of truths; gt_index may count from 0 or 1."""

    def fault(m: Column, i: Column) -> Column:
        picked = F.try_variant_get(m, "$.matched_pred_indices", "array<variant>")
        whole = F.forall(picked, lambda x: F.schema_of_variant(x).isin("BIGINT", "BOOLEAN"))
        out = F.when(lacks(m, MATCH_FIELDS), "missing fields").when(~kind(m, "gt_index").isin("BIGINT", "BOOLEAN"), "gt_index")
        out = out.when(~F.coalesce(F.try_variant_get(m, "$.gt_index", "bigint").isin(i, i + 1), F.lit(False)), "gt_index")
        out = out.when(kind(m, "matched") != "BOOLEAN", "matched").when(~F.coalesce(whole, F.lit(False)), "matched_pred_indices")
        return out.when(~filled(m, "rationale"), "rationale")

    return F.when(matches.isNull(), "no list").when(F.size(matches) != truths, "count").otherwise(first_fault(matches, fault))


def truth_fault(truths: Column) -> Column:
    return F.when(truths.isNull(), "no list").otherwise(first_fault(truths, lambda t, i: F.when(lacks(t, TRUTH_FIELDS), "missing fields")))


def complete(items: Column, texts: list[str], numbers: list[str] = ()) -> Column:
    """The items that have all texts filled and all numbers as numbers."""
    number = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"

    def ok(v: Column) -> Column:
        tests = [filled(v, t) for t in texts] + [F.coalesce(kind(v, n).rlike(number), F.lit(False)) for n in numbers]
        return F.coalesce(is_object(v), F.lit(False)) & F.forall(F.array(*tests), lambda x: x)

    return F.filter(items, ok)
