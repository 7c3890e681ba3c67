"""Reviews and comparisons of reviews, as Column expressions, and the entries that citations point to."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import numeric as N
from quillframe.functions import text as T
from quillframe.functions.text import trimmed
from quillframe.operators.search import in_cells, occurrences
from quillframe.sources.files import is_object

#: Titles of a list of references: fixed values.
REFERENCE_TITLES = ["references", "reference", "bibliography"]
#: Pairs of a key and an entry of a paper up to which they are compared one by one; a cell takes longer than these to begin.
PAIRS = 1024
#: The kind of difference that explains a score, and the kind of all unknown ones: fixed values.
SCORE_SHIFT, OTHER = "score_rationale_shift", "other"


def three_sections(text: Column) -> Column:
    """Summary, Strengths and Weaknesses with their texts, from heading lines of any depth or number.

    A blank text is empty. Without one of the headings all of it becomes the summary; with headings
    in another order it stays as it is.
    """
    body = trimmed(F.coalesce(text, F.lit("")))
    lines = F.split(body, r"\r\n|\r|\n")
    bare = F.transform(lines, lambda x: F.lower(trimmed(F.regexp_replace(trimmed(F.regexp_replace(x, r"^\s*#{1,6}\s*", "")), r"^\s*\d+\s*[).-]\s*", ""))))
    bare = F.transform(bare, lambda x: F.when(x.isin("weakness", "weakness / concerns", "weaknesses / concerns"), "weaknesses").otherwise(x))
    a, b, c = (F.array_position(bare, F.lit(h)).cast("int") for h in ("summary", "strengths", "weaknesses"))

    def between(first: Column, stop: Column) -> Column:
        inner = trimmed(F.array_join(F.slice(lines, first + 1, F.greatest(F.lit(0), stop - first - 1)), "\n"))
        return F.when(inner == "", "- (empty)").otherwise(inner)

    split = F.concat(F.lit("Summary\n"), between(a, b), F.lit("\n\nStrengths\n"), between(b, c), F.lit("\n\nWeaknesses\n"), between(c, F.size(lines) + 1), F.lit("\n"))
    whole = F.concat(F.lit("Summary\n"), body, *[F.lit(f"\n\n{h}\n- (not explicitly separated)") for h in ("Strengths", "Weaknesses")], F.lit("\n"))
    return F.when(body == "", "").when((a == 0) | (b == 0) | (c == 0), whole).when((a < b) & (b < c), split).otherwise(F.concat(body, F.lit("\n")))


def reviewers(text: Column, labels: dict[str, int]) -> Column:
    """A struct a reviewer of the i-th score of each label, clamped to the label's maximum; as many as every label has."""

    def paired(scores: Column) -> Column:
        sizes = [F.size(scores[k]) for k in labels]
        n = F.least(*sizes) if len(sizes) > 1 else sizes[0]
        rows = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
        return F.slice(F.transform(rows, lambda i: F.struct(*[F.get(scores[k], i).alias(k) for k in labels])), F.lit(1), n)

    return T.bound(F.struct(*[s.alias(k) for k, s in T.score_lists(text, labels).items()]), paired)


def picked(differences: Column, mode: str, k: int = 3) -> Column:
    """top1, topk, all, or score_shift_only of an array of differences."""
    if mode == "score_shift_only":
        return F.filter(differences, lambda d: F.trim(d["diff_type"]) == SCORE_SHIFT)
    take = {"top1": 1, "topk": max(1, k), "all": None}[mode]
    return differences if take is None else F.slice(differences, 1, take)


def _string(v: Column, path: str) -> Column:
    return trimmed(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))


def _number(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "double")  # of texts too


def _known(x: Column, known: list[str], default: str) -> Column:
    return F.when(x.isin(known), x).otherwise(default)


def regression(v: Column, scales: list[str], kinds: list[str], types: list[str], types_field: str = "types", most: int = 8) -> Column:
    """score_delta and differences of a comparison, a variant: the delta is computed anew and rounded as
    doubles print, unknown words become 'unknown' or 'other', differences without a summary go, and at
    most `most` differences, and types of each, are read."""
    base, final = _number(v, "$.score_delta.baseline_score"), _number(v, "$.score_delta.final_score")
    delta = F.struct(base.alias("baseline_score"), final.alias("final_score"), N.round_half_even_binary(final - base).alias("delta"), _known(_string(v, "$.score_delta.scale_hint"), scales, "unknown").alias("scale_hint"))

    def one(d: Column) -> Column:
        named = F.transform(F.slice(F.coalesce(F.try_variant_get(d, f"$.{types_field}", "array<variant>"), F.array().cast("array<variant>")), 1, most), lambda t: _string(t, "$"))
        quotes = F.struct(*[_string(d, f"$.evidence.{q}").alias(q) for q in ("baseline_quote", "final_quote")])
        return F.struct(
            _known(_string(d, "$.diff_type"), kinds, OTHER).alias("diff_type"), _string(d, "$.summary").alias("summary"),
            F.array_distinct(F.filter(named, lambda t: t.isin(types))).alias("types"), _string(d, "$.why_impacts_score").alias("why"), quotes.alias("evidence"),
        )

    listed = F.coalesce(F.try_variant_get(v, "$.differences", "array<variant>"), F.array().cast("array<variant>"))
    rows = F.transform(F.filter(F.slice(listed, 1, most), lambda d: F.coalesce(is_object(d), F.lit(False))), one)
    return F.struct(delta.alias("score_delta"), F.filter(rows, lambda d: d["summary"] != "").alias("differences"))


def reference_blocks(blocks: DataFrame, section: str = "section", kind: str = "type") -> DataFrame:
    return blocks.where(F.lower(trimmed(F.col(section))).isin(REFERENCE_TITLES) & (F.col(kind) == "text"))


def cited_entries(entries: DataFrame, keys: DataFrame, paper: str, pos: str, text: str, key: str) -> DataFrame:
    """keys, repeated rows too, with pos and text of the first entry of the paper that each names: 'name|year'
    by both words in it, the name in any case, 'n' by a line that starts with [n]. Keys that name none have nulls.

    Names and years meet entries one by one in papers of at most PAIRS pairs of the two, and are searched together in
    cells of larger papers; numbers meet by the numbers that lines begin with.
    """
    once, kind = keys.select(paper, key).distinct(), {c: entries.schema[c].dataType.simpleString() for c in (paper, pos)}
    named = once.where(F.contains(key, F.lit("|"))).withColumns({"__name": F.lower(F.split_part(F.col(key), F.lit("|"), F.lit(1))), "__year": F.split_part(F.col(key), F.lit("|"), F.lit(2))})

    def look(b: pa.Table, n: pa.Table) -> pa.Table:
        b = b.sort_by([(pos, "ascending"), (text, "ascending")])
        everywhere, within = np.arange(b.num_rows), {}
        for lower, column in ((True, "__name"), (False, "__year")):
            words = n[column].unique().to_pylist()
            which, where, _ = occurrences(b["__lower" if lower else text].to_pylist(), words)
            edges = np.searchsorted(which, np.arange(len(words) + 1))
            within |= {(lower, w): where[edges[i] : edges[i + 1]] if w else everywhere for i, w in enumerate(words)}
        both = [np.intersect1d(within[True, name], within[False, year], assume_unique=True)[:1] for name, year in zip(n["__name"].to_pylist(), n["__year"].to_pylist())]
        first = pa.array([int(x[0]) if len(x) else None for x in both], pa.int64())
        hit = first.is_valid()
        own, found = n.filter(hit), b.take(first.filter(hit))
        return pa.table({paper: own[paper], key: own[key], "pos": found[pos], "text": found[text]})

    held = entries.where(F.col(text).isNotNull() & F.col(pos).isNotNull()).select(paper, F.col(pos), F.col(text))
    schema = f"`{paper}` {kind[paper]}, `{key}` string, pos {kind[pos]}, text string"
    lowered = held.withColumn("__lower", F.lower(text))
    of = lambda df, n: df.groupBy(F.col(paper).alias("__of")).agg(F.count(F.lit(1)).alias(n))
    small = of(held, "__n").join(of(named, "__m"), "__of").where(F.col("__n") * F.col("__m") <= PAIRS).select("__of")
    in_small = named[paper] == small["__of"]
    near = lowered.select(F.col(paper).alias("__in"), F.col(pos).alias("pos"), F.col(text).alias("text"), "__lower")
    each = named.join(small, in_small, "left_semi").join(near, F.col(paper) == F.col("__in")).where(F.contains("__lower", "__name") & F.contains("text", "__year")).select(paper, key, "pos", "text")
    by_name = each.unionByName(in_cells(lowered, named.join(small, in_small, "left_anti"), paper, F.col(text), F.col(key), look, schema))
    numbers = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\s*\[([^\[\]]*)\]"), F.lit(1)))
    by_number = held.select(F.col(paper).alias("__of"), F.col(pos).alias("pos"), F.col(text).alias("text"), F.explode(numbers).alias("__number"))
    by_number = once.where(~F.contains(key, F.lit("|"))).join(by_number, (F.col(paper) == F.col("__of")) & (F.col(key) == F.col("__number"))).select(paper, key, "pos", "text")
    first = by_name.unionByName(by_number).groupBy(paper, key).agg(F.min(F.struct(F.col("pos").alias(pos), F.col("text").alias(text))).alias("e"))
    return keys.join(first, [paper, key], "left").select(*keys.columns, "e.*")
