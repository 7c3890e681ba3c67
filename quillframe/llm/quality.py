"""Quality rules with adaptive thresholds, with DataFrame functions only.

Each document gets four measures. Quantile sketches of the measures, counts on a fixed grid of
logarithmic cells, are built per language and source with map-side partial counts and merged per
language and over all rows. Counts merge exactly in any order, so reruns agree, and a quantile is
within half a per cent of its value. Two quantiles of each are read; a group's fence is the upper
one plus a multiple of their distance, which has a floor per measure so that a uniform group does
not fence off ordinary text. Word length takes the quartiles. Symbols, duplicate lines and repeated
words, which most texts of any group have none of, take the median and the 90th or 95th percentile, so
that their fences follow the group's tail and, where that is ordinary, lie well below what the base rule
takes. A group's sketch is mixed with some rows of its language's, and a language's with some of all rows',
so small groups have the fences of larger ones around them, without a size at which that changes. Documents
are joined with their group's fences and fail if a measure is outside.

Defined cases: null or empty text has no words and fails the base rule; null language or source is
a group of its own; repeated rows are judged alike; empty tables give empty results; extra columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm.common import SPACES, WORD, cut, documents, text_or_empty

#: Rows of its language that count with a group's own, and of all rows with a language's, and the points that stand for them.
PRIOR, POINTS = 25, 20
#: The sketches' grid: largest value of the first cell, and the growth of a cell, twice the relative error of a quantile.
LEAST, GRID = 1e-4, 0.01
QUARTILES, TENTH, TAIL = (0.25, 0.75, 6.0), (0.5, 0.9, 3.0), (0.5, 0.95, 3.0)
#: Measure: smallest distance of its two quantiles that counts, whether low values fail as well, the quantiles and the multiple.
MEASURES = {"word_length": (0.5, True, QUARTILES), "symbol_rate": (0.04, False, TENTH), "duplicate_line_rate": (0.08, False, TAIL), "repeated_word_rate": (0.03, False, TAIL)}


def base_columns(df: DataFrame) -> DataFrame:
    """df (with text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    Repeats of 5-word windows are found inside each row: 64-bit hashes of the windows are sorted as
    a primitive array, and only texts with equal neighbours sort (hash, position) pairs to see which
    positions are covered. Two different windows of one text share a hash with probability 2^-64.
    """
    text = text_or_empty()
    df = df.withColumns({
        "__words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        "word_chars": F.length(F.regexp_replace(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "__lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
    })
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"), "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__windows": F.expr("if(size(__words) < 5, cast(array() as array<bigint>), transform(sequence(0, size(__words) - 5), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2], __words[i + 3], __words[i + 4])))"),
    })
    df = df.withColumn("__sorted", F.sort_array("__windows"))
    df = df.withColumn("__any", F.expr("exists(transform(__sorted, (h, i) -> i > 0 and h = get(__sorted, i - 1)), x -> x)"))
    df = df.withColumn("__pairs", F.expr("if(__any, sort_array(transform(__windows, (h, i) -> struct(h as h, i as i))), null)"))
    df = df.withColumn("__starts", F.expr("sort_array(transform(filter(__pairs, (p, i) -> p.h = get(__pairs, i - 1).h or p.h = get(__pairs, i + 1).h), p -> p.i))"))
    covered = F.expr("aggregate(transform(__starts, (s, i) -> least(5, coalesce(get(__starts, i + 1) - s, 5))), 0, (a, x) -> a + x)")
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return df.drop("__words", "__lines", "__windows", "__sorted", "__any", "__pairs", "__starts")


def _measures() -> dict[str, Column]:
    n = F.greatest("n_words", F.lit(1))
    return {
        "word_length": F.col("word_chars") / n, "symbol_rate": F.col("n_symbols") / n,
        "duplicate_line_rate": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "repeated_word_rate": F.col("n_repeat_words") / n,
    }


def _cell(x: Column) -> Column:
    """The cell of the grid that has x: 0 up to LEAST, then cells that grow by GRID."""
    return F.when(x <= LEAST, F.lit(0)).otherwise(1 + F.floor(F.log(x / LEAST) / math.log(1 + GRID))).cast("int")


def _middle(cell: Column) -> Column:
    return F.when(cell == 0, F.lit(0.0)).otherwise(LEAST * F.pow(F.lit(1 + GRID), cell - 0.5))


def sketches(judged: DataFrame) -> DataFrame:
    """lang, source, measure, cell, n: the quantile sketch of each measure of each group, as counts of cells."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), _cell(F.col(m)).alias("cell")) for m in MEASURES])
    rows = judged.where("not base_failed").select("lang", "source", F.explode(each).alias("e"))
    return rows.groupBy("lang", "source", "e.measure", "e.cell").agg(F.count(F.lit(1)).alias("n"))


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))


def _points(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """PRIOR rows that stand for a sketch: its quantiles at POINTS even places, the cells that have one with their share."""
    of = Window.partitionBy(*keys, "measure")
    upto, rows = F.sum("n").over(of.orderBy("cell")), F.sum("n").over(of)
    points = sketch.withColumns({"__upto": upto, "__rows": rows})
    passed = lambda n: F.floor(n * POINTS / F.col("__rows") + 0.5 + 1e-6)
    points = points.withColumn("n", passed(F.col("__upto")) - passed(F.col("__upto") - F.col("n")))
    return points.where("n > 0").select(*keys, "measure", "cell", (F.col("n") * (PRIOR / POINTS)).alias("n"))


def _mixed(own: DataFrame, keys: list[str], prior: DataFrame, on: list[str]) -> DataFrame:
    """own with the prior's rows of the same values of on added to each group."""
    groups = own.select(*keys, "measure").distinct()
    held = prior.select(*[F.col(c).alias(f"__{c}") for c in on], F.col("measure").alias("__measure"), "cell", "n")
    match = F.col("measure") == F.col("__measure")
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return _summed(own.unionByName(groups.join(held, match).select(*keys, "measure", "cell", "n")), keys)


def fences(judged: DataFrame) -> DataFrame:
    """One row per (lang, source): low and high fence of each measure.

    Sketches are aggregated once per group and cut; those of languages and of all rows are merged from them.
    Every group's sketch gets PRIOR rows of its language's, and a language's PRIOR rows of all rows', so a
    fence follows its group the more, the more rows the group has, at every size by one rule.
    """
    leaf = cut(sketches(judged)).withColumn("n", F.col("n").cast("double"))
    whole = _points(_summed(leaf, []), [])
    langs = _points(_mixed(_summed(leaf, ["lang"]), ["lang"], whole, []), ["lang"])
    merged = _mixed(leaf, ["lang", "source"], langs, ["lang"])
    of = Window.partitionBy("lang", "source", "measure")
    merged = merged.withColumns({"upto": F.sum("n").over(of.orderBy("cell")), "rows": F.sum("n").over(of)})
    picks = []
    for m, (_, _, (lower, upper, _)) in MEASURES.items():
        for end, q in (("a", lower), ("b", upper)):
            picks.append(_middle(F.min(F.when((F.col("measure") == m) & (F.col("upto") >= q * F.col("rows") - 1e-6), F.col("cell")))).alias(f"{m}_{end}"))
    out = merged.groupBy(F.col("lang").alias("__lang"), F.col("source").alias("__source")).agg(*picks)
    for m, (floor, _, (_, _, wide)) in MEASURES.items():
        a, b = F.col(f"{m}_a"), F.col(f"{m}_b")
        reach = F.greatest(b - a, F.lit(floor)) * wide
        out = out.withColumns({f"{m}_low": a - reach, f"{m}_high": b + reach})
    return cut(out.select("__lang", "__source", *[f"{m}_{e}" for m in MEASURES for e in ("low", "high")]))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base columns, base_failed, the measures, and kept."""
    rows = base_columns(docs.select("doc_id", "lang", "source", "text")).drop("text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = cut(rows.withColumn("base_failed", failed).withColumns(_measures()))
    out = rows.join(fences(rows), F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    inside = F.lit(True)
    for m, (_, low, _) in MEASURES.items():
        inside = inside & F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True))
        if low:
            inside = inside & F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & inside)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES)
