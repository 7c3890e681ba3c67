from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import numeric as N
from quillframe.functions import parse as P
from quillframe.functions import text as T
from quillframe.operators import blocks as B
from quillframe.operators import scoring as S


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_ranges(spark):
    assert one(spark, T.expand_ranges(F.col("t")), t="3-1,x,2, 7,5-") == [1, 2, 3, 7]
    assert one(spark, T.format_range(F.lit(2), F.lit(2))) == "2"


def test_lines_and_tags(spark):
    assert one(spark, T.norm_line(F.col("t")), t="## A  Title here. ") == "a title here"
    assert one(spark, T.norm_line(F.col("t")), t="12 - 3") == "" and one(spark, T.norm_line(F.col("t")), t="\t# Tabbed title\u00a0") == "tabbed title"
    assert one(spark, T.split_lines(F.col("t")), t="a\r\nb\u2028\x0bc\n") == ["a", "b", "", "c"] and one(spark, T.split_lines(F.col("t")), t="") == []
    assert one(spark, T.first_tag(F.col("t"), "k"), t="<k> a\nb </k><k>c</k>") == "a\nb"
    assert one(spark, T.strip_fence(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.drop_reasoning(F.col("t")), t="<THINK>x\ny</think> z") == " z"
    assert one(spark, T.drop_reasoning(F.col("t")), t="<THINK>x</THINK> z") == "<THINK>x</THINK> z"
    assert one(spark, T.first_tag(F.col("t"), "t"), t="<t>\nfoo\u00a0\n</t>") == "foo"
    assert one(spark, T.strip_fence(F.col("t")), t="```Python\nx\n```\n") == "Python\nx"
    assert one(spark, T.strip_fence(F.col("t")), t="\u2003```JSON\nJson [1]\n```") == "[1]"
    assert one(spark, T.keywords(F.col("t")), t="\ta\n,\u00a0,b c\r") == ["a", "b c"]
    assert one(spark, T.safe_name(F.col("t")), t="é/a b") == "é_a_b"


def test_citations(spark):
    keys = lambda t: one(spark, T.citation_keys(F.col("t")), t=t)
    assert keys("O-Neil et al.,\n2020; Lee & Kim, 2019 and LeCun et al., 1998, LECUN et al., 1998 [007] [000]") == ["o-neil|2020", "lecun|1998", "lee|2019", "7", "0"]
    assert keys("Müller et al., 2020; smith et al., 2020; Smith et al. 2020; Lee and Kim 2019") == []


def test_rounding_as_doubles_print(spark):
    x = spark.createDataFrame([(v,) for v in (0.125, 2.675, 0.005, 0.015, 0.145)], "v double")
    assert [r[0] for r in x.select(N.round_half_even_binary("v")).collect()] == [0.12, 2.67, 0.01, 0.01, 0.14]


def test_std_of_one_is_zero(spark):
    x = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 3.0), ("c", None)], "k string, v double")
    got = {r["k"]: r["std"] for r in S.metric_stats(x, ["k"], "v").collect()}
    assert got["a"] == 0.0 and round(got["b"], 6) == 1.414214 and got["c"] is None


def test_edits_see_earlier_ones(spark):
    edits = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(a).alias("find"), F.lit(b).alias("replacement")) for i, (a, b) in enumerate((("b", "xx"), ("xx", "y"), ("zz", "q"), ("", "0")))])
    got = one(spark, B.apply_edits(F.array(F.lit(None).cast("string"), F.lit("ab"), F.lit("bb")), edits, around=1))
    assert got["texts"] == [None, "0ay", "bb"]
    assert [tuple(r) for r in got["records"]] == [(0, True, 1, 1, "a", ""), (1, True, 1, 1, "a", ""), (2, False, None, None, None, None), (3, True, 1, 0, "", "a")]


def test_untitled_blocks_extend_a_run_until_a_gap(spark):
    x = spark.createDataFrame([("p", 1, "A"), ("p", 2, None), ("p", 4, None), ("p", 5, "B"), ("p", 6, "B"), ("p", 7, "A")], "p string, i long, t string")
    got = sorted((r.start_index, r.end_index, r.title) for r in B.section_runs(x, "p", "i", "t").collect())
    assert got == [(1, 2, "A"), (5, 6, "B"), (7, 7, "A")]


def test_id_repair_keeps_given_ids(spark):
    x = spark.createDataFrame([("p", i, v) for i, v in enumerate([None, 1, 0, 3, None])], "p string, i long, v int")
    assert [r.fixed_id for r in S.repair_ids(x, "p", "i", "v").orderBy("i").collect()] == [2, 1, 4, 3, 5]


def test_header_lines_count_once_a_block_and_go_everywhere(spark):
    rows = [("p", 0, "text", "Running head\nbody one"), ("p", 1, "text", "Running head\nmore\n# Running Head"), ("p", 2, "image_url", "Running head"), ("p", 3, "text", "Running head"), ("p", 4, "text", "x\nRunning head\ny"), ("q", 0, "text", "Running head\n ")]
    x = spark.createDataFrame(rows, "p string, i int, type string, text string")
    assert [tuple(r) for r in B.header_footer(x, "p", "i").collect()] == [("p", "running head", 3, 4)]
    got = {(r.p, r.i): r.text for r in B.strip_header_footer(x, "p", "i").collect()}
    assert got == {("p", 0): "Running head\nbody one", ("p", 1): "more", ("p", 2): "Running head", ("p", 4): "x\ny", ("q", 0): "Running head\n "}


def test_reviews_are_split_by_the_first_way_that_works(spark):
    a, b = "a" * 500, "b" * 600
    split = lambda t: one(spark, T.split_reviews(F.col("t")), t=t)
    assert split(f"{a}\n--------\n{b}") == [a, b] and split(f"x\n--------\n{b}") == [f"x\n--------\n{b}"]
    assert split(f"lead\nReviewer # 2 :\n{a}\n\nREVIEWER 3:\n{b}") == [f"Reviewer # 2 :\n{a}", f"REVIEWER 3:\n{b}"]
    assert split(f"## Summary\n{a}\n## Strengths\ns\n## Summary\n{b}") == [f"## Summary\n{a}\n## Strengths\ns\n## Summary\n{b}"]
    assert split(f"## Summary\n{a}\n## Strengths\ns\n## Summary\n{b}\n### overall") == [f"## Summary\n{a}\n## Strengths\ns", f"## Summary\n{b}\n### overall"]
    assert split(" \n") == []


def test_json_in_noise(spark):
    read = lambda t: (lambda v: v.toPython() if v is not None else None)(one(spark, P.embedded_json(F.col("t")), t=t))
    assert read(" [1] ") == [1] and read('a {"k": 1} b } c') == {"k": 1}
    assert read('{"k": 1}}') == {"k": 1} and read('x {"k": 1} and {"j": 1') == {"k": 1} and read("none") is None
