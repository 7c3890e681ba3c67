from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillframe.functions import boxes as X
from quillframe.functions import numeric as N
from quillframe.functions import parse as P
from quillframe.functions import text as T
from quillframe.operators import checks as C
from quillframe.operators import figures as G
from quillframe.operators import matching as J
from quillframe.operators import model as M


def one(spark, column, text=""):
    return spark.range(1).select(F.lit(text).alias("t")).select(column.alias("x")).first()["x"]


def listed():
    return F.try_variant_get(F.try_parse_json("t"), "$", "array<variant>")


EDIT = {"id": 1, "corruption_type": "a", "difficulty": "hard", "location": "L", "rationale": "r", "error_explanation": "e", "target_find": "f", "replacement": "", "needs_cross_section": False}


@pytest.mark.parametrize(
    ("change", "fault"),
    [({}, None), ({"corruption_type": "b"}, "corruption_type"), ({"difficulty": 1}, "difficulty"), ({"needs_cross_section": "true"}, "needs_cross_section"), ({"location": " "}, "location"),
     ({"location": "x" * 100}, None), ({"location": "x" * 101}, "location too long"), ({"error_explanation": "x" * 2001}, "error_explanation too long"), ({"replacement": None}, "replacement"), ({"id": 2}, "duplicate id")],
)
def test_edit_faults(spark, change, fault):
    text = json.dumps([EDIT | {"id": 2}, EDIT | change])
    assert one(spark, C.edit_fault(listed(), ["a"], 1, 3), text) == fault


def test_sets_of_edits(spark):
    assert one(spark, C.edit_fault(listed(), ["a"], 1, 3), "{}") == "no list"
    assert one(spark, C.edit_fault(listed(), ["a"], 1, 3), "[]") == "count"
    assert one(spark, C.edit_fault(listed(), ["a"], 1, 3), "[5]") == "missing fields"
    assert one(spark, C.truth_fault(listed()), '[{"error_location": 1, "error_type": 1, "error_explanation": 1}, {}]') == "missing fields"


def test_match_faults(spark):
    good = {"gt_index": 0, "matched": True, "matched_pred_indices": [1], "rationale": "r"}
    faults = [(good, None), (good | {"gt_index": 1}, None), (good | {"gt_index": 2}, "gt_index"), (good | {"gt_index": "0"}, "gt_index"), (good | {"matched": 1}, "matched"), (good | {"matched_pred_indices": ["1"]}, "matched_pred_indices"), (good | {"rationale": ""}, "rationale")]
    assert [one(spark, C.match_fault(listed(), F.lit(1)), json.dumps([m])) for m, _ in faults] == [f for _, f in faults]
    assert one(spark, C.match_fault(listed(), F.lit(2)), json.dumps([good])) == "count"


def test_complete_items(spark):
    items = [{"a": "x", "n": 1}, {"a": " ", "n": 1}, {"a": "x", "n": "1"}, 3, {"n": 2}]
    assert one(spark, F.size(C.complete(listed(), ["a"], ["n"])), json.dumps(items)) == 1


def test_edits_without_applied_ones_all_stay(spark):
    edits = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1), ("q", 2), ("r", 1)], "p string, id int")
    results = spark.createDataFrame([("p", 1, True), ("p", 2, False), ("q", 1, False)], "p string, id int, applied boolean")
    assert sorted(map(tuple, J.applied_edits(edits, results, "p", "id").collect())) == [("p", 1), ("q", 1), ("q", 2), ("r", 1)]


def test_first_block_with_a_needle(spark):
    blocks = spark.createDataFrame([("p", 1, "abc"), ("p", 2, "xbcy bc"), ("q", 1, None)], "p string, i int, t string")
    needles = spark.createDataFrame([("p", "bc"), ("p", "bc"), ("p", "cy"), ("p", "zz"), ("p", ""), ("q", "a")], "p string, n string")
    rows = J.first_containing(blocks, needles, "p", "i", "t", "n", around=2).collect()
    assert len(rows) == 6  # repeated needles stay
    got = {(r.p, r.n): (r.pos, r.offset, r.before, r.after) for r in rows}
    none = (None,) * 4
    assert got == {("p", "bc"): (1, 1, "a", ""), ("p", "cy"): (2, 2, "xb", " b"), ("p", "zz"): none, ("p", ""): none, ("q", "a"): none}


def test_flags_of_indices_from_zero_or_one(spark):
    def flags(indices):
        m = F.array(*[F.struct(F.lit(i).alias("gt_index"), F.lit(True).alias("matched")) for i in indices])
        return [int(x) for x in one(spark, J.hit_flags(m, F.lit(3)))]

    assert flags([0, 1, 2]) == [1, 1, 1] and flags([1, 2, 3]) == [0, 1, 1] and flags([7]) == [1, 0, 0] and flags([None, 9, 2, None, None]) == [1, 1, 1]


def test_parts_of_larger_boxes_go(spark):
    rows = [(b, p, i) for i, (b, p) in enumerate((((0, 0, 10, 10), 1), ((1, 1, 5, 5), 1), ((20, 0, 30, 10), 1), ((-1, 0, 9, 10), 1), ((1, 1, 4, 5), 2), ((1, 1, 4, 5), None), (None, 1)))]
    boxes = spark.createDataFrame(rows, "b struct<x0: int, y0: int, x1: int, y1: int>, p int, i int")
    kept = G.without_parts(boxes, ["p"], "b", ["i"]).orderBy("i").collect()
    assert [(r.b.x0, r.b.x1) for r in kept] == [(0, 10), (20, 30), (-1, 9), (1, 4), (1, 4)]
    assert one(spark, X.from_size(F.lit(1), F.lit(1), F.lit(0), F.lit(2))) is None


def test_texts(spark):
    assert one(spark, T.headed_sections(F.col("t")), "lead\n# A\none\n# B\n\n## two\n#no\n# A\nthree") == {"B": "## two\n#no", "A": "three"}
    assert one(spark, T.headed_sections(F.col("t")), "none") == {}
    assert one(spark, T.paragraphs(F.col("t")), "a\nb\n \n\nc\n\n") == ["a\nb", "c"]
    assert one(spark, T.keywords(F.col("t")), "a, ,b ") == ["a", "b"]
    assert one(spark, T.cut_to(F.col("t"), 3, "..."), "abcd") == "abc..." and one(spark, T.cut_to(F.col("t"), 4, "..."), "abcd") == "abcd"
    assert one(spark, T.data_uri(F.col("t").cast("binary"), F.lit("image/png")), "x" * 60).endswith("eHh4" * 20)
    assert one(spark, P.widest_braces(F.col("t")), 'x {"a": 1} y').toPython() == {"a": 1} and one(spark, P.widest_braces(F.col("t")), "x") is None


def test_numbers(spark):
    assert [one(spark, N.finite01(F.col("t")), v) for v in ("0.5", "7", "-1", "NaN", "Infinity", "x")] == [0.5, 1.0, 0.0, None, None, None]
    assert one(spark, N.tokens_estimate(F.col("t")), "x" * 8) == 2
    assert [one(spark, N.completion_budget(F.lit(c), F.lit(900), 50, 400)) for c in (1000, 1200, 9000)] == [100, 250, 400]


def test_model_calls(spark):
    waits, calls = [], iter([M.RateLimited(), M.TimedOut(), "ok"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert M.retried(call, 3, waits.append) == ("ok", None) and waits == [2.0, 3.0]
    assert M.retried(lambda: " ", 2, waits.append) == (None, "empty")
    answers, waits = iter(['{"b": 1}', 'x {"a": null}', 'y {"a": 2} z']), []
    assert M.retried(lambda: next(answers), 5, waits.append, key="a", pauses=M.Wait("backoff", first=3, most=4)) == ('y {"a": 2} z', None) and waits == [3, 4]
    assert M.retried(lambda: '{"b": 1}', 2, key="a") == ('{"b": 1}', "no a")
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "k int, answer_to string")
    got = sorted(map(tuple, M.complete(df, "answer_to", M.Stub(lambda p: p.upper())).collect()))
    assert got == [(1, "a", "A", None), (2, None, None, None), (3, "", None, "empty")]


def test_message_contents(spark):
    texts = ['"a"', '["a", {"type": "text", "text": "b"}, {"type": "image"}]', '{"k":1}']
    assert [one(spark, M.message_text(F.parse_json("t")), t) for t in texts] == ["a", "a\nb", '{"k":1}']
