from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillframe.operators import reviews as R


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def test_three_sections(spark):
    def got(text):
        return one(spark, R.three_sections(F.col("t")), text)

    assert got("## Summary\na\n2) Strengths\n\n# Weakness\nc\nd") == "Summary\na\n\nStrengths\n- (empty)\n\nWeaknesses\nc\nd\n"
    assert got("Strengths\na\nSummary\nb\nWeaknesses") == "Strengths\na\nSummary\nb\nWeaknesses\n"
    assert got("x").startswith("Summary\nx\n\nStrengths\n- (not") and got(" ") == "" and got(None) == ""


def test_reviewers_take_the_shortest_list(spark):
    text = "- Overall (10): 12\nOverall (10): 7\n - Clarity (5): 3 - so\n- Overall (10): 4"
    assert [tuple(r) for r in one(spark, R.reviewers(F.col("t"), {"Overall": 10, "Clarity": 5}), text)] == [(10, 3)]
    assert one(spark, R.reviewers(F.col("t"), {"Overall": 10, "Clarity": 5}), "Overall (10): 1") == []


def test_regression(spark):
    v = {"score_delta": {"baseline_score": "5", "final_score": 4.675, "scale_hint": "??"}, "differences": [{"summary": " s ", "diff_type": "x", "types": ["a", "a", "zz", " b"]}, {"summary": ""}, 7]}
    got = one(spark, F.to_json(R.regression(F.parse_json("t"), ["ten"], ["score_rationale_shift"], ["a", "b"])), json.dumps(v))
    got = json.loads(got)
    assert got["score_delta"] == {"baseline_score": 5.0, "final_score": 4.675, "delta": round(4.675 - 5, 2), "scale_hint": "unknown"}
    assert [(d["diff_type"], d["summary"], d["types"]) for d in got["differences"]] == [("other", "s", ["a", "b"])]
    empty = json.loads(one(spark, F.to_json(R.regression(F.parse_json("t"), [], [], [])), "{}"))
    assert empty["differences"] == [] and empty["score_delta"] == {"scale_hint": "unknown"}


def test_picked(spark):
    d = F.from_json("t", "array<struct<diff_type string>>")
    text = json.dumps([{"diff_type": k} for k in ("a", "score_rationale_shift", "b")])
    assert [one(spark, F.size(R.picked(d, m, 2)), text) for m in ("top1", "topk", "all", "score_shift_only")] == [1, 2, 3, 1]
    with pytest.raises(KeyError):
        R.picked(d, "none")


def test_cited_entries(spark):
    blocks = spark.createDataFrame([("p", 1, " References ", "text", "[1] A. Smith 2020"), ("p", 2, "Bibliography", "text", "x\n [2] SMITH, 2020\n[04] Lee"), ("p", 3, "Intro", "text", "[3]")], "p string, i int, section string, type string, t string")
    keys = spark.createDataFrame([("p", "Smith|2020"), ("p", "2"), ("p", "2"), ("p", "3"), ("p", "4")], "p string, k string")
    rows = R.cited_entries(R.reference_blocks(blocks), keys, "p", "i", "t", "k").collect()
    assert len(rows) == 5 and {r.k: r.i for r in rows} == {"Smith|2020": 1, "2": 2, "3": None, "4": None}
