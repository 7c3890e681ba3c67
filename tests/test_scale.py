"""Operators whose cost must not grow with pairs, against plain versions."""

from __future__ import annotations

import json
import re
import time
from hashlib import sha1

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.functions import numeric as N
from quillframe.functions import parse as P
from quillframe.functions import tokens as K
from quillframe.operators import figures as G
from quillframe.operators import matching as J
from quillframe.operators import reviews as R
from quillframe.operators import search
from quillframe.operators import selection as M

SF = "/root/testdata/sf0.001"


def test_occurrences_equal_find():
    rng = np.random.default_rng(0)
    for k in range(1500):
        letters = [list("ab"), list("abc "), list("é中😀ab")][k % 3]
        texts = ["".join(rng.choice(letters, int(rng.integers(0, 30)))) for _ in range(int(rng.integers(0, 6)))]
        needles = sorted({"".join(rng.choice(letters, int(rng.integers(0, 9)))) for _ in range(int(rng.integers(0, 12)))})
        want = sorted((i, j, t.find(n)) for i, n in enumerate(needles) for j, t in enumerate(texts) if n and n in t)
        assert list(zip(*[x.tolist() for x in search.occurrences(texts, needles)])) == want


def test_hashes_that_agree_by_chance_are_checked(monkeypatch):
    monkeypatch.setattr(search, "_mixed", lambda first, last: np.zeros(len(first), dtype=np.uint64))  # all needles of a length look alike
    texts, needles = ["abab cdcd", "cd", "xyz"], ["ab", "cd", "ba", "xyz", "yzz"]
    want = sorted((i, j, t.find(n)) for i, n in enumerate(needles) for j, t in enumerate(texts) if n in t)
    assert list(zip(*[x.tolist() for x in search.occurrences(texts, needles)])) == want


def test_needles_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(search, "CELL_TEXT", 100)
    monkeypatch.setattr(search, "CELL_NEEDLES", 40)
    rng = np.random.default_rng(1)
    blocks = [(p, i % 30, "".join(rng.choice(list("abcd"), 40))) for p in ("p", "q") for i in range(40)]
    needles = [("p", "".join(rng.choice(list("abcd"), int(rng.integers(1, 7))))) for _ in range(60)] + [("r", "a"), (None, "a")]
    got = J.first_containing(spark.createDataFrame(blocks, "p string, i int, t string"), spark.createDataFrame(needles, "p string, n string"), "p", "i", "t", "n", around=5).collect()
    want = []
    for p, n in needles:
        hits = sorted((i, t.find(n), t) for q, i, t in blocks if q == p and n in t)
        i, at, t = hits[0] if hits else (None, None, None)
        want.append((i, at, None if t is None else t[max(0, at - 5) : at]))
    assert sorted(map(repr, [(r.p, r.n, r.pos, r.offset) for r in got])) == sorted(map(repr, [(*n, w[0], w[1]) for n, w in zip(needles, want)]))
    assert {(r.n, r.before) for r in got if r.p == "p" and r.pos is not None} >= {(n[1], w[2]) for n, w in zip(needles, want) if w[0] is not None and len(n[1]) > 4}


def test_a_hundred_thousand_needles_in_one_paper(spark):
    text = "".join(np.random.default_rng(2).choice(list("abcdefghijklmnop "), 1_000_000))
    blocks = spark.createDataFrame([("p", i, text[1000 * i : 1000 * i + 1000]) for i in range(1000)], "p string, i int, t string")
    wanted = [text[1000 * (i % 1000) + i // 1000 * 9 : 1000 * (i % 1000) + i // 1000 * 9 + 12 + i % 7] for i in range(100_000)]
    began = time.time()
    got = J.first_containing(blocks, spark.createDataFrame([("p", w) for w in wanted], "p string, n string"), "p", "i", "t", "n")
    row = got.agg(F.count("pos").alias("found"), F.sum(F.col("pos") * 1000 + F.col("offset")).alias("places")).first()
    whole = [wanted[i] for i in range(0, 100_000, 997)]
    want = {w: text.find(w) for w in whole}
    some = {r.n: r.pos * 1000 + r.offset for r in got.where(F.col("n").isin(whole)).collect() if r.pos is not None}
    assert all(some[w] == at for w, at in want.items() if w in some and at // 1000 == (at + len(w) - 1) // 1000)
    assert row.found > 99_000 and time.time() - began < 120


def plain_entries(entries, keys):
    out = []
    for p, k in keys:
        hit = None
        for q, i, t in sorted(entries, key=lambda e: (e[1], e[2])):
            if q == p and ((k.split("|")[0].lower() in t.lower() and k.split("|")[1] in t) if "|" in k else re.search(rf"(?m)^\s*\[{k}\]", t)):
                hit = (i, t)
                break
        out.append((p, k, *(hit or (None, None))))
    return out


def test_cited_entries_equal_a_scan(spark, monkeypatch):
    monkeypatch.setattr(search, "CELL_TEXT", 200)
    rng = np.random.default_rng(3)
    names = ["Lee", "Li", "Allie", "O-Neil", "Kim"]
    entries = [(p, i, f"[{i % 9}] {rng.choice(names)} and {rng.choice(names)}\n  [{i % 7}] {2000 + i % 6}{'a' * (i % 3)}") for p in ("p", "q") for i in range(40)]
    keys = [(p, f"{str(n).lower()}|{y}") for p in ("p", "q", "r") for n in names for y in range(2000, 2008)] + [(p, str(i)) for p in ("p", "q") for i in range(12)] + [("p", "lee|"), ("p", "|2003"), ("p", "lee|2001"), ("p", "3")]
    got = R.cited_entries(spark.createDataFrame(entries, "p string, i int, t string"), spark.createDataFrame(keys, "p string, k string"), "p", "i", "t", "k")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_entries(entries, keys)))


@pytest.mark.parametrize("few, pivots", [(4096, 256), (8, 4)])
def test_order_statistics(spark, monkeypatch, few, pivots):
    monkeypatch.setattr(M, "FEW", few)
    monkeypatch.setattr(M, "PIVOTS", pivots)
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=700).tolist(), [5.0] * 300 + rng.integers(0, 9, 300).astype(float).tolist(), [float("nan"), 1.0, float("-inf"), 3.0, None], [2.5], [None]):
        table = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
        held = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
        ranks = [k for k in (0, 1, len(held) // 3, len(held) // 2, len(held) - 1, len(held) + 3) if k >= 0]
        got = M.order_statistics(table, "x", ranks)
        assert {k: repr(v) for k, v in got.items()} == {k: repr(held[k]) for k in ranks if k < len(held)}
    assert M.median(spark.createDataFrame([(1,), (4,), (9,), (None,), (4,)], "x int"), "x") == 4.0
    assert M.median(spark.createDataFrame([], "x int"), "x") is None


def test_medians_of_tables_need_no_single_task(spark):
    for table, column in (("documents", "n_chars"), ("events", "value"), ("lineitem", "l_extendedprice"), ("orders", "o_totalprice")):
        want = duckdb.sql(f"SELECT median({column}) FROM '{SF}/{table}.parquet'").fetchall()[0][0]
        assert abs(M.median(spark.read.parquet(f"{SF}/{table}.parquet"), column) - float(want)) < 1e-6


def plain_kept(boxes, pixels=2, share=0.1):
    area = lambda b: max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])
    kept = []
    for i, (page, b) in sorted(enumerate(boxes), key=lambda x: (-area(x[1][1]), x[0])):
        def within(k):
            out = k[0] - b[0], b[2] - k[2], k[1] - b[1], b[3] - k[3]
            wide, high = max(1e-6, k[2] - k[0]), max(1e-6, k[3] - k[1])
            return max(out) <= pixels or max(0.0, out[0] / wide, out[1] / wide, out[2] / high, out[3] / high) <= share
        if not any(q == page and area(k) > area(b) and within(k) for q, k in kept):
            kept.append((page, b))
    return sorted(kept)


def test_boxes_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    boxes = []
    for page in range(6):
        for _ in range(150):
            x, y, w, h = rng.integers(-60, 60), rng.integers(0, 60), *(rng.integers(0, 70, 2) if page % 2 else rng.integers(0, 9, 2) ** 2)
            boxes.append((page, tuple(float(v) for v in (x, y, x + w, y + h))))
    table = spark.createDataFrame([(i, p, b) for i, (p, b) in enumerate(boxes)], "i int, p int, b struct<x0: double, y0: double, x1: double, y1: double>").repartition(4)
    assert sorted((r.p, tuple(r.b)) for r in G.without_parts(table, ["p"], "b", ["i"]).collect()) == plain_kept(boxes)


def test_a_hundred_thousand_boxes_on_one_page(spark):
    x, y = F.col("id") % 400 * 50, F.floor(F.col("id") / 800) * 50
    inner = F.floor(F.col("id") / 400) % 2 == 1  # every second row of boxes lies within the one before it
    b = F.struct(*[c.cast("double").alias(n) for c, n in ((x + F.when(inner, 5).otherwise(0), "x0"), (y + F.when(inner, 5).otherwise(0), "y0"), (x + F.when(inner, 20).otherwise(40), "x1"), (y + F.when(inner, 20).otherwise(40), "y1"))])
    began = time.time()
    assert G.without_parts(spark.range(100_000).select("id", F.lit(1).alias("p"), b.alias("b")), ["p"], "b", ["id"]).count() == 50_000
    assert time.time() - began < 90


def test_tokens_equal_the_library(spark):
    import tiktoken

    path = K.installed("byte_bpe_50k.tiktoken")
    own = K.vocabulary(path)
    library = tiktoken.Encoding("own", pat_str=K.WORDS, mergeable_ranks=own.ranks, special_tokens={})
    rng = np.random.default_rng(6)
    odd = ["".join(rng.choice(list("ab c'strvel \n\t\r19é.,😀٣ж中ｗ\u3000\u00a0\u0301\x1c\x85 "), 300)) for _ in range(60)] + ["x" * 3000, "ab" * 2000, "", "[1, 2" * 40, "{" + "a b " * 60]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").unionByName(spark.createDataFrame([(t,) for t in [*odd, None]], "text string"))
    for r in docs.select("text", K.token_count(F.col("text"), path).alias("n"), K.cut_to_tokens(F.col("text"), 50, path).alias("cut"), K.token_count(F.col("text")).alias("estimate")).collect():
        if r.text is None:
            assert (r.n, r.cut, r.estimate) == (None, None, None)
            continue
        ids = library.encode_ordinary(r.text)
        want = r.text if len(ids) <= 50 else library.decode(ids[:50])
        if len(ids) > 50:
            want += "]" * (want.startswith("[") and not want.endswith("]")) + "}" * (want.startswith("{") and not want.endswith("}"))
        assert (r.n, r.cut, r.estimate) == (len(ids), want, int(len(r.text) / 3.5))


def test_stable_json(spark):
    texts = ['{"b":{"z":[1,{"y":null,"x":0.0}],"a":"é"},"a":1e22}', '{"b":1,"a":1,"b":2}', "[2, 1]", "x", None, '{"é":1,"z":2,"a b":true}']
    got = [r.v for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", P.stable_json(F.col("t")).alias("v")).orderBy("i").collect()]
    want = [json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":")) if t and t != "x" else None for t in texts]
    assert got == want
    row = spark.sql("select named_struct('z', 1, 'a', named_struct('y', 1.5D, 'b', array(named_struct('q', 'é', 'c', cast(null as int))))) v, 'x' u")
    key = row.select(N.config_key(["v", "u"]).alias("k")).first().k
    assert key == sha1('{"u":"x","v":{"a":{"b":[{"c":null,"q":"é"}],"y":1.5},"z":1}}'.encode()).hexdigest()


def test_parsed_once(spark):
    """A JSON text of a query is parsed by one expression of its plan, however often the rules on it name it."""
    from quillframe.plans import catalog

    for name, most in (("edit_validator", 1), ("truth_sources", 1), ("regression_normalise", 1), ("truth_validator", 1), ("match_validator", 1), ("parsed_findings", 1)):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parse_json") + plan.count("parseJson") == most, name


def test_small_papers_meet_no_cell(spark, monkeypatch):
    entries = [("p", i, f"Lee {2000 + i % 3}") for i in range(4)] + [("q", i, f"Kim, Lee {2000 + i % 7}") for i in range(40)]
    keys = [(p, f"{n}|{y}") for p in ("p", "q") for n in ("lee", "kim", "") for y in (2001, 2002, "")]
    got = {}
    for pairs in (0, 64, 1 << 20):
        monkeypatch.setattr(R, "PAIRS", pairs)
        df = R.cited_entries(spark.createDataFrame(entries, "p string, i int, t string"), spark.createDataFrame(keys, "p string, k string"), "p", "i", "t", "k")
        got[pairs] = sorted(map(repr, map(tuple, df.collect())))
    assert got[0] == got[64] == got[1 << 20] == sorted(map(repr, plain_entries(entries, keys)))


def test_reviews_with_headings_in_any_letters(spark):
    from quillframe.functions import text as T

    body = "x" * 600
    texts = [f"REVIEWER #1:\n{body}\nReviewer 2 -\n{body}", f"### SUMMARY\n{body}\n## Strengths\ny\n## sUmmary\n{body}\n## weaknesses\nz", f"review 1\n{body}\nsummary {body}"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(T.split_reviews(F.col("t")))).collect()]
    assert got == [2, 2, 1]


def test_ids_are_repaired_in_one_sort(spark):
    from quillframe.operators import scoring as S

    df = S.repair_ids(spark.createDataFrame([(1, i, g) for i, g in enumerate([None, 2, -1, 7, 2, None])], "k int, i int, g int"), "k", "i", "g")
    assert [r.fixed_id for r in df.orderBy("i").collect()] == [1, 2, 3, 7, 2, 4]
    assert df._jdf.queryExecution().sparkPlan().toString().count("Window [") == 1
