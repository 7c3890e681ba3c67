"""JSON in texts, against plain versions."""

from __future__ import annotations

import json
import math
import re
import time

import numpy as np
from pyspark.sql import functions as F

from quillframe.functions import parse as P
from quillframe.sources import files


def values(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column(F.col("t")).alias("v")).orderBy("i").collect()
    return [None if r.v is None else r.v.toPython() for r in rows]


ODD = [
    '{"a":1,"a":2}', '{"x":{"a":1,"b":0,"a":[2,{"c":1,"c":3}]}}', '{"a":NaN,"b":-Infinity,"c":[Infinity]}', '{"a":1} x', "[1,2] 3", "1],[2", "1,2", '1,"quillframe: the value ends here":0}, {', "",
    " ", "nul", "null", '"abc"', "-0.5", '{"a":01}', "{'a':1}", '{"a":"x\ty"}', '{"a":"\\u00e9\\"}', '{"a":1e400}', '{"a":1e400,"a":-1e400}', "﻿{}", "[" * 100_000, "{" * 100_000, '{"a":' * 5000 + "1" + "}" * 5000, '{"a": "}{"}', "[]", "{}", '{"b":1,"a":{}}',
]


def plain(text):
    """The value as Python reads it, constants as strings; None where it reads none or it is null."""
    try:
        x = json.loads(text, parse_constant=str)
    except (ValueError, RecursionError):
        return None
    depth = lambda v: 1 + max(map(depth, v.values() if isinstance(v, dict) else v), default=0) if isinstance(v, dict | list) else 0
    try:
        return x if depth(x) <= 900 else None
    except RecursionError:
        return None


def same(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if {a, b} & {math.inf, -math.inf}:
        return str(a).lower()[:4] == str(b).lower()[:4]
    return a == b or not isinstance(a, str) and not isinstance(b, str) and a is not None and b is not None and float(a) == float(b)


def test_json_as_python_reads_it(spark):
    for text, got in zip(ODD, values(spark, P.json_value, ODD)):
        assert same(got, plain(text)), (text[:60], got)


def plain_embedded(text):
    text = text.strip()
    tries = [text]
    start, end = text.find("{"), text.rfind("}")
    if 0 <= start < end:
        for _ in range(5):
            tries.append(text[start : end + 1])
            end = text.rfind("}", 0, max(0, end - 1))
            if end <= start:
                break
    shortest = re.search(r"\{(?:.|\n)*?\}", text) if len(text) < 10_000 else None
    return next((x for t in [*tries, *([shortest[0]] if shortest else [])] if (x := plain(t)) is not None), None)


def plain_object(text):
    raw = text.strip()
    for start in [i for i, c in enumerate(raw) if c == "{"]:
        for end in [i for i, c in enumerate(raw) if c == "}" and i > start][::-1]:
            if isinstance(plain(raw[start : end + 1]), dict):
                return raw[start : end + 1]
    return None


def noisy(n):
    rng, parts = np.random.default_rng(2), ['{"a":1}', '{"a":1,"a":{"b":2}}', "{", "}", '"', "\\", '{"s":"}{"}', " ", "x", '{"n":NaN}', "[1,", "]", ":", ",", '{"k":', '{"t":"\\"{"}', "null"]
    return ["".join(rng.choice(parts, int(rng.integers(1, 9)))) for _ in range(n)]


def test_values_in_noise(spark):
    texts = [*ODD, *noisy(1500)]
    for text, got in zip(texts, values(spark, P.embedded_json, texts)):
        assert same(got, plain_embedded(text)), (text[:80], got)


def test_first_objects_in_noise():
    found = 0
    for text in noisy(6000):
        got = P.find_object(text)
        assert got == plain_object(text), text
        found += got is not None
    assert found > 500


def test_long_texts_take_linear_time():
    began = time.process_time()
    for text in ["{" * 100_000, '{"a":' * 100_000, '{"a":{' * 50_000 + "}" * 90_000, '{"{":' * 60_000, '{"a":"' * 50_000, '{"a":[' * 30_000 + "x" + "]}" * 30_000, '{"' * 100_000]:
        P.find_object(text)
        P.find_json(text)
    assert time.process_time() - began < 20
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    assert json.loads(P.find_object("x" + deep)) is not None


def test_lines_and_files_with_repeated_keys_are_read(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1,"a":2}\n{"a":NaN}\n{"a":3} x\n[1]\n{"a":{"b":1,"b":4}}\n')
    got = files.scan_jsonl(spark, str(tmp_path / "a.jsonl")).select(F.to_json("v").alias("v")).collect()
    assert sorted(r.v for r in got) == ['{"a":"NaN"}', '{"a":2}', '{"a":{"b":4}}']
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.json").write_text('{"a":1,"content":[],"a":2}')
    (tmp_path / "p" / "y.json").write_text('{"a":1} junk')
    got = {r.file: r.v for r in files.scan_json(spark, str(tmp_path / "p")).select("file", F.to_json("v").alias("v")).collect()}
    assert got == {"x.json": '{"a":2,"content":[]}', "y.json": None}
