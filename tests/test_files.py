from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillframe.sources import files, sinks
from quillframe.streaming import log


@pytest.fixture
def root(tmp_path):
    for paper, names in {"a": ["final.json", "synth_m.json"], "b": ["final.json"], "c_eval": ["synth_m.json"]}.items():
        (tmp_path / paper).mkdir()
        for n in names:
            (tmp_path / paper / n).write_text(json.dumps({"paper": {"content": [{"t": 1}, 2]}, "é": None}, indent=2))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "bad.json").write_bytes(b'{"k": "x\xff"}')
    (tmp_path / "d" / "empty.json").write_text(" ")
    return tmp_path


def names(df):
    return sorted((r["folder"], r["file"]) for r in df.collect())


def test_discovery(spark, root):
    scan = files.scan_text(spark, str(root), "*.json")
    assert names(files.tagged(scan, "synth")) == [("a", "synth_m.json"), ("c_eval", "synth_m.json")]
    assert names(files.tagged_or_exact(scan, "synth_m.json", "final")) == [("a", "synth_m.json")]
    assert names(files.tagged_or_exact(scan, "none.json", "final")) == [("a", "final.json"), ("b", "final.json")]
    assert names(files.preferred(scan, ["synth_m.json", "final.json"])) == [("a", "synth_m.json"), ("b", "final.json"), ("c_eval", "synth_m.json")]
    assert names(files.in_named_folders(spark, str(root), "final.json")) == [("a", "final.json"), ("b", "final.json")]
    assert names(files.matching(scan, folder="b", file=None)) == [("b", "final.json")]
    assert files.folders(scan).count() == 4
    (root / "empty").mkdir()
    listed = [r.folder for r in files.all_folders(spark, str(root)).collect()]
    assert listed == sorted(p.name for p in root.iterdir() if p.is_dir()) and "empty" in listed


def test_json(spark, root):
    strict = {r["file"]: r["v"] for r in files.scan_json(spark, str(root / "d")).collect()}
    loose = {r["file"]: r["v"].toPython() for r in files.scan_json(spark, str(root / "d"), lenient=True).collect()}
    assert strict["empty.json"] is None and loose == {"bad.json": {"k": "x"}, "empty.json": {}}
    blocks = files.scan_json(spark, str(root / "a")).select(F.size(files.content(F.col("v"))).alias("n")).collect()
    assert [r["n"] for r in blocks] == [2, 2]


def test_samples_and_sinks(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"q": "1", "a": "x"}, 5, {"q": "2"}]))
    good, bad = sinks.split_rejects(files.samples(files.scan_json(spark, str(tmp_path), "s.json"), ["q", "a"]))
    assert [r["index"] for r in good.collect()] == [0]
    assert sorted((r["index"], r["reason"]) for r in bad.collect()) == [(1, "not an object"), (2, "missing a")]
    with pytest.raises(ValueError):
        sinks.write_parquet(bad.limit(0), str(tmp_path / "p"))
    sinks.write_parquet(bad, str(tmp_path / "p"))
    with pytest.raises(Exception):
        sinks.write_parquet(bad, str(tmp_path / "p"))
    old, new = spark.sql("select 1 k, 'x' v union all select 2, 'y'"), spark.sql("select 2 k, 'z' v")
    assert sorted(map(tuple, sinks.with_run(old, new, ["k"]).collect())) == [(1, "x"), (2, "z")]
    assert sinks.with_run(old, new, ["k"], replace=False).count() == 3
    assert sinks.once(old, spark.sql("select 2 k, 'z' v union all select 3, '\t\n' union all select 4, 'w'"), ["k"], "v").collect() == [(4, "w")]
    sinks.write_json(spark.sql("select 1 k, cast(null as string) v"), str(tmp_path / "j"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"k":1,"v":null}']


def test_lenient_files_drop_bytes_that_are_no_text(spark, tmp_path):
    for name, raw in {"a": b'{"k": "x\xff\xc3\xef\xbf\xbdy\xe4\xb8"}', "b": b" \n", "c": b"{x", "d": '{"k": "\ufffd"}'.encode()}.items():
        (tmp_path / f"{name}.json").write_bytes(raw)
    got = {r.file: r.v for r in files.scan_json(spark, str(tmp_path), lenient=True).select("file", files.F.to_json("v").alias("v")).collect()}
    assert got == {"a.json": '{"k":"x\ufffdy"}', "b.json": "{}", "c.json": None, "d.json": '{"k":"\ufffd"}'}


def test_settings_files(spark, tmp_path):
    from quillframe.sources import remote

    (tmp_path / "s.yml").write_text("# c\nllm:\n  retries: 10\n  delay: 1.5   # s\n  deep:\n    name: 'a: b'\nempty:\non: true\nword: two words\nback: null\n")
    config = remote.read_settings(spark, str(tmp_path / "s.yml"))
    assert config == {"llm": {"retries": 10, "delay": 1.5, "deep": {"name": "a: b"}}, "empty": None, "on": True, "word": "two words", "back": None}
    assert remote.setting(config, "llm.deep.name") == "a: b" and remote.setting(config, "llm.none", 3) == 3
    (tmp_path / "t.yml").write_text("- item\n")
    with pytest.raises(ValueError, match="no setting"):
        remote.read_settings(spark, str(tmp_path / "t.yml"))


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def take(name, lines):
        (tmp_path / "in" / name).write_text("\n".join(lines))
        stream = log.events(spark, str(tmp_path / "in"), "k int, t int, v string")
        assert log.keep_latest(stream, str(tmp_path / "check"), ["k"], ["t"]).awaitTermination(120)
        return sorted(map(tuple, log.current(spark, str(tmp_path / "check"), ["k", "t", "v"]).collect()))

    first = ['{"k":1,"t":1,"v":"a"}', "", "junk", "[1]", '{"k":1,"t":3,"v":"b"}', '{"k":2,"t":1,"v":"c"}']
    assert take("0.jsonl", first) == [(1, 3, "b"), (2, 1, "c")]
    assert take("1.jsonl", ['{"k":1,"t":2,"v":"old"}', '{"k":2,"t":5,"v":"d"}']) == [(1, 3, "b"), (2, 5, "d")]


def test_files_of_rows_are_written_by_all_tasks_without_a_folder_each(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i % 2}", str(i), f"text {i}\nü") for i in range(40)], "f string, n string, value string").coalesce(1)
    sinks.write_files(rows, f"file:{tmp_path}/out", "f", "n", "value")
    assert sorted(p.relative_to(tmp_path / "out").as_posix() for p in (tmp_path / "out").rglob("*")) == sorted(["f=p0", "f=p1", *(f"f=p{i % 2}/n={i}.txt" for i in range(40))])
    got = {(r.folder, r.file): r.value for r in files.scan_text(spark, f"{tmp_path}/out", name="*.txt").collect()}
    assert got == {(f"f=p{i % 2}", f"n={i}.txt"): f"text {i}\nü\n" for i in range(40)}
    with pytest.raises(FileExistsError):
        sinks.write_files(rows, f"{tmp_path}/out", "f", "n", "value")
