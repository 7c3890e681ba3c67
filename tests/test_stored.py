"""Stored runs and the state of a log: crashes, restarts, repeats, places."""

from __future__ import annotations

import os
import shutil

import pytest

from quillframe.sources import stored
from quillframe.streaming import log

SCHEMA = "paper string, key string, run int"
OLD = [("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("a", None, 4), ("b", "x", 5), (None, "x", 6), ("c", "z", 7)]
NEW = [("a", "x", 10), ("a", "x", 11), ("a", None, 12), ("a", "w", 13), ("d", "x", 14), (None, "x", 15), ("b", "q", 16)]


def plain(how):
    """paper to its runs in order, by lists as files hold them."""
    by = {}
    for paper, key, run in OLD:
        by.setdefault(paper, []).append((key, run))
    fresh, last = set(), {}
    for paper, key, run in NEW:
        last[(paper, key)] = run
    new = NEW if how == "append" else [(p, k, r) for (p, k), r in sorted(last.items(), key=lambda x: x[1])]
    for paper, key, run in new:
        runs = by.setdefault(paper, [])
        hit = [i for i, (k, r) in enumerate(runs) if k == key]
        if how == "fresh" and paper not in fresh:
            runs.clear()
            fresh.add(paper)
        if how in ("first", "all") and hit:
            for i in hit[:1] if how == "first" else hit:
                runs[i] = (key, run)
        elif how == "remove" or how == "keep" and hit:
            by[paper] = [x for x in runs if x[0] != key] if how == "remove" else runs
        else:
            if how == "again":
                runs[:] = [x for x in runs if x[0] != key]
            runs.append((key, run))
    return {p: x for p, x in by.items() if x}


def held(spark, root, version=None):
    by = {}
    for r in stored.load(spark, root, version).orderBy("pos").collect():
        by.setdefault(r.paper, []).append((r.key, r.run))
    return by


@pytest.mark.parametrize("how", stored.HOW)
def test_places_of_runs(spark, tmp_path, how):
    root = str(tmp_path / "t")
    stored.create(spark.createDataFrame(OLD, SCHEMA), root, "paper", ["run"], buckets=3)
    assert stored.update(spark.createDataFrame(NEW, SCHEMA), root, ["key"], ["run"], how) == 2
    assert held(spark, root) == plain(how)
    assert held(spark, root, 1) == {p: [(k, r) for q, k, r in OLD if q == p] for p in {x[0] for x in OLD}}


def test_dead_writers_and_repeats_leave_no_trace(spark, tmp_path):
    root, new = str(tmp_path / "t"), spark.createDataFrame(NEW, SCHEMA)
    stored.create(spark.createDataFrame(OLD, SCHEMA), root, "paper", ["run"], buckets=3)
    before = held(spark, root)
    dead = stored.stage(new, root, ["key"], ["run"], "fresh")  # dies before its version is named
    (tmp_path / "t" / "versions" / "_2-half").write_text('{"buck')  # or while naming it
    assert held(spark, root) == before
    assert [stored.update(new, root, ["key"], ["run"], "again", tag="n") for _ in range(2)] == [2, 2]
    assert held(spark, root) == plain("again")
    with pytest.raises(stored.Conflict):
        stored._commit(spark, root, *dead)
    assert held(spark, root) == plain("again")
    files = lambda: sum(1 for _ in (tmp_path / "t" / "data").iterdir())
    assert files() == 3
    stored.prune(spark, root)
    assert files() < 3 and stored.versions(spark, root) == [2] and held(spark, root) == plain("again")


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = str(tmp_path / "t")
    stored.create(spark.range(200).selectExpr("cast(id as string) paper", "'k' key", "1 run"), root, "paper", ["run"], buckets=16)
    stored.update(spark.createDataFrame([("7", "k", 2)], SCHEMA), root, ["key"], ["run"])
    listed = stored._listed(spark, root, 2)["buckets"]
    names = list(listed.values())
    assert sorted(map(names.count, set(names))) == [1, 15]
    assert spark.read.parquet(f"{root}/{min(set(names), key=names.count)}").count() < 40
    assert sorted(r.run for r in stored.load(spark, root).collect()) == [1] * 199 + [2]


def test_state_is_bounded_by_keys_and_survives_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(12):
        (tmp_path / "in" / f"{n:02}.jsonl").write_text("\n".join(f'{{"k":{k},"t":{n if k % 2 else 100 - n},"v":"{n}","v":"{n}"}}' for k in range(20)))
        os.utime(tmp_path / "in" / f"{n:02}.jsonl", (1_700_000_000 + n, 1_700_000_000 + n))  # the order in which they are read

    def start(check):
        return log.keep_latest(log.events(spark, str(tmp_path / "in"), "k int, t int, v string", files_per_batch=1), str(check), ["k"], ["t"])

    def state(check):
        return sorted(map(tuple, log.current(spark, str(check), ["k", "t", "v"]).collect()))

    check = tmp_path / "check"
    assert start(check).awaitTermination(300)
    want = [(k, 11, "11") if k % 2 else (k, 100, "0") for k in range(20)]
    assert state(check) == want
    assert spark.read.format("statestore").load(str(check)).count() == 20
    cut = tmp_path / "cut"  # as if killed after the sixth batch, with the seventh begun
    shutil.copytree(check, cut)
    for n in range(6, 12):
        for part in (f"commits/{n}", f"commits/.{n}.crc", *([f"offsets/{n}", f"offsets/.{n}.crc"] if n > 6 else [])):
            (cut / part).unlink(missing_ok=True)
    assert sorted(map(tuple, log.current(spark, str(cut), ["k", "t", "v"], batch=5).collect())) == [(k, 5, "5") if k % 2 else (k, 100, "0") for k in range(20)]
    assert start(cut).awaitTermination(300)
    assert state(cut) == want
    assert start(cut).awaitTermination(300)  # nothing new
    assert state(cut) == want
