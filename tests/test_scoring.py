from __future__ import annotations

import numpy as np

from quillframe.operators import scoring as S
from quillframe.plans import catalog

SF = "/root/testdata/sf0.001"


def test_repaired_ids_against_a_plain_version(spark):
    rng, rows, want = np.random.default_rng(6), [], []
    for key in range(60):  # gaps, repeats, ids below 1, none or all given
        ids = [None if rng.random() < 0.5 else int(rng.integers(-1, 9)) for _ in range(rng.integers(1, 9))]
        used, free = {i for i in ids if i is not None and i >= 1}, 0
        for pos, given in enumerate(ids):
            rows.append((key, pos, given))
            if given is None or given < 1:
                free = next(n for n in range(free + 1, 99) if n not in used)
            want.append((key, pos, given if given is not None and given >= 1 else free))
    got = S.repair_ids(spark.createDataFrame(rows, "key long, pos int, given int"), "key", "pos", "given").select("key", "pos", "fixed_id")
    assert sorted(map(tuple, got.collect())) == want


def test_every_line_is_repaired(spark):
    assert catalog.queries()["id_repair"](spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
