"""Awkward and empty tables."""

from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    from tests.llm.test_operators import SCHEMA, awkward

    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(awkward(), SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(20, 140)] + [(999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    from tests.llm.test_operators import SCHEMA

    at = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at
