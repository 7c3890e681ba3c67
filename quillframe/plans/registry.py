"""Registered queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def chosen(k: Column, forms: list[Column]) -> Column:
    """The form whose number from 0 is k; the others are not computed."""
    out = F.when(k == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        out = out.when(k == i, form)
    return out


def r6(x) -> Column:
    return F.round(x, 6)
