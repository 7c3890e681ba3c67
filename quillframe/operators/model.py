"""Calls of an outside model over a column of prompts. The model is an interface; a stub stands for it offline."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quillframe.functions import parse as P
from quillframe.functions import text as T


class RateLimited(Exception):
    pass


class TimedOut(Exception):
    pass


class Fatal(Exception):
    """A call that is not worth another try."""


class Backend(Protocol):
    """A model client; it is sent to the executors, so it must pickle and connect on first use."""

    def complete(self, prompt: str) -> str: ...


@dataclass
class Stub:
    """Answers by a rule, without a network."""

    rule: Callable[[str], str]

    def complete(self, prompt: str) -> str:
        return self.rule(prompt)


@dataclass
class Wait:
    """How long to wait after a failed try. The rule 'kind' waits 2 ** n seconds after a limit on try n and
    1.5 * n after a timeout; 'backoff' starts at first and grows by factor up to most, whatever failed."""

    rule: str = "kind"
    first: float = 1.0
    factor: float = 2.0
    most: float = 10.0

    def after(self, n: int, error: Exception | None) -> float:
        if self.rule == "backoff":
            return min(self.most, self.first * self.factor ** (n - 1))
        return 2.0**n if isinstance(error, RateLimited) else 1.5 * n if isinstance(error, TimedOut) else 0.0


def has_key(answer: str, key: str) -> bool:
    """Whether the JSON object in an answer has a value that is not null at key."""
    start, end = answer.find("{"), answer.rfind("}")
    try:
        return json.loads(answer[start : end + 1]).get(key) is not None
    except (ValueError, AttributeError):
        return False


def retried(call: Callable[[], str], tries: int = 3, wait: Callable[[float], None] = time.sleep, key: str | None = None, pauses: Wait = Wait()) -> tuple[str | None, str | None]:
    """(answer, error). Failures, empty answers and, with key, answers without it are tried again, after a
    pause; a fatal error ends. What the last try gave without the key comes with its error."""
    answer = error = None
    for n in range(1, tries + 1):
        raised = None
        try:
            answer = call()
            if not answer or not answer.strip():
                answer, error = None, "empty"
            elif key and not has_key(answer, key):
                error = f"no {key}"
            else:
                return answer, None
        except RateLimited as e:
            error, raised = "rate limit", e
        except TimedOut as e:
            error, raised = "timeout", e
        except Fatal as e:
            return None, str(e)
        pause = pauses.after(n, raised) if raised or pauses.rule == "backoff" else 0.0
        if n < tries and pause:
            wait(pause)
    return answer, error


def complete(df: DataFrame, prompt: str, backend: Backend, tries: int = 3, key: str | None = None, pauses: Wait = Wait()) -> DataFrame:
    """df with answer and error; a null prompt gets neither. Rows are called where they lie, without a
    shuffle; a lost task calls again, so keep what is done in a table and take it out with an anti-join."""
    at = df.columns.index(prompt)
    schema = StructType(list(df.schema.fields)).add("answer", StringType()).add("error", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(None, None) if p is None else retried(lambda p=p: backend.complete(p), tries, key=key, pauses=pauses) for p in batch.column(at).to_pylist()]
            columns = [*batch.columns, *(pa.array([o[i] for o in out], pa.string()) for i in range(2))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "answer", "error"])

    return df.mapInArrow(run, schema)


def stage(df: DataFrame, prompt: Column, backend: Backend, read: Callable[[Column], Column], out: str, tries: int = 3, key: str | None = None) -> DataFrame:
    """A model's stage: df with out, what read makes of the JSON in the answers to prompt, and error.

    Detection, review, judging and text preparation are such stages: a prompt, a client and a reader.
    """
    asked = complete(df.withColumn("__prompt", prompt), "__prompt", backend, tries, key)
    return asked.withColumn(out, read(P.embedded_json(F.col("answer")))).drop("__prompt", "answer")


def asked_once(df: DataFrame, question: Column, reference: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with cache_key, one row a key to ask for): equal questions with equal references are asked once.

    answered() joins the answers back; this stands for a bounded cache of the calls.
    """
    rows = df.withColumn("cache_key", F.md5(F.concat(question, F.lit("|||"), reference)))
    return rows, rows.groupBy("cache_key").agg(F.min(F.struct(*df.columns)).alias("__r")).select("__r.*", "cache_key")


def answered(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """rows of asked_once() with the columns of answers (cache_key, ...), which has a row a key; rows whose key was not answered stay."""
    return rows.join(answers, "cache_key", "left")


def message_text(content: Column) -> Column:
    """The text of a message's content, a variant: a string, or the text parts of a list, a line each; else its JSON."""
    kind = F.schema_of_variant(content)
    parts = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string"))))
    joined = F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n")
    return F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(kind.startswith("ARRAY"), joined).otherwise(F.to_json(content))
