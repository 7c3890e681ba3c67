"""Sources outside Spark, behind interfaces: paged notes, attachments, searches, page counts.

A client is sent to the executors, so it must pickle and connect on first use. Offline, tests and
queries use clients that answer by a rule. A lost task asks again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructType

#: Notes of a page, and the fields of a note that may hold its file, in the order in which they are tried: fixed values.
PAGE_NOTES = 1000
FILE_FIELDS = ["pdf", "paper", "submission", "file", "attachment"]


class Notes(Protocol):
    def notes(self, request: str, offset: int, limit: int) -> list[str]: ...


class Files(Protocol):
    def attachment(self, note: str, field: str) -> bytes: ...

    def public(self, note: str) -> bytes | None: ...


class Search(Protocol):
    def search(self, words: str, most: int) -> list[str]: ...


class Pages(Protocol):
    def count(self, data: bytes) -> int: ...


class Parser(Protocol):
    """Reads a file: its text, and its blocks as a list of objects with a type."""

    def text(self, data: bytes) -> str: ...

    def blocks(self, data: bytes) -> list[dict]: ...


def pages_of(client: Notes, request: str, limit: int = PAGE_NOTES) -> Iterator[list[str]]:
    """Page after page, until one is empty."""
    offset = 0
    while page := client.notes(request, offset, limit):
        yield page
        offset += len(page)


def fetch_notes(requests: DataFrame, request: str, client: Notes, limit: int = PAGE_NOTES) -> DataFrame:
    """requests with nth and note, a row a note, as the client returns them; each request is read by one task."""
    at = requests.columns.index(request)
    schema = StructType(list(requests.schema.fields)).add("nth", IntegerType()).add("note", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(batch.column(at).to_pylist()):
                nth = 0
                for page in pages_of(client, name, limit):
                    own = batch.take(pa.array([i] * len(page)))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(range(nth, nth + len(page)), pa.int32()), pa.array(page, pa.string())], [*batch.schema.names, "nth", "note"])
                    nth += len(page)

    return requests.mapInArrow(run, schema)


def first_file(client: Files, note: str, fields: list[str]) -> bytes | None:
    """The first attachment that is there and not empty, else the public file; errors pass to the next."""
    tries = [*(lambda f=f: client.attachment(note, f) for f in fields), lambda: client.public(note)]
    for get in tries:
        try:
            if data := get():
                return data
        except Exception:  # noqa: BLE001  any failure of one way means the next
            continue
    return None


def _with_column(df: DataFrame, column: str, out: str, kind: Any, arrow: pa.DataType, f: Any) -> DataFrame:
    at, schema = df.columns.index(column), StructType(list(df.schema.fields)).add(out, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([None if x is None else f(x) for x in batch.column(at).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def download(notes: DataFrame, note: str, client: Files, fields: list[str] = FILE_FIELDS) -> DataFrame:
    """notes with data, the file of each; null where no way gave one."""
    return _with_column(notes, note, "data", BinaryType(), pa.binary(), lambda n: first_file(client, n, fields))


def search(queries: DataFrame, words: str, sources: list[Search], most: int) -> DataFrame:
    """queries with found: at most `most` results of the first source that has any."""

    def first(w: str) -> list[str]:
        return next((got[:most] for s in sources if (got := s.search(w, most))), [])

    from pyspark.sql.types import ArrayType

    return _with_column(queries, words, "found", ArrayType(StringType()), pa.list_(pa.string()), first)


def count_pages(files: DataFrame, data: str, client: Pages) -> DataFrame:
    """files with pages, -1 where the client fails."""

    def count(x: bytes) -> int:
        try:
            return client.count(x)
        except Exception:  # noqa: BLE001  an unreadable file is a value here
            return -1

    return _with_column(files, data, "pages", IntegerType(), pa.int32(), count)


def read_text(files: DataFrame, data: str, client: Parser) -> DataFrame:
    """files with text, trimmed; empty where the client fails."""

    def text(x: bytes) -> str:
        try:
            return client.text(x).strip()
        except Exception:  # noqa: BLE001  an unreadable file is a value here
            return ""

    return _with_column(files, data, "text", StringType(), pa.string(), text)


def read_blocks(files: DataFrame, data: str, client: Parser) -> DataFrame:
    """files with v, a variant {"content": blocks} whose blocks are numbered from 1; null where the client fails."""

    def blocks(x: bytes) -> str | None:
        try:
            return json.dumps({"content": [b | {"index": i} for i, b in enumerate(client.blocks(x), 1)]})
        except Exception:  # noqa: BLE001  an unreadable file is a value here
            return None

    return _with_column(files, data, "__json", StringType(), pa.string(), blocks).withColumn("v", F.try_parse_json("__json")).drop("__json")


def read_settings(spark: SparkSession, path: str) -> dict:
    """The settings of a file of nested "key: value" lines, indented by spaces, with # comments: words in quotes
    are text, others numbers, true, false or null where they are such, and a key without a value above no
    deeper line is null."""
    lines = [line for row in spark.read.text(path, wholetext=True).collect() for line in row[0].splitlines()]  # a settings file
    root: dict = {}
    open_ = [(-1, root, "")]  # indent, dictionary, the key in the one above that holds it
    for line in lines:
        m = re.match(r"( *)([^\s#:][^:#]*):(?:\s+(\"[^\"]*\"|'[^']*'|[^#]*?))?\s*(?:#.*)?$", line)
        if not m:
            if line.strip() and not line.lstrip().startswith("#"):
                raise ValueError(f"no setting: {line.strip()}")
            continue
        while open_[-1][0] >= len(m[1]):
            open_.pop()
        holder, key = open_[-1][1], m[2].strip()
        if m[3]:
            holder[key] = _scalar(m[3])
        else:
            holder[key] = {}
            open_.append((len(m[1]), holder[key], key))
    return _without_empty(root)


def _scalar(word: str) -> Any:
    if word[0] in "\"'":
        return word[1:-1]
    if word in ("true", "false", "null", "~"):
        return {"true": True, "false": False}.get(word)
    for read in (int, float):
        try:
            return read(word)
        except ValueError:
            pass
    return word


def _without_empty(config: dict) -> dict:
    return {k: (_without_empty(v) or None) if isinstance(v, dict) else v for k, v in config.items()}


def setting(config: dict, key: str, default: Any = None) -> Any:
    """The value at a dotted key of nested dictionaries, default where a step is missing."""
    for part in key.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def decoded(data: Column) -> Column:
    """The bytes of a base64 text; null where it is none."""
    return F.try_to_binary(data, F.lit("base64"))
