"""JSON in texts, as variants, by the rules of Python's json module.

Spark's own parser takes what it can: it refuses repeated keys, NaN and infinities, and passes over what
stands behind a value. So a text is parsed within an object of our own, whose end must be met, and only
texts that are refused there go to Python, in Arrow batches, where the last of repeated keys holds.

Variants have no NaN or infinities in JSON: they are strings there ("NaN", "Infinity", "-Infinity"), which
cast to such doubles. Values nested deeper than DEPTH levels are no JSON to either parser.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillframe.functions.text import trimmed

#: The key that must follow a value; a text that holds it goes to Python.
END = "quillframe: the value ends here"
#: Deepest nesting that Spark's parser takes, less the object around the value.
DEPTH = 990
TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]"]', re.DOTALL)


def _whole(text: Column) -> Column:
    """The variant of a text that Spark's parser takes to its end."""
    held = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(f',"{END}":0}}')))
    ended = ~F.contains(text, F.lit(END)) & F.try_variant_get(held, f"$['{END}']", "int").isNotNull()
    return F.when(ended, F.try_variant_get(held, "$.v", "variant"))


def json_value(text: Column) -> Column:
    """The variant of a text that is one JSON value; null for other texts."""
    fast = _whole(text)
    return F.coalesce(fast, F.try_parse_json(_reread(F.when(fast.isNull(), text))))


def embedded_json(text: Column) -> Column:
    """A text's JSON value: the whole text; or from its first brace to its last closing one, or to one of
    the four further back, two characters or more apart; or the shortest braces; null if none is JSON."""
    body = trimmed(F.coalesce(text, F.lit("")))
    fast = _whole(body)
    return F.coalesce(fast, F.try_parse_json(_found_in(F.when(fast.isNull(), body))))


def widest_braces(text: Column) -> Column:
    """The JSON value from the first brace to the last; null if there is none."""
    return json_value(F.nullif(F.regexp_extract(text, r"\{[\s\S]*\}", 0), F.lit("")))


def first_object(text: Column) -> Column:
    """The first JSON object in a text, as JSON: the whole text; or from each brace on, the longest part up
    to a closing brace that is an object; null if there is none."""
    return _first_object(text)


def stable_json(text: Column) -> Column:
    """A JSON text with the keys of all its objects in order and no spaces, by which equal values have equal texts; null for what is no JSON."""
    return _stable(text)


def read(text: str) -> object:
    """Python's reading of a JSON text, with numbers that are not finite as strings."""
    return json.loads(text, parse_constant=str, parse_float=_finite)


def _finite(digits: str) -> float | str:
    x = float(digits)
    return x if math.isfinite(x) else "Infinity" if x > 0 else "-Infinity"


def _again(text: str) -> str | None:
    try:
        return json.dumps(read(text))
    except (ValueError, RecursionError):
        return None


def find_json(body: str) -> str | None:
    """What embedded_json() finds in a trimmed text, as JSON with each key once; at most seven parses."""
    if (whole := _again(body)) is not None:
        return whole
    start, end = body.find("{"), body.rfind("}")
    for _ in range(5 if start >= 0 else 0):
        if end <= start:
            break
        if (got := _again(body[start : end + 1])) is not None:
            return got
        end = body.rfind("}", 0, max(0, end - 1))
    end = body.find("}", start) if start >= 0 else -1
    return _again(body[start : end + 1]) if end >= 0 else None


class _Unnumbered(str):
    """A text of which an error need not count the lines, which takes as long as the text is."""

    def count(self, *_: object) -> int:
        return 0

    rfind = count


def find_object(text: str) -> str | None:
    """What first_object() finds.

    A brace outside of strings ends where its braces close, so its one candidate is found by reading on
    from it. Where that fails, braces still open at the place of the error fail there too, and those
    closed before it are objects; neither is read again. Only braces within strings of what was read
    begin a reading of their own.
    """
    raw, decoder, at = text.strip(), json.JSONDecoder(), 0
    held = _Unnumbered(raw)
    failed: set[int] = set()
    objects: dict[int, int] = {}
    while (at := raw.find("{", at)) >= 0:
        if at in objects:
            return raw[at : objects[at]]
        if at not in failed:
            try:
                return raw[at : decoder.raw_decode(held, at)[1]]
            except RecursionError:
                _nested(raw, at, len(raw), failed, objects, whole=False)
            except ValueError as error:
                _nested(raw, at, error.pos, failed, objects, whole=True)
        at += 1
    return None


def _nested(raw: str, start: int, stop: int, failed: set[int], objects: dict[int, int], whole: bool) -> None:
    """Judges the braces of raw[start:stop] in one pass: those still open or nested too deeply fail; closed ones are objects if whole."""
    stack: list[tuple[str, int, int]] = []  # bracket, place, levels within
    failed.add(start)
    for m in TOKENS.finditer(raw, start, stop):
        token = m[0]
        if token == '"':  # a string that does not end
            break
        if token in "{[":
            stack.append((token, m.start(), 1))
        elif token in "}]" and stack:
            bracket, place, levels = stack.pop()
            if stack:
                outer, at, inner = stack[-1]
                stack[-1] = outer, at, max(inner, levels + 1)
            if bracket == "{" and place > start:
                if levels > DEPTH:
                    failed.add(place)
                elif whole:
                    objects[place] = m.end()
    failed.update(place for bracket, place, _ in stack if bracket == "{")


@F.pandas_udf(StringType())
def _stable(x: pd.Series) -> pd.Series:
    def one(text: str) -> str | None:
        try:
            return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode("utf-8", "replace").decode()
        except (ValueError, RecursionError):
            return None

    return x.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def _reread(x: pd.Series) -> pd.Series:
    return x.map(_again, na_action="ignore")


@F.pandas_udf(StringType())
def _found_in(x: pd.Series) -> pd.Series:
    return x.map(find_json, na_action="ignore")


@F.pandas_udf(StringType())
def _first_object(x: pd.Series) -> pd.Series:
    return x.map(find_object, na_action="ignore")
