"""Secret scans with one combined deterministic automaton.

All rules are compiled together, by subset construction and minimisation, into one transition array
in which a match may start at any byte. One pass over the bytes, in lockstep lanes, says for each
text which rules can have a match; a lane whose automaton is still under way at its end runs on into
the next bytes until it is back in its start state, so no match is lost at an edge. Only texts with a
hit are then resolved exactly: each rule's own minimal automaton finds its leftmost longest matches
that do not overlap, and matches under the rule's least length are dropped. In these rules the
longest match is also the one that a backtracking engine finds, as no byte can be read in two ways.

Defined cases: null text is empty; a text without a match has no spans and the digest of the empty
string; repeated rows have the same spans; spans count code points; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import lanes
from quillframe.llm.automata import Dfa
from quillframe.llm.common import arrow_bounds, documents


class Rule(NamedTuple):
    """probe: a pattern that every surviving match contains; pattern: the match itself."""

    kind: str
    pattern: str
    probe: str
    fold: bool = False
    least: int = 0
    least_value: int = 0


_KEY = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_VALUE = r"[A-Za-z0-9+/_.=-]"
BASE = (
    Rule("assign", _KEY + _VALUE + "+", _KEY + _VALUE + "{6}", fold=True, least_value=6),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]", least=20),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{24}", least=24),
)
#: Formats of published token kinds, beyond the base rules.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]", least=15),
    Rule("google", "AIza[A-Za-z0-9_-]+", "AIza[A-Za-z0-9_-]", least=39),
    Rule("pem", "-----BEGIN( [A-Z]+)* PRIVATE KEY-----", "-----BEGIN "),
)
RULES = BASE + MORE


class Scanner(NamedTuple):
    """The combined automaton of the probes; each rule's own, and the bytes it can start with."""

    rules: tuple[Rule, ...]
    search: Dfa
    own: list[Dfa]
    starts: list[np.ndarray]


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """Compiled once, on the driver; tasks get the arrays, some hundred kilobytes."""
    own = [Dfa([(r.pattern, r.fold)], search=False) for r in rules]
    return Scanner(rules, Dfa([(r.probe, r.fold) for r in rules], search=True), own, [d.table[d.classes] != d.dead for d in own])


def candidates(dfa: Dfa, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text a bit per rule whose probe occurs in it; one pass over the bytes."""
    codes, rows = lanes.layout(data, offsets, dfa.classes, dfa.pad)
    flags = np.repeat(dfa.accepts.astype(np.uint32), dfa.width)[:: dfa.width]
    state = np.zeros(codes.shape[1], dtype=np.int32)
    hit = np.zeros(codes.shape[1], dtype=bool)
    seen = np.zeros(codes.shape[1], dtype=np.uint32)
    some = flags != 0
    for c in codes:
        state = dfa.table[state + c]
        now = some[state // dfa.width]
        if now.any():
            hit |= now
            seen[now] |= flags[state[now] // dfa.width]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    number = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    at = offsets[rows] + (number + 1) * lanes.LANE  # where each lane would go on
    live = np.flatnonzero((state != 0) & (at < offsets[rows + 1]))
    at, state = at[live], state[live]
    while len(live):
        state = dfa.table[state + dfa.classes[data[at]]]
        now = some[state // dfa.width]
        seen[live[now]] |= flags[state[now] // dfa.width]
        at += 1
        on = (state != 0) & (at < offsets[rows[live] + 1])
        live, at, state = live[on], at[on], state[on]
    out = np.zeros(len(offsets) - 1, dtype=np.uint32)
    np.bitwise_or.at(out, rows, seen)
    return out


def matches(dfa: Dfa, starts: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """Leftmost longest matches of dfa in text that do not overlap, as byte spans."""
    codes, table, accepts, width, dead = dfa.classes[text].tolist(), dfa.table, dfa.accepts, dfa.width, dfa.dead
    table = table.tolist()
    accept = (accepts != 0).tolist()
    out, free, n = [], 0, len(codes)
    for s in np.flatnonzero(starts[text]).tolist():
        if s < free:
            continue
        state, end, i = 0, -1, s
        while i < n:
            state = table[state + codes[i]]
            if state == dead:
                break
            i += 1
            if accept[state // width]:
                end = i
        if end > s:
            out.append((s, end))
            free = end
    return out


def _value_length(text: bytes) -> int:
    """Bytes of the value at the end of an assignment: what follows its separator, spaces and quote."""
    at = min(i for i in (text.find(b":"), text.find(b"=")) if i >= 0) + 1
    rest = text[at:].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


def scan(data: np.ndarray, offsets: np.ndarray, scanner: Scanner) -> list[list[tuple[int, int, int]]]:
    """Per text its spans (start, rule number, end) in code points, in order."""
    rules, search, own, starts = scanner
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    hits = candidates(search, data, offsets)
    for i in np.flatnonzero(hits).tolist():
        text = data[offsets[i] : offsets[i + 1]]
        raw, points = text.tobytes(), np.cumsum((text & 0xC0) != 0x80)
        for k, rule in enumerate(rules):
            if not hits[i] >> k & 1:
                continue
            for a, b in matches(own[k], starts[k], text):
                if b - a >= rule.least and (not rule.least_value or _value_length(raw[a:b]) >= rule.least_value):
                    out[i].append((int(points[a]) - 1, k, int(points[b - 1])))
        out[i].sort()
    return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) in order of start, then of the rules."""
    scanner = compiled(rules)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = lanes.buffers(batch.column(1))
            spans = []
            for a, b in lanes.blocks(offsets):
                spans += [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in scan(data, offsets[a : b + 1], scanner)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span)], ["doc_id", "spans"])

    return arrow_bounds(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long>>")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    joined = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(spans, x -> x.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(F.expr(joined.format(f"filter(spans, x -> x.kind in ({base}))")), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"),
    )


def _sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The query in SQL: places follow from the lengths of matches and of what stands between them."""
    base = [r.kind for r in BASE]
    per = []
    for k, r in enumerate(rules):
        pattern = f"(?i:{r.pattern.replace(_VALUE + '+', '(' + _VALUE + '+)')})" if r.least_value else r.pattern
        pattern = pattern.replace("'", "''")
        value = f"regexp_extract_all(t, '{pattern}', 2)" if r.least_value else "NULL::VARCHAR[]"
        per.append(f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, {r.least_value} AS least_value, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g, {value} AS v FROM d")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r AS ({' UNION ALL '.join(per)}),
u AS (SELECT doc_id, k, kind, least, least_value, unnest(range(1, len(m) + 1)) AS i, m, g, v FROM r WHERE len(m) > 0),
p AS (SELECT doc_id, k, kind, coalesce(list_sum([length(x) for x in g[1:i]]), 0) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS a, length(m[i]) AS n FROM u WHERE length(m[i]) >= least AND (least_value = 0 OR length(v[i]) >= least_value)),
q AS (SELECT doc_id, k, kind, a::BIGINT AS a, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS span FROM p)
SELECT d.doc_id, {', '.join(f"count(*) FILTER (kind = '{b}') AS n_{b}" for b in base)},
       sha256(coalesce(string_agg(span, ',' ORDER BY a, k) FILTER (k < {len(base)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN q ON d.doc_id = q.doc_id GROUP BY d.doc_id"""


OP10_SQL = _sql()
