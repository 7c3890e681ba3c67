"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text knows every substring of
that sample. A text is parsed against each automaton into longest matches: a phrase goes on as long
as the automaton can follow, then a new phrase starts. The phrases of a language, times the
logarithm of its sample's size, estimate how many bits its sample needs to describe the text; the
language that needs fewest wins. Longest-match parsing with restart is itself deterministic, so
each automaton becomes one transition table with a flag where a phrase ends, and whole batches of
texts run through it in lockstep.

The model's bound: SAMPLE_ROWS rows of each language with SAMPLE_CHARS characters of each row, from a
hashed place in it, so that an opening which texts of several languages share is not what is learned.
Every language that labels a text with a letter is learned, so the model grows with the languages, but
not with the corpus.
Every text is parsed whole. Lanes of lanes.LANE bytes are parsed side by side, each from the
automaton's start; then each lane's opening is parsed again from the state in which the lane before it
ended, until both parses are in the same state, and the difference in phrases is added. So a text's
phrases are those of one parse from its first byte to its last, wherever lanes have their edges.

Defined cases: a text that is null or has no letter is und with score 0; a null doc_id is neither
held out nor learned from; with no labelled row at all every text is und; ties go to the first
language in code point order; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm import lanes
from quillframe.llm.common import arrow_bounds, documents, refuse

SAMPLE_ROWS = 48
SAMPLE_CHARS = 400
FOLDS = 5
FLAG = 30
REJECT_BITS = 7.0
LEAST_JUDGED = 64


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """The sample of each language, drawn by a hash of doc_id from the rows to learn from."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 0))
    span = 1 << 20
    share = F.least(F.lit(span), (1 + 8 * SAMPLE_ROWS * span / F.count(F.lit(1))).cast("long"))
    shares = known.groupBy("lang").agg(share.alias("share"))
    some = known.withColumn("draw", F.xxhash64("doc_id")).join(F.broadcast(shares), "lang").where(F.pmod("draw", F.lit(span)) < F.col("share"))
    start = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    part = F.col("text").substr(start, F.lit(SAMPLE_CHARS))
    lettered = F.when(part.rlike(r"\p{L}"), part).otherwise(F.regexp_extract("text", rf"\p{{L}}(?s:.){{0,{SAMPLE_CHARS - 1}}}", 0))
    some = some.where(F.col("text").rlike(r"\p{L}")).select("lang", "draw", lettered.alias("part"))
    first = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "part"))).where(F.col("n") <= SAMPLE_ROWS)
    parts: dict[str, list[bytes]] = {}
    for r in first.orderBy("lang", "n").collect():
        parts.setdefault(r["lang"], []).append(r["part"].encode())
    return {k: b"\n".join(v) for k, v in sorted(parts.items())}


def _classes() -> np.ndarray:
    """Bytes as symbols: letters in lower case, each byte beyond ASCII, all else one symbol."""
    lut = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        if chr(b).isalpha() and b < 128:
            lut[b] = ord(chr(b).lower()) - ord("a") + 1
        elif b >= 128:
            lut[b] = b - 128 + 27
    return lut


def suffix_automaton(symbols: bytes) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of symbols; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = new
    return step


class CrossParser:
    """The parsing tables of all languages, over the symbols that some sample uses."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = list(samples)
        lut = _classes()
        used = np.unique(np.concatenate([lut[np.frombuffer(s, dtype=np.uint8)] for s in samples.values()]))
        dense = np.full(256, len(used), dtype=np.uint8)  # a symbol that no sample has
        dense[used] = np.arange(len(used))
        self.lut, self.pad, self.width = dense[lut], len(used) + 1, len(used) + 2
        self.tables = [self._table(self.lut[np.frombuffer(s, dtype=np.uint8)].tobytes()) for s in samples.values()]
        self.bits = np.log2([len(s) + 1 for s in samples.values()])

    def _table(self, symbols: bytes) -> np.ndarray:
        step, w = suffix_automaton(symbols), self.width
        start = np.full(w, 1 << FLAG, dtype=np.int32)
        for c, q in step[0].items():
            start[c] = q * w | 1 << FLAG
        table = np.tile(start, (len(step), 1))
        for s, out in enumerate(step):
            for c, q in out.items():
                table[s, c] = q * w
        table[:, self.pad] = np.arange(len(step)) * w
        return table.ravel()

    def phrases(self, table: np.ndarray, codes: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases that begin in each lane; follows says which lanes go on from the lane before them."""
        low = (1 << FLAG) - 1
        end, count = np.zeros(codes.shape[1], dtype=np.int32), np.ones(codes.shape[1], dtype=np.int32)
        for c in codes:
            end = table[end + c]
            count += end >> FLAG
            end &= low
        own_end, more, todo = end.copy(), np.zeros_like(count), np.flatnonzero(follows)
        while len(todo):  # lanes before which an end is new
            real, fresh = end[todo - 1], np.zeros(len(todo), dtype=np.int32)
            extra, live = np.full(len(todo), -1, dtype=np.int32), np.arange(len(todo))
            for c in codes:
                live = live[real[live] != fresh[live]]
                if not len(live):
                    break
                code = c[todo[live]]
                a, b = table[real[live] + code], table[fresh[live] + code]
                extra[live] += (a >> FLAG) - (b >> FLAG)
                real[live], fresh[live] = a & low, b & low
            more[todo] = extra
            new_end = np.where(real == fresh, own_end[todo], real)
            after = todo[end[todo] != new_end] + 1
            end[todo] = new_end
            after = after[after < len(follows)]
            todo = after[follows[after]]
        return count + more

    def costs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits to describe each text by each language's sample, as an array (text, language)."""
        codes, rows = lanes.layout(data, offsets, self.lut, self.pad)
        follows = np.append(False, rows[1:] == rows[:-1]) if len(rows) else np.zeros(0, dtype=bool)
        out = np.zeros((len(offsets) - 1, len(self.names)))
        for k, table in enumerate(self.tables):
            out[:, k] = np.bincount(rows, weights=self.phrases(table, codes, follows), minlength=len(out)) * self.bits[k]
        return out


def predict(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score and bits (by language) for each row; nothing but text is used.

    score is one minus the ratio of the bits of the best and the second language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = CrossParser(samples) if samples else None
        for batch in batches:
            data, offsets = lanes.buffers(batch.column(1))
            lettered = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            n = batch.num_rows
            cost = np.zeros((n, len(samples)))
            if parser:
                for a, b in lanes.blocks(offsets):
                    cost[a:b] = parser.costs(data, offsets[a : b + 1])
            names = np.array([*samples, "und"], dtype=object)
            best, score = np.full(n, len(samples)), np.zeros(n)
            if parser and n:
                best = np.where(lettered, cost.argmin(axis=1), len(samples))
                two = np.sort(cost, axis=1)[:, :2] if len(samples) > 1 else np.column_stack([np.zeros(n), np.ones(n)])
                score = np.where(lettered, np.clip(1 - two[:, 0] / np.maximum(two[:, 1], 1e-9), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(cost.tolist(), pa.list_(pa.float64()))], ["doc_id", "lang_pred", "score", "bits"])

    rows = arrow_bounds(docs).select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits array<double>")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs, learn(docs))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def stage(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is in a learned language, with the columns of docs.

    Rejected are texts without a letter, and texts of LEAST_JUDGED bytes or more that the best
    language needs more than REJECT_BITS bits a byte to describe: some ten standard deviations above
    what texts in learned languages need, reached where nearly every phrase is one or two bytes. It refuses
    a table with a column __lettered.
    """
    refuse(docs, "__lettered")
    samples = learn(docs)
    names = docs.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = CrossParser(samples) if samples else None
        at = names.index("text")
        for batch in batches:
            keep = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(bool)
            data, offsets = lanes.buffers(batch.column(at))
            for a, b in lanes.blocks(offsets):
                size = np.diff(offsets[a : b + 1])
                best = parser.costs(data, offsets[a : b + 1]).min(axis=1) if parser else np.full(b - a, np.inf)
                keep[a:b] &= (best <= REJECT_BITS * size) | ((size < LEAST_JUDGED) & bool(parser))
            yield batch.select(names).filter(pa.array(keep))

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return arrow_bounds(docs).select("*", lettered.alias("__lettered")).mapInArrow(run, docs.schema)
