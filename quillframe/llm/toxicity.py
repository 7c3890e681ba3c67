"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The examples are a bounded sample of labelled rows. Near-copies of one label are one example that
stands for all of them: texts that share the least of their shingles' hashes under one of COPY_KEYS
hash functions. Otherwise the words of one text that was copied a few times would tell labels apart.
The examples' terms are words and word beginnings; the
terms that tell the labels apart (by a chi-square test on the sample, all that pass it) are the
vocabulary, and all other words together are one more term, so that a text without telling words has
neighbours too.
Examples with equal vectors are one entry with a count per label. Entries stand in an inverted index
whose postings are cut into blocks, each with the largest weight of every term in it; a query visits
blocks in order of their upper bounds and stops when no bound exceeds its K-th cosine, so the
neighbours are exact. Votes are weighted by a power of the cosine, relative to the nearest, and by how many
labelled rows an example stands for. Their share is calibrated: either half of the examples is scored by an
index of the other half, and a rising fit of the labels to these shares makes the score the rate of toxic
rows among texts of such a share. The neighbours' doc_ids are returned as evidence.

The model's bound: EXAMPLES rows of each label, each of at most EXAMPLE_BYTES bytes, and with them
their terms. Every text is scored whole.

Defined cases: null or empty text has only the common term and a score like other texts without
telling words; rows without label, with a null doc_id or held out are not learned from; with no
example every score is 0; of several texts of one doc_id the one with the least hash is learned; repeated rows have
the same score; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm.common import arrow_bounds, documents
from quillframe.llm.language_id import fold
from quillframe.llm.simhash import SEED, shingle_set

EXAMPLES = 2000
EXAMPLE_BYTES = 1 << 16
#: Least chi-square value of a term at any number of examples: one in a thousand by chance.
LEAST_CHI2 = 11.0
LEAST_DOCS = 4
BEGINNINGS = range(4, 9)
NEIGHBOURS = 12
BLOCK = 32
POWER = 12
COPY_KEYS = 6
COMMON_WEIGHT = 1.0
#: Words whose terms a task remembers; beyond it the table starts afresh.
REMEMBERED = 400_000
TOKEN = re.compile(r"[^\W\d_]+")


def terms(word: str) -> list[str]:
    """A word, and its beginnings, marked as such."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if n < len(word))]


def examples(docs: DataFrame, labels: DataFrame) -> list[tuple[int, int, float, str]]:
    """(doc_id, label, rows it stands for, text), drawn by a hash of doc_id."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    span, share = 1 << 20, F.lit(0)
    for label, n in counts.items():
        share = F.when(F.col("toxic") == label, F.lit(min(span, 1 + 3 * EXAMPLES * span // n))).otherwise(share)
    drawn = known.withColumn("draw", F.xxhash64("doc_id")).where(F.pmod("draw", F.lit(span)) < share)
    drawn = drawn.withColumn("n", F.row_number().over(Window.partitionBy("toxic").orderBy("draw"))).where(F.col("n") <= EXAMPLES)
    texts = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= EXAMPLE_BYTES)).select("doc_id", "text")
    first = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")  # of a doc_id with several texts the same one in every run
    rows = texts.join(F.broadcast(drawn.select("doc_id", "toxic")), "doc_id").groupBy("doc_id", "toxic").agg(first).collect()  # at most 2 * EXAMPLES rows
    held = Counter(r["toxic"] for r in rows)
    return sorted((r["doc_id"], r["toxic"], counts[r["toxic"]] / held[r["toxic"]], r["text"]) for r in rows)


def without_copies(rows: list[tuple[int, int, float, str]]) -> list[tuple[int, int, float, str]]:
    """rows with near-copies of one label as one row, the first of them, that stands for them all."""
    root, first = list(range(len(rows))), {}

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    odd = np.random.default_rng(SEED).integers(0, 1 << 63, COPY_KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for i, (_, label, _, text) in enumerate(rows):
        shingles = shingle_set(text.encode())
        for k, factor in enumerate(odd):
            a, b = top(i), top(first.setdefault((label, k, int((shingles * factor).min())), i))
            root[max(a, b)] = min(a, b)
    stands: Counter = Counter()
    for i, r in enumerate(rows):
        stands[top(i)] += r[2]
    return [(*rows[i][:2], stands[i], rows[i][3]) for i in sorted(stands)]


class Index:
    """The vocabulary and the block-max inverted index of the examples."""

    def __init__(self, rows: list[tuple[int, int, float, str]], calibrated: bool = True):
        rows = without_copies(rows) if calibrated else rows
        # before the index itself, as the halves' indexes need as much of the driver's memory
        self.knots, self.rates = rising_fit(cross_shares(rows)) if calibrated else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        n = [sum(1 for r in rows if r[1] == y) for y in (0, 1)]
        df: list[Counter] = [Counter(), Counter()]
        for _, label, _, text in rows:
            df[label].update({t for w in set(TOKEN.findall(text.lower())) for t in terms(w)})
        chi = {}
        for t, b in df[1].items():
            a = df[0][t]
            if a + b >= LEAST_DOCS and all(n):
                both, total = a + b, n[0] + n[1]
                chi[t] = total * (b * n[0] - a * n[1]) ** 2 / (both * (total - both) * n[0] * n[1]) if total > both else 0.0
        best = sorted((t for t, x in chi.items() if x >= LEAST_CHI2), key=lambda t: (-chi[t], t))
        self.vocabulary = {t: i + 1 for i, t in enumerate(best)}  # 0 is the common term
        self.idf = np.array([COMMON_WEIGHT, *(math.log(1 + len(rows) / (df[0][t] + df[1][t])) for t in best)])
        self.memory: dict[str, tuple[int, ...]] = {}
        entries: dict[tuple, list] = {}
        for doc_id, label, stands, text in rows:
            e = entries.setdefault(self.key(Counter(TOKEN.findall(text.lower()))), [0.0, 0.0, []])
            e[label] += stands
            e[2].append(doc_id)
        order = sorted(entries, key=lambda k: (max(k, key=lambda x: self.idf[x[0]] * x[1])[0], k))
        self.votes = np.array([entries[k][:2] for k in order]).reshape(-1, 2)
        self.evidence = [entries[k][2][:3] for k in order]
        self.blocks = -(-len(order) // BLOCK)
        self.most = np.zeros((len(self.idf), max(1, self.blocks)))
        posted: dict[tuple[int, int], list] = {}
        for i, k in enumerate(order):
            for t, w in zip(*self.weights(k)):
                posted.setdefault((t, i // BLOCK), []).append((i % BLOCK, w))
                self.most[t, i // BLOCK] = max(self.most[t, i // BLOCK], w)
        self.postings = {k: (np.array([i for i, _ in v]), np.array([w for _, w in v])) for k, v in posted.items()}
        self.known: dict[tuple, tuple[float, list[int]]] = {}

    def key(self, bag: Counter) -> tuple[tuple[int, int], ...]:
        """A text's (term, count) pairs, the common term first."""
        found: Counter = Counter()
        for word, n in bag.items():
            ids = self.memory.get(word)
            if ids is None:
                if len(self.memory) > REMEMBERED:
                    self.memory = {}
                ids = self.memory[word] = tuple(self.vocabulary[t] for t in terms(word) if t in self.vocabulary)
            for t in ids:
                found[t] += n
        return ((0, 1), *sorted(found.items()))

    def weights(self, key: tuple) -> tuple[list[int], np.ndarray]:
        ids = [t for t, _ in key]
        w = self.idf[ids] * (1 + np.log([n for _, n in key]))
        return ids, w / math.sqrt(float(w @ w))

    def neighbours(self, key: tuple) -> list[tuple[float, int]]:
        """The NEIGHBOURS entries of largest cosine, exactly; ties to the first entry."""
        ids, w = self.weights(key)
        bound = w @ self.most[ids]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if len(best) == NEIGHBOURS and bound[b] < best[-1][0] - 1e-12:
                break  # an equal bound may hold an equal entry with a smaller number
            scores = np.zeros(BLOCK)
            for t, x in zip(ids, w):
                if (t, b) in self.postings:
                    at, held = self.postings[t, b]
                    scores[at] += x * held
            size = min(BLOCK, len(self.votes) - b * BLOCK)
            best += [(s, b * BLOCK + i) for i, s in enumerate(scores[:size].tolist())]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:NEIGHBOURS]
        return best

    def score(self, text: str) -> tuple[float, list[int]]:
        key = self.key(Counter(TOKEN.findall(text.lower())))
        found = self.known.get(key)
        if found is None:
            near = self.neighbours(key)
            weight = np.array([(s / near[0][0]) ** POWER for s, _ in near])
            votes = weight @ self.votes[[i for _, i in near]]
            share = float(np.interp((votes[1] + 0.02) / (votes.sum() + 0.2), self.knots, self.rates))
            if len(self.known) > REMEMBERED:
                self.known = {}
            found = self.known[key] = (min(1.0, max(0.0, share)), [d for _, i in near[:3] for d in self.evidence[i][:1]])
        return found


def cross_shares(rows: list[tuple[int, int, float, str]]) -> list[tuple[float, int, float]]:
    """Vote share, label and weight of each example, by the examples of the other half alone; none where a half lacks a label."""
    out = []
    for half in (0, 1):
        own, other = rows[half::2], rows[1 - half :: 2]
        if {r[1] for r in other} == {0, 1}:
            index = Index(other, calibrated=False)
            out += [(index.score(text)[0], label, stands) for _, label, stands, text in own]
            del index
    return out


def rising_fit(seen: list[tuple[float, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Shares and the rates of label 1 that they stand for, both rising: the best rising fit, pooling neighbours that fall."""
    by_share: dict[float, list[float]] = {}
    for share, label, rows in seen:
        held = by_share.setdefault(round(share, 9), [0.0, 0.0])
        held[0] += label * rows
        held[1] += rows
    blocks: list[list[float]] = []  # share times rows, toxic rows, rows
    for share, (toxic, rows) in sorted(by_share.items()):
        blocks.append([share * rows, toxic, rows])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    rates = np.maximum.accumulate([0.0, *((b[1] + 0.1) / (b[2] + 0.2) for b in blocks), 1.0])
    return np.array([0.0, *(b[0] / b[2] for b in blocks), 1.0]), rates


def score(docs: DataFrame, rows: list[tuple[int, int, float, str]]) -> DataFrame:
    """doc_id, score and evidence (doc_ids of the nearest examples); nothing but text is used."""
    index = Index(rows) if {r[1] for r in rows} == {0, 1} else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.score(x.as_py() or "") if index else (0.0, []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    return arrow_bounds(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, score double, evidence array<long>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score(docs, examples(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
