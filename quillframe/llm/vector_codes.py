"""Compression of vectors to short codes: the nearest entry of a codebook for each part of a vector.

Components become integers, floor(256 * x), and vectors are cut into equal parts. A codebook a part is
trained by rounds: each round broadcasts a kd-tree over the entries of each codebook (its size is that of
the codebooks, whatever the table's), tasks look up the nearest entries of their rows and add up integer
sums by entry, and one aggregate a round adds the tasks' sums. All distances and sums are integers, so
results do not depend on partitions or order.

A search first descends to the leaf a point belongs to, then visits every node whose box is no farther than
the best entry so far. Boxes at just that distance are visited too, as they may hold an entry of equal
distance and lower index.

Defined cases: vectors that are null or hold nulls, NaN or infinities are left out; labels may be null, and
null labels count as equal; null vec_ids come after all others and equal vec_ids are ordered by their
vectors when the first entries are chosen; repeated rows each get a code; fewer vectors than entries give
smaller codebooks; an empty table gives an empty result; vectors of different lengths, of a length that is
no multiple of the parts, or with components beyond 2 ** 18, whose distances need not fit a long, are an
error; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import arrow_bounds, cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest component, times SCALE.
MOST = 1 << 26
#: Entries of a tree's leaf.
LEAF = 4
#: Points searched at a time.
POINTS = 1 << 15


class KdTree:
    """The entries of a codebook in nested boxes."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.nodes: list[tuple] = []  # box, entry indexes of a leaf, or axis, border and children
        self._build(np.arange(len(entries)))

    def _build(self, own: np.ndarray) -> int:
        at, points = len(self.nodes), self.entries[own]
        low, high = points.min(axis=0), points.max(axis=0)
        self.nodes.append(())
        axis = int(np.argmax(high - low)) if len(low) else 0
        if len(own) <= LEAF or low[axis] == high[axis]:
            self.nodes[at] = (low, high, own, None)
            return at
        border = np.sort(points[:, axis])[len(own) // 2]
        if border == low[axis]:  # over half of the entries are equal there
            border = np.min(points[:, axis][points[:, axis] > border])
        left = points[:, axis] < border
        self.nodes[at] = (low, high, None, (axis, border, self._build(own[left]), self._build(own[~left])))
        return at

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each point's nearest entry, the lower index of equally near ones."""
        index, best = np.full(len(points), len(self.entries)), np.full(len(points), np.iinfo(np.int64).max)

        def look(own: np.ndarray, who: np.ndarray) -> None:
            far = ((points[who][:, None, :] - self.entries[own]) ** 2).sum(axis=2)
            first = far.argmin(axis=1)
            far, found = far[np.arange(len(who)), first], own[first]
            better = (far < best[who]) | ((far == best[who]) & (found < index[who]))
            best[who[better]], index[who[better]] = far[better], found[better]

        def home(node: int, who: np.ndarray) -> None:
            _, _, own, split = self.nodes[node]
            if not len(who):
                return
            if split is None:
                look(own, who)
                return
            axis, border, left, right = split
            low = points[who, axis] < border
            home(left, who[low])
            home(right, who[~low])

        def visit(node: int, who: np.ndarray) -> None:
            low, high, own, split = self.nodes[node]
            gap = np.maximum(np.maximum(low - points[who], points[who] - high), 0)
            who = who[(gap**2).sum(axis=1) <= best[who]]
            if not len(who):
                return
            if split is None:
                look(own, who)
                return
            visit(split[2], who)
            visit(split[3], who)

        everything = np.arange(len(points))
        home(0, everything)
        visit(0, everything)
        return index, best


def whole(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector has finite components only."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return table.where(F.col(vector).isNotNull() & finite)


def _integers(column: pa.Array, length: int) -> np.ndarray:
    """Vectors of an Arrow column as rows of integer components."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1])
    if (sizes != length).any():
        raise ValueError(f"a vector has {sizes[sizes != length][0]} components, not {length}")
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError(f"a component is beyond {MOST // SCALE}")
    return x.astype(np.int64).reshape(len(column), length)


def _assigned(x: np.ndarray, trees: list[KdTree]) -> tuple[np.ndarray, np.ndarray]:
    """Entry and distance of each part of each vector."""
    cells = x.reshape(len(x), len(trees), -1)
    index, far = np.zeros((2, len(x), len(trees)), dtype=np.int64)
    for a in range(0, len(x), POINTS):
        for p, tree in enumerate(trees):
            index[a : a + POINTS, p], far[a : a + POINTS, p] = tree.nearest(cells[a : a + POINTS, p])
    return index, far


def _trees(spark: SparkSession, books: np.ndarray):
    return spark.sparkContext.broadcast([KdTree(b) for b in books])


def first_books(vectors: DataFrame, parts: int, entries: int, key: str, vector: str) -> np.ndarray:
    """Codebooks (part, entry, position) that start as the parts of the vectors with the smallest keys."""
    rows = vectors.orderBy(F.asc_nulls_last(key), vector).limit(entries).select(vector).collect()  # entries rows, a parameter
    if not rows:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    length = len(rows[0][0])
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    x = _integers(pa.array([r[0] for r in rows], pa.list_(pa.float64())), length)
    return np.ascontiguousarray(x.reshape(len(rows), parts, -1).transpose(1, 0, 2))


def _sums(vectors: DataFrame, books: np.ndarray, vector: str) -> DataFrame:
    """cell (a position of an entry, counted through all codebooks), n and total of the vectors' parts that are nearest."""
    parts, entries, width = books.shape
    trees = _trees(vectors.sparkSession, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for batch in batches:
            x = _integers(batch.column(0), parts * width)
            index, _ = _assigned(x, trees.value)
            cells = x.reshape(len(x), parts, width)
            for p in range(parts):
                n[p] += np.bincount(index[:, p], minlength=entries)
                np.add.at(total[p], index[:, p], cells[:, p])
        used = np.flatnonzero(np.repeat(n.ravel(), width))
        if len(used):
            columns = used, np.repeat(n.ravel(), width)[used], total.ravel()[used]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cell", "n", "total"])

    found = arrow_bounds(vectors).select(vector).mapInArrow(run, "cell long, n long, total long")
    return found.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """The codebooks (part, entry, position) after so many rounds over all vectors."""
    books = first_books(vectors, parts, entries, key, vector)
    for _ in range(rounds if books.size else 0):
        flat = books.ravel().copy()
        for row in _sums(vectors, books, vector).collect():  # as many rows as the codebooks have components
            flat[row.cell] = row.total // row.n
        books = flat.reshape(books.shape)
    return books


def encode(vectors: DataFrame, books: np.ndarray, keep: list[str], vector: str = "embedding") -> DataFrame:
    """The columns of keep with code, an entry's index a part in two hexadecimal digits, and error, the sum of squared distances."""
    parts, entries, width = books.shape
    if entries > 256:
        raise ValueError("two digits hold 256 entries")
    if clash := {"code", "error"} & set(keep):
        raise ValueError(f"the input has columns {sorted(clash)}")
    if not books.size:
        return vectors.select(*keep, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where(F.lit(False))
    trees = _trees(vectors.sparkSession, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, far = _assigned(_integers(batch.column(len(keep)), parts * width), trees.value)
            codes = index.astype(np.uint8).tobytes().hex()
            codes = [codes[i : i + 2 * parts] for i in range(0, len(codes), 2 * parts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(codes, pa.string()), pa.array(far.sum(axis=1))], [*keep, "code", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*keep).schema)
    return arrow_bounds(vectors).select(*keep, vector).mapInArrow(run, f"{schema}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, out: str = "approximate") -> DataFrame:
    """codes with the vector that each code stands for, in the scale of the original components."""
    parts, _, width = books.shape
    table = F.array(*[F.array(*[F.lit(v / SCALE) for v in entry]) for book in books.tolist() for entry in book])
    entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + p * books.shape[1]
    return codes.withColumn("__table", table).withColumn(out, F.flatten(F.array(*[F.element_at("__table", entry(p) + 1) for p in range(parts)]))).drop("__table")


def digest(books: np.ndarray) -> str:
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    books = train(vectors)
    rows = cut(encode(vectors, books, ["vec_id", "label"]))
    by = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(by, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round_sql(no: int) -> str:
    return f"""
a{no} AS (
  SELECT s.row, s.p, s.q, min(struct_pack(far := list_sum(list_transform(list_zip(s.q, c.c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), e := c.e)) AS m
  FROM cells s JOIN c{no} c ON c.p = s.p GROUP BY s.row, s.p, s.q
),
n{no} AS (
  SELECT p, e, list((total - ((total % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT p, m.e AS e, i, sum(q[i])::BIGINT AS total, count(*) AS n FROM a{no}, (SELECT unnest(range(1, (SELECT max(len(q)) FROM cells) + 1)) AS i) GROUP BY p, m.e, i) GROUP BY p, e
),
c{no + 1} AS (SELECT c.p, c.e, coalesce(n.c, c.c) AS c FROM c{no} c LEFT JOIN n{no} n ON n.p = c.p AND n.e = c.e)"""


OP13_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
cells AS (SELECT row, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS q FROM kept, (SELECT unnest(range(16)) AS p)),
c0 AS (SELECT p, row - 1 AS e, q AS c FROM cells WHERE row <= 64),{_round_sql(0)},{_round_sql(1)},{_round_sql(2)},
sums AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2),
coded AS (SELECT k.vec_id, k.label, k.row, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.far)::BIGINT AS error FROM a2 JOIN kept k ON k.row = a2.row GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, sums
"""
