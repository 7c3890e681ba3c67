"""A Merkle manifest of a table, by messages between the vertices of its trees.

Every row is a leaf, the SHA-256 of its fields. The leaves of a source, by doc_id, are a tree whose inner
vertices are the hash of FAN consecutive children; the sources' subroots, by source, are the leaves of one
tree more, whose root stands for the whole table. Digests are hashed as lower-case hexadecimal text.

The trees are climbed in supersteps over RDDs. In a superstep, vertices message their parents, a parent
that has all its children hashes them, and forwards its own digest. The vertices under one ancestor HEIGHT
levels up share a key, so that the messages of HEIGHT levels need one exchange and a tree of 10^10 leaves
six; a key has FAN ** HEIGHT vertices at most, whatever the sizes of sources. On the way back, reverse
supersteps send each such block the path of its ancestor, siblings level by level up to the root, and the
block's vertices add their own: below the leaves' blocks the path is as long as the tree is high, but one
message serves a block. The exchanges of the way up are read again on the way down, not computed again.

Leaves are numbered where they lie after a sort by source and doc_id. A source may run over partitions, but
only a partition's first and last one can, so the driver gathers two counts a partition and no source list.

Defined cases: null fields are hashed as "-", null doc_ids and the null source come first; rows with equal
doc_ids are ordered by their digests, and equal rows by their place; a lone leaf is its tree's root, with an
empty path; empty texts are values of no bytes; an empty table has no root and no rows; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import cut, documents, fan_out

FAN = 3
#: Levels that a superstep climbs.
HEIGHT = 4
WIDTH = FAN**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left: string, right: string>>"


def leaf(**changed: Column) -> Column:
    """The digest of a row's fields; changed replaces some of them."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(proof, start, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The hash of all siblings on a path, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _joined(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def _climb(block: int, nodes: list[tuple]) -> tuple[list[list[str]], bool]:
    """The digests of a block's vertices and of their ancestors, level by level, up to the one that all share; whether it is a root."""
    levels, whole = [[n[2] for n in nodes]], block == 0 and nodes[-1][1]
    for _ in range(HEIGHT):
        if whole and len(levels[-1]) == 1:
            break
        below = levels[-1]
        levels.append([_joined(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return levels, whole


def _paths(levels: list[list[str]], above: list[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    """The path of each vertex of a block, given that of the block's ancestor."""
    for i in range(len(levels[0])):
        path = []
        for level in levels[:-1]:
            run = i // FAN * FAN
            path.append(("".join(level[run:i]), "".join(level[i + 1 : run + FAN])))
            i //= FAN
        yield path + above


def _numbered(rows: RDD) -> tuple[RDD, int]:
    """Rows (tree, digest, ...) that are sorted by tree, as (tree, (index, whether it is the tree's last, digest, ...)); the largest tree's size."""

    def count(no: int, it: Iterator[tuple]) -> Iterator[tuple]:
        runs, first, last, most = 0, None, None, 0
        for tree, own in groupby(it, key=itemgetter(0)):
            last = (tree, sum(1 for _ in own))
            first, runs, most = first or last, runs + 1, max(most, last[1])
        if runs:
            yield no, runs, first, last, most

    ends = sorted(rows.mapPartitionsWithIndex(count).collect())  # a row for each partition
    before, goes_on, most, at = {}, {}, 0, (None, 0, None)  # the tree that the partitions so far end with, its rows, the last partition
    for no, runs, first, last, largest in ends:
        same = at[2] is not None and at[0] == first[0]
        before[no] = at[1] if same else 0
        if same:
            goes_on[at[2]] = True
        at = (last[0], last[1] + (before[no] if runs == 1 else 0), no)
        most = max(most, largest, before[no] + first[1])

    def number(no: int, it: Iterator[tuple]) -> Iterator[tuple]:
        held, index = None, before.get(no, 0)
        for tree, *rest in it:
            if held:
                yield held[0], (index, held[0] != tree, *held[1])
                index = index + 1 if held[0] == tree else 0
            held = (tree, rest)
        if held:
            yield held[0], (index, not goes_on.get(no, False), *held[1])

    return rows.mapPartitionsWithIndex(number), most


def _up(leaves: RDD, most: int, parts: int) -> tuple[list[RDD], RDD]:
    """Climbs all trees: the blocks ((tree, block), vertices) of each superstep, and the roots (tree, (superstep, digest))."""
    todo = leaves.map(lambda v: ((v[0], v[1][0] // WIDTH), v[1]))
    steps, roots = [], []
    while most or not steps:
        blocks = todo.groupByKey(max(1, min(parts, most))).mapValues(lambda vertices: sorted(vertices, key=itemgetter(0)))

        def complete(it: Iterator[tuple], step: int = len(steps)) -> Iterator[tuple]:
            for (tree, block), nodes in it:
                levels, whole = _climb(block, nodes)
                if whole:
                    yield tree, (step, levels[-1][0])

        def forward(it: Iterator[tuple]) -> Iterator[tuple]:
            for (tree, block), nodes in it:
                levels, whole = _climb(block, nodes)
                if not whole:
                    yield (tree, block // WIDTH), (block, nodes[-1][1], levels[-1][0])

        steps.append(blocks)
        roots.append(blocks.mapPartitions(complete))
        todo = blocks.mapPartitions(forward)
        most = -(-most // WIDTH) if most > WIDTH else 0
    return steps, roots[0].context.union(roots)


def _down(steps: list[RDD], tops: RDD) -> RDD:
    """(tree, vertex, path, told) of every leaf. tops: (tree, (superstep, path, told)) of each root; told is handed down as it is."""
    sent = None
    for no in reversed(range(len(steps))):
        begin = tops.filter(lambda t, no=no: t[1][0] == no).map(lambda t: ((t[0], 0), t[1][1:]))
        paths = begin if sent is None else begin.union(sent)
        parts = steps[no].getNumPartitions()
        met = steps[no].join(paths.partitionBy(parts), parts)

        def spread(it: Iterator[tuple]) -> Iterator[tuple]:
            for (tree, block), (nodes, (above, told)) in it:
                levels, _ = _climb(block, nodes)
                for node, path in zip(nodes, _paths(levels, above)):
                    yield tree, node, path, told

        out = met.mapPartitions(spread)
        sent = out.map(lambda x: ((x[0], x[1][0]), (x[2], x[3])))
    return out


def _arranged(leaves: DataFrame) -> DataFrame:
    order = ["source", "doc_id", "leaf", "__row"]
    rows = leaves.withColumn("__row", F.monotonically_increasing_id())
    return rows.repartitionByRange(fan_out(leaves), *order).sortWithinPartitions(*order)


def _trees(leaves: DataFrame) -> tuple[list[RDD], RDD]:
    """The blocks of the sources' trees, and (source, (superstep, path, (subroot, root))) of each source."""
    parts = fan_out(leaves)
    own, most = _numbered(_arranged(leaves).select("source", "leaf", "doc_id", "tampered").rdd.map(tuple))
    steps, roots = _up(own, most, parts)
    ordered = roots.sortBy(lambda r: (r[0] is not None, (r[0] or "").encode()), numPartitions=parts)
    upper, count = _numbered(ordered.map(lambda r: (0, r[1][1], r[0], r[1][0])))
    top_steps, top = _up(upper, count, parts)
    begin = top.map(lambda t: (t[0], (t[1][0], [], t[1][1])))
    tops = _down(top_steps, begin).map(lambda x: (x[1][3], (x[1][4], x[2], (x[1][2], x[3]))))
    return steps, tops


def leaves_of(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """source, doc_id, leaf, and tampered: another digest to verify in place of the leaf, if any; computed once, without texts."""
    other = F.lit(None).cast("string") if tampered is None else tampered
    return cut(docs.select("source", "doc_id", leaf().alias("leaf"), other.alias("tampered")))


def manifest(leaves: DataFrame) -> DataFrame:
    """source, subroot and root of leaves_of()."""
    _, tops = _trees(leaves)
    return leaves.sparkSession.createDataFrame(tops.map(lambda t: (t[0], *t[1][2])), "source string, subroot string, root string", verifySchema=False)


def proofs(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered, subroot, root, and proof: the siblings to the left and right of the path from each leaf to the root."""
    steps, tops = _trees(leaves)
    rows = _down(steps, tops).map(lambda x: (x[1][3], x[1][2], x[1][4], *x[3], x[2]))
    return leaves.sparkSession.createDataFrame(rows, f"doc_id long, leaf string, tampered string, subroot string, root string, proof {PROOF}", verifySchema=False)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's proof, folded from the row as it is or, for even checksums of doc_id, without its line ends."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    stripped = F.when(even, leaf(text=F.replace("text", F.lit("\n"), F.lit(""))))
    out = proofs(leaves_of(documents(spark, sf_dir), stripped))
    out = out.withColumns({"folded_root": fold(F.coalesce("tampered", "leaf"), F.col("proof")), "proof_sha256": proof_digest(F.col("proof"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP11_SQL = r"""
WITH RECURSIVE
base AS (
  SELECT doc_id, source, text,
    concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
      CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS crc
  FROM documents
),
leaves AS (
  SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END) || ':' || CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END END) AS start
  FROM base
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves
),
nodes(tree, level, idx, n, digest) AS (
  SELECT tree, 0, idx, n, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3, n
),
subroots AS (SELECT tree, level AS height, digest AS subroot, count(*) OVER () AS trees FROM nodes WHERE n = 1),
upper(level, idx, n, digest) AS (
  SELECT 0, tree, trees, subroot FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY level, idx // 3, n
),
steps AS (
  SELECT tree, level, idx, n, coalesce(string_agg(digest, '' ORDER BY idx) OVER (PARTITION BY tree, level, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(digest, '' ORDER BY idx) OVER (PARTITION BY tree, level, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM (SELECT tree, level, idx, n, digest FROM nodes UNION ALL SELECT -1, level, idx, n, digest FROM upper)
),
walk(doc_id, leaf, src, tree, level, idx, folded, siblings) AS (
  SELECT doc_id, leaf, tree, tree, 0, idx, start, '' FROM placed
  UNION ALL
  SELECT w.doc_id, w.leaf, w.src, CASE WHEN s.n = 1 THEN -1 ELSE w.tree END, CASE WHEN s.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN s.n = 1 THEN w.tree ELSE w.idx // 3 END,
    CASE WHEN s.n = 1 THEN w.folded ELSE sha256(s.a || w.folded || s.b) END, CASE WHEN s.n = 1 THEN w.siblings ELSE w.siblings || s.a || s.b END
  FROM walk w JOIN steps s ON s.tree = w.tree AND s.level = w.level AND s.idx = w.idx WHERE NOT (w.tree = -1 AND s.n = 1)
),
top AS (SELECT level, digest AS root FROM upper WHERE n = 1)
SELECT w.doc_id, w.leaf, r.subroot, t.root, sha256(w.siblings) AS proof_sha256, w.folded AS folded_root, w.folded = t.root AS verified
FROM walk w JOIN subroots r ON r.tree = w.src JOIN top t ON w.tree = -1 AND w.level = t.level
"""
