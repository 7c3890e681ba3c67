"""SimHash near-duplicates by pigeonhole blocks.

A text's 64-bit fingerprint has a bit where more than half of its word shingles' hashes have it.
Two fingerprints that differ in at most DISTANCE bits, cut into b blocks, agree on at least
b - DISTANCE whole blocks; so every fingerprint is keyed by each choice of b - DISTANCE blocks, and
close pairs meet under at least one key. b is the least number that makes keys of KEY_BITS bits or
more; any b finds the same links, and a corpus of 10^9 distinct fingerprints would want more bits. Copies meet as one row, for only distinct
fingerprints are keyed.

Rows of one key stand together in a sorted partition and are verified there by Hamming distance:
short runs by comparing neighbours at each offset, long ones by a search that takes every
fingerprint reached out of the rest, so that a dense group costs about its size and not its pairs.
A partition hands on a spanning forest of its links, one row per linked fingerprint. Forests are
joined by alternating large-star and small-star rounds, each cut by a checkpoint, until they no
longer change.

The pipeline's stage links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more. Its candidates are the pairs whose SimHash fingerprints, of the distinct five-word shingles, the search
above links under some key. Fingerprints of similarity 0.8 differ by some ten bits of 64, so those that
DISTANCE leaves out come from min-wise hashes beside them, BLOCKS blocks of MINIMA minima each: two texts are
candidates too if some block agrees, which at similarity 0.8 fails with probability (1 - 0.8^MINIMA)^BLOCKS,
4e-8. Every candidate pair is then verified on the whole shingle sets. Blocks shared by few texts give pairs; those shared
by many are searched like long runs above, with the shingle sets in the run.

Defined cases: null or empty text, or white space alone, has fingerprint zero, linked like any
other; a text with fewer words than a shingle is one shingle; repeated rows share fingerprint and
component; a component without any doc_id has a null component_id; empty tables give empty results;
extra columns are not read by the query and carried by stage(), which names its own cases.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import lanes
from quillframe.llm.common import arrow_bounds, cut, documents, fan_out, refuse

SHINGLE = 4
DISTANCE = 4
#: The pipeline's stage: five words, and the least similarity, as a fraction.
STAGE_SHINGLE, SIMILAR = 5, (4, 5)
BLOCKS, MINIMA = 24, 3
#: Texts of a block up to which it gives pairs.
FEW = 24
SEED = 42
#: Least bits of a key: the fewest blocks that give as many are used, at every size of the corpus.
KEY_BITS = 20
SHORT_RUN = 48
#: Links that a partition holds before it reduces them to a forest.
HELD_LINKS = 1 << 17
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 17


def _hashes(text: bytes, shingle: int) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]


def majorities(lists: list[np.ndarray]) -> np.ndarray:
    """The 64-bit number of each list of hashes, none empty, that has the bits of more than half of them."""
    sizes = np.array([len(x) for x in lists])
    flat = np.concatenate(lists)
    ones = np.zeros((len(lists), 64), dtype=np.int64)
    owner, first = np.repeat(np.arange(len(lists)), sizes), 0
    while first < len(flat):
        part, who = flat[first : first + CHUNK], owner[first : first + CHUNK]
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        edges = np.flatnonzero(np.diff(who, prepend=-1))
        ones[who[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
        first += CHUNK
    major = (2 * ones > sizes[:, None]).astype(np.uint8)
    return np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    out, todo, held = np.zeros(len(texts), dtype=np.uint64), [], 0

    def settle() -> None:
        out[[i for i, _ in todo]] = majorities([np.array(h, dtype="<u8") for _, h in todo])

    for i, text in enumerate(texts):
        h = _hashes(text, shingle)
        if h:
            todo.append((i, h))
            held += len(h)
        if held >= 4 * CHUNK:
            settle()
            todo, held = [], 0
    if todo:
        settle()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = lanes.buffers(batch.column(1))
            raw, found = memoryview(data), []
            for a, b in lanes.blocks(offsets):
                found.append(fingerprints_of([bytes(raw[offsets[i] : offsets[i + 1]]) for i in range(a, b)], shingle))
            fp = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return arrow_bounds(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(distance: int, key_bits: int = KEY_BITS) -> list[int]:
    """A mask for each choice of blocks that must agree, as signed 64-bit numbers."""
    b = distance + 1
    while 64 * (b - distance) // b < key_bits:
        b += 1
    edges = [round(64 * i / b) for i in range(b + 1)]
    parts = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, b - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node) of the components that the links (a, b) make."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _dense(group: np.ndarray, distance: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a long run's links, as ids: what a search reaches leaves the rest."""
    left, froms, tos = np.arange(len(group)), [], []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(group[left] ^ group[x]) <= distance
            if near.any():
                reached = left[near]
                froms.append(np.full(len(reached), x))
                tos.append(reached)
                todo.extend(reached)
                left = left[~near]
    return (ids[np.concatenate(froms)], ids[np.concatenate(tos)]) if froms else (ids[:0], ids[:0])


def links_in_runs(key: np.ndarray, fp: np.ndarray, distance: int = DISTANCE, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal key (rows sorted by key) whose fingerprints are close, as ids (without: as fingerprints)."""
    ids = fp if ids is None else ids
    edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(edges, len(key)))
    run, a, b = np.repeat(np.arange(len(edges)), sizes), [], []
    long = sizes > SHORT_RUN
    rows = np.flatnonzero(~long[run])
    last = (edges + sizes)[run]
    for step in range(1, SHORT_RUN):
        rows = rows[rows + step < last[rows]]
        if not len(rows):
            break
        near = np.bitwise_count(fp[rows] ^ fp[rows + step]) <= distance
        a.append(ids[rows[near]])
        b.append(ids[rows[near] + step])
    for e, n in zip(edges[long], sizes[long]):
        x, y = _dense(fp[e : e + n], distance, ids[e : e + n])
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def _keyed(distinct: DataFrame, distance: int, *columns: str) -> DataFrame:
    """key and the columns, a row for each choice of blocks of fp, in runs of equal keys."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(block_masks(distance))])
    return distinct.select(F.explode(keys).alias("key"), *columns).repartition(fan_out(distinct), "key").sortWithinPartitions("key")


def close_pairs(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of ids whose fingerprints are close, some of them repeated; prints has id and fp. Of a long
    run the links of its search; all pairs of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for batch in _and_end(batches):
            if batch is not None:
                key, ids = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([ids, batch.column(2).to_numpy()])
                fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(key, key[-1])) if batch is not None and len(key) else len(key)  # the last run may go on
            if whole:
                x, y = links_in_runs(key[:whole], fp[:whole], distance, ids[:whole])
                for at in range(0, len(x), CHUNK):
                    p, q = x[at : at + CHUNK], y[at : at + CHUNK]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])
                key, fp, ids = key[whole:], fp[whole:], ids[whole:]

    return _keyed(prints, distance, "fp", "id").mapInArrow(run, "a long, b long")


def close_forest(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Star edges (a, b) of close fingerprints, of each partition; distinct has column fp."""
    keyed = _keyed(distinct, distance, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        a, b = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        for batch in _and_end(batches):
            if batch is not None:
                key = np.concatenate([key, batch.column(0).to_numpy()])
                fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(key, key[-1])) if batch is not None and len(key) else len(key)  # the last run may go on
            if whole:
                x, y = links_in_runs(key[:whole], fp[:whole], distance)
                a, b = np.concatenate([a, x]), np.concatenate([b, y])
                if len(a) > HELD_LINKS:
                    a, b = forest(a, b)
                key, fp = key[whole:], fp[whole:]
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return keyed.mapInArrow(run, "a long, b long")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def components(edges: DataFrame) -> DataFrame:
    """(a, b): for each linked node its least node, by alternating large-star and small-star."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"), F.bit_xor(F.xxhash64("b", "a")).alias("g")).first()
        if state == before or state["n"] == 0:
            return edges
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").where("a <> b").distinct())


def group(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """prints (doc_id, fp; computed once) with component_id, the smallest doc_id reachable."""
    first = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    least = _least(first, components(close_forest(first.select("fp"), distance)))
    return prints.join(least, "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def _least(first: DataFrame, roots: DataFrame) -> DataFrame:
    """fp and least, the least value of first in its component."""
    placed = first.join(roots, first["fp"] == roots["a"], "left").select("fp", "first", F.coalesce("b", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    return placed.join(least, "root").select("fp", "least")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group(cut(fingerprints(documents(spark, sf_dir))))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; 0 alone for a text without words."""
    return np.unique(np.array(_hashes(text, STAGE_SHINGLE) or [0], dtype="<u8"))


def block_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The min-wise fingerprint of each set, a 64-bit key for each of its blocks."""
    rng = np.random.default_rng(SEED)
    factor, shift = rng.integers(0, 1 << 63, (2, BLOCKS * MINIMA), dtype=np.uint64)
    flat, out = np.concatenate(sets), np.empty((len(sets), BLOCKS), dtype=np.uint64)
    edges = np.cumsum([0, *(len(x) for x in sets[:-1])])
    for b in range(BLOCKS):
        key = np.full(len(sets), b, dtype=np.uint64)
        for i in range(b * MINIMA, (b + 1) * MINIMA):
            key = (key ^ np.minimum.reduceat(flat * (2 * factor[i] + np.uint64(1)) + shift[i], edges)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, b] = key
    return out


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (a hash of the shingle set), text_hash, the set's size n, its SimHash sim, and its min-wise block keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = lanes.buffers(batch.column(1))
            raw, fps, sizes, sets, held = memoryview(data), [], [], [], 0
            keys, sims = [np.zeros((0, BLOCKS), dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]
            for i in range(batch.num_rows):
                x = shingle_set(bytes(raw[offsets[i] : offsets[i + 1]]))
                fps.append(xxhash.xxh64_intdigest(x.tobytes(), SEED))
                sizes.append(len(x))
                sets.append(x)
                held += len(x)
                if held >= CHUNK or i == batch.num_rows - 1:
                    keys.append(block_keys(sets))
                    sims.append(majorities(sets))
                    sets, held = [], 0
            flat = pa.array(np.concatenate(keys).ravel().view(np.int64))
            keyed = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * BLOCKS, flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), batch.column(2), pa.array(sizes, pa.int64()), pa.array(np.concatenate(sims).view(np.int64)), keyed], ["doc_id", "fp", "text_hash", "n", "sim", "keys"])

    return arrow_bounds(docs).select("doc_id", "text", _text_hash().alias("text_hash")).mapInArrow(run, "doc_id long, fp long, text_hash long, n long, sim long, keys array<long>")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two shingle sets have a Jaccard similarity of SIMILAR or more."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each key, as (key, rows without the key), from rows sorted by key."""
    key, rows = None, []
    for batch in batches:
        for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if len(rows) > 1:
                    yield key, rows
                key, rows = k, []
            rows.append(tuple(row))
    if len(rows) > 1:
        yield key, rows


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks with few texts the pairs (a, b) whose sizes allow SIMILAR; of others the members (key, a)."""
    out: set[tuple] = set()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "a", "b"])

    for key, rows in _runs(batches):
        if len(rows) > FEW:
            out.update((key, fp, None) for fp, _ in rows)
        else:
            for (x, n), (y, m) in combinations(rows, 2):
                if SIMILAR[1] * min(n, m) >= SIMILAR[0] * max(n, m):
                    out.add((None, min(x, y), max(x, y)))
        if len(out) >= CHUNK:
            yield flush()
    yield flush()


def _links(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of a partition's links."""
    a, b = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    held: list[tuple[int, int]] = []
    for link in found:
        held.append(link)
        if len(held) >= HELD_LINKS:
            a, b = forest(*(np.concatenate([x, np.array(y, dtype=np.int64)]) for x, y in zip((a, b), zip(*held))))
            held = []
    if held:
        a, b = forest(*(np.concatenate([x, np.array(y, dtype=np.int64)]) for x, y in zip((a, b), zip(*held))))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def similar_in_run(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, int]]:
    """Links that connect the similar texts of a run (fp, set): what a search reaches leaves the rest."""
    sets = [np.frombuffer(x, dtype="<u8") for _, x in rows]
    sizes = np.array([len(x) for x in sets])
    left, todo = np.arange(len(rows)), []
    while len(left):
        if not todo:
            todo, left = [left[0]], left[1:]
            if not len(left):
                break
        x = todo.pop()
        n = len(sets[x])
        near = (SIMILAR[1] * np.minimum(sizes[left], n) >= SIMILAR[0] * np.maximum(sizes[left], n))
        for i in np.flatnonzero(near):
            near[i] = similar(sets[x], sets[left[i]])
        for y in left[near].tolist():
            yield rows[x][0], rows[y][0]
            todo.append(y)
        left = left[~near]


def similar_forest(docs: DataFrame, first: DataFrame) -> DataFrame:
    """Star edges (a, b) of similar texts; first has fp, text_hash, n, sim and keys, docs the texts."""
    parts = fan_out(first)
    keyed = first.select(F.explode("keys").alias("key"), "fp", "n").repartition(parts, "key").sortWithinPartitions("key")
    close = close_pairs(first.select(F.col("sim").alias("fp"), F.col("fp").alias("id"))).distinct()
    found = cut(close.select(F.lit(None).cast("long").alias("key"), "a", "b").unionByName(keyed.mapInArrow(_candidates, "key long, a long, b long")))
    pairs, members = found.where("b is not null").select("a", "b").distinct(), found.where("b is null").select("key", F.col("a").alias("fp"))
    wanted = found.select(F.explode(F.array("a", "b")).alias("fp")).where("fp is not null").distinct()
    wanted = cut(wanted.join(first.select("fp", "text_hash"), "fp").select("text_hash").distinct())

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x.as_py().encode()).tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(x, SEED) for x in found], pa.uint64()).view(pa.int64()), pa.array(found, pa.binary())], ["fp", "shingles"])

    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), _text_hash().alias("text_hash")).join(wanted, "text_hash", "left_semi").select("text")
    sets = cut(texts.mapInArrow(sets_of, "fp long, shingles binary").dropDuplicates(["fp"]))
    x, y = (sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"of_{c}")) for c in ("a", "b"))

    def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c for c in batch.columns)))
        yield from _links((a.as_py(), b.as_py()) for a, b, x, y in rows if similar(np.frombuffer(x.as_py(), dtype="<u8"), np.frombuffer(y.as_py(), dtype="<u8")))

    def of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _links(link for _, rows in _runs(batches) for link in similar_in_run(rows))

    few = pairs.join(x, "a").join(y, "b").select("a", "b", "of_a", "of_b").mapInArrow(of_pairs, "a long, b long")
    many = members.join(sets, "fp").select("key", "fp", "shingles").repartition(parts, "key").sortWithinPartitions("key")
    return few.unionByName(many.mapInArrow(of_runs, "a long, b long"))


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and kept (late, doc_id, text_hash): the first document of each text's component by
    similarity 0.8 or more, by doc_id, nulls last, then by text_hash."""
    prints = cut(wide_fingerprints(docs))
    own = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")
    first = cut(prints.groupBy("fp").agg(F.min(own).alias("first"), F.min("text_hash").alias("text_hash"), *[F.first(c).alias(c) for c in ("n", "sim", "keys")]))
    least = _least(first.select("fp", "first"), components(similar_forest(docs, first)))
    return prints.join(least, "fp").select("doc_id", "text_hash", F.col("least").alias("kept"))


def stage(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the first document by doc_id, nulls last, then by a hash of the text.

    A document is a doc_id and a text: unlike texts of one doc_id are judged apart, and rows equal in both,
    which exact deduplication has removed, stay or go together. Only the documents that go are joined, so a
    table with few near-duplicates moves its texts at most once. It refuses a table with a column __gone or
    __of.
    """
    refuse(docs, "__gone", "__of")
    judged = similar_groups(docs)
    gone = judged.where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash"))))
    gone = cut(gone.select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__of")).distinct())
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone")) & (_text_hash() == F.col("__of")), "left_anti")
