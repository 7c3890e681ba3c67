"""Removal of repeated passages by maximal repeats of an enhanced suffix array.

Every byte covered by a WINDOW-byte string that also starts in a document with a smaller doc_id goes.
All suffixes of a corpus cannot be sorted in one place, so they are brought together by content:

1. Winnowing picks in each window the GRAM-byte string of least hash (the last one of equals). Equal
   windows pick the same string at the same offset. The windows in a row that pick one occurrence are
   its context, at most 2 * WINDOW - GRAM bytes. A task sends (gram, hash of the context, place) to the
   bucket of the gram, once per distinct context with the smallest doc_id; later copies in the task
   are known to be repeats without leaving it.
2. In a bucket, equal contexts are repeats of the one with the smallest doc_id. What is left is one
   representative per distinct context, and it matters only if its gram has another context in another
   document: passages' edges, mostly.
3. The bytes of those contexts meet by gram. An enhanced suffix array over them (suffixes of the
   contexts, their common-prefix lengths) is scanned with a stack; each interval of common prefixes of
   WINDOW bytes or more whose suffixes have more than one byte to their left is a maximal repeat group
   with all its occurrences. All but those in the smallest doc_id are removed.

The pieces found in 1 to 3 are joined to the documents by doc_id and text hash.

Defined cases: null text is empty; texts under WINDOW bytes are kept whole; rows with the same doc_id
do not remove each other; a null doc_id comes after all others; an empty table gives an empty result;
extra columns are not read. Step 2 compares contexts by 32 bits of their gram's hash, the bucket it
decides and a 64-bit hash of the context; step 3 compares bytes. Two different contexts of one gram are
taken for equal with probability 2^-64, of different grams 2^-96 or less: a gram with a million contexts
holds such a pair with probability 3e-8, the 10^13 contexts of 100 TB one of different grams with 6e-4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import lanes
from quillframe.llm.common import arrow_bounds, documents, fan_out, materialise, release

#: Bytes of text whose grams one bucket holds on average, beyond four buckets a shuffle partition.
BUCKET_TEXT = 4 << 20
WINDOW = 50
GRAM = 24
REACH = WINDOW - GRAM + 1
LAST = (1 << 63) - 1
P = 0x9E3779B97F4A7C15 | 1
#: Window starts hashed at a time.
SEGMENT = 1 << 19


def _power(n: int) -> np.uint64:
    return np.uint64(pow(P, n, 1 << 64))


def _doubled(h: np.ndarray, width: int, more: np.ndarray) -> np.ndarray:
    """Hashes of strings of width bytes followed by strings whose hashes are more, width further on."""
    return h[: len(more) - width] * P64[width] + more[width:]


P64 = {w: _power(w) for w in (1, 2, 4, 8, 16, 32)}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of the GRAM and 32-byte strings from each position."""
    seeds = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(P))
    h = seeds[data]
    by = {1: h}
    for w in (1, 2, 4, 8, 16):
        by[2 * w] = _doubled(by[w], w, by[w])
    gram = by[16][: len(by[16]) - 8] * P64[8]
    gram = gram[: len(by[8]) - 16] + by[8][16 : 16 + len(gram)]
    return gram, by[32]


def contexts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Each picked gram of each text: its hash, its context's hash, text, first window, windows, offset."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in ("g", "c", "d", "lo", "n", "off")}
    base = int(offsets[0])
    rel = offsets - base
    total = int(rel[-1])
    long = np.flatnonzero(np.diff(rel) >= WINDOW)
    for s in range(0, max(0, total - WINDOW + 1), SEGMENT):
        stop = min(total, s + SEGMENT + WINDOW - 1)
        part = data[base + s : base + stop]
        starts = len(part) - WINDOW + 1
        if starts <= 0:
            break
        open_ = np.zeros(starts + 1, dtype=np.int32)
        a, b = np.clip(rel[long] - s, 0, starts), np.clip(rel[long + 1] - WINDOW + 1 - s, 0, starts)
        np.add.at(open_, a, 1)
        np.add.at(open_, b, -1)
        valid = np.flatnonzero(np.cumsum(open_[:-1]) > 0)
        if not len(valid):
            continue
        gram, wide = _hashes(part)
        key = (_mixed(gram) & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - np.arange(len(gram), dtype=np.uint64))
        low = key
        for w in (1, 2, 4, 8):
            low = np.minimum(low[:-w], low[w:])  # the least of 2 * w keys
        least = np.minimum(low[: starts], low[REACH - 16 : REACH - 16 + starts])
        at = (np.uint64(0xFFFFFF) - (least[valid] & np.uint64(0xFFFFFF))).astype(np.int64)
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)))
        n = np.diff(np.append(first, len(at)))
        lo, p = valid[first], at[first]
        end = lo + n - 1 + WINDOW
        shape = (p - lo).astype(np.uint64) * np.uint64(64) + n.astype(np.uint64)
        c = _mixed(wide[lo] + wide[lo + 18] * P64[1] + wide[end - 32] * P64[2] + shape * P64[4])
        d = np.searchsorted(rel, lo + s, side="right") - 1
        for k, v in (("g", _mixed(gram[p])), ("c", c), ("d", d), ("lo", lo + s - rel[d]), ("n", n), ("off", p - lo)):
            parts[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, dtype=np.uint64 if k in "gc" else np.int64) for k, v in parts.items()}


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals sorted by start."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.append(True, start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return start[at], reach[np.append(at[1:] - 1, len(end) - 1)]


FOUND = "kind int, did long, th long, lo long, len int, g long"
SENT = "bucket int, known boolean, packed binary"


def _send(docs: DataFrame, buckets: int) -> DataFrame:
    """Step 1: per batch and bucket the packed places of distinct contexts, and the repeats known already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            data, offsets = lanes.buffers(batch.column(2))
            dids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in lanes.blocks(offsets):
                for x in range(a, b, 60_000):
                    y = min(b, x + 60_000)
                    yield _pack(contexts(data, offsets[x : y + 1]), dids[x:y], ths[x:y], buckets, turn)
                    turn += 1

    return arrow_bounds(docs).select("did", "th", "text").mapInArrow(run, SENT)


def _pack(c: dict[str, np.ndarray], dids: np.ndarray, ths: np.ndarray, buckets: int, turn: int) -> pa.RecordBatch:
    order = np.lexsort((dids[c["d"]], c["c"], c["g"]))
    c = {k: v[order] for k, v in c.items()}
    did = dids[c["d"]]
    new = np.append(True, (c["g"][1:] != c["g"][:-1]) | (c["c"][1:] != c["c"][:-1])) if len(did) else np.zeros(0, dtype=bool)
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    own_least = did == did[head][group] if len(did) else new
    rows: list[tuple[int, bool, bytes]] = []

    # of several places of one context in the smallest doc_id all are sent: each needs its own answer
    sent = np.flatnonzero(own_least)
    where = (c["g"][sent] % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((c["lo"][sent], c["d"][sent], where))
    sent, where = sent[by], where[by]
    edges = np.searchsorted(where, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        pick = sent[edges[k] : edges[k + 1]]
        parts = [(c["g"][pick] >> np.uint64(32)).astype(np.uint32), c["c"][pick]]
        lo = c["lo"][pick]
        parts += [lo.astype(np.uint16), (lo >> 16).astype(np.uint32), c["n"][pick].astype(np.uint8), c["off"][pick].astype(np.uint8)]
        rows.append((k, False, _packed(c["d"][pick], dids, ths, parts)))
    known = np.flatnonzero(~own_least)
    if len(known):  # merged intervals per text
        far = c["d"][known] << np.int64(40)
        o = np.argsort(far + c["lo"][known])
        s, e = merged((far + c["lo"][known])[o], (far + c["lo"][known] + c["n"][known] - 1 + WINDOW)[o])
        parts = [s & np.int64((1 << 40) - 1), e - s]
        rows.append((int(ths[0] + turn) % buckets, True, _packed(s >> np.int64(40), dids, ths, parts)))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.bool_(), pa.binary()))], ["bucket", "known", "packed"])


def _packed(d: np.ndarray, dids: np.ndarray, ths: np.ndarray, parts: list[np.ndarray]) -> bytes:
    """Rows sorted by text, column by column: the texts' keys and numbers of rows, then parts."""
    used, n = np.unique(d, return_counts=True)
    raw = b"".join(x.tobytes() for x in (dids[used], ths[used], n.astype(np.uint32), *parts))
    return np.array([len(used), len(d), len(raw)], dtype=np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, kinds: list[type]) -> list[np.ndarray]:
    """doc_id and text hash of each row, then its parts."""
    texts, rows, size = np.frombuffer(blob, dtype=np.int64, count=3).tolist()
    raw, at, out = pa.decompress(memoryview(blob)[24:], size, codec="zstd", asbytes=True), 0, []
    for kind, count in [(np.int64, texts), (np.int64, texts), (np.uint32, texts), *((k, rows) for k in kinds)]:
        out.append(np.frombuffer(raw, dtype=kind, count=count, offset=at))
        at += out[-1].nbytes
    did, th, n, *parts = out
    return [np.repeat(did, n), np.repeat(th, n), *parts]


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 2. kind 0: a found repeat (lo, len); kind 1: a context whose bytes are needed."""
    held, out = [], []
    for known, blob in zip(pdf["known"], pdf["packed"]):
        if known:
            did, th, lo, size = _unpacked(blob, [np.int64, np.int64])
            out.append(pd.DataFrame({"kind": 0, "did": did, "th": th, "lo": lo, "len": size.astype(np.int32), "g": 0}))
        else:
            held.append(_unpacked(blob, [np.uint32, np.uint64, np.uint16, np.uint32, np.uint8, np.uint8]))
    if held:
        did, th, g, c, lo, lo_high, n, off = map(np.concatenate, zip(*held))
        lo = lo.astype(np.int64) | lo_high.astype(np.int64) << np.int64(16)
        order = np.lexsort((did, c, g))
        did, th, g, c, lo, n = (x[order] for x in (did, th, g, c, lo, n))
        new_g = np.append(True, g[1:] != g[:-1])
        new_c = new_g | np.append(True, c[1:] != c[:-1])
        least = did[np.flatnonzero(new_c)][np.cumsum(new_c) - 1]
        again = did > least
        heads, of_g = np.flatnonzero(new_g), np.cumsum(new_g) - 1
        low = np.minimum.reduceat(did, heads)[of_g]
        high = np.maximum.reduceat(np.where(again, -1, did), heads)[of_g]
        need = ~again & (high > low)  # the gram has representatives in several documents
        bucket = np.int64(pdf["bucket"].iloc[0]) << np.int64(32)
        for kind, pick, size in ((0, again, n.astype(np.int32) - 1 + WINDOW), (1, need, n.astype(np.int32))):
            out.append(pd.DataFrame({"kind": kind, "did": did[pick], "th": th[pick], "lo": lo[pick], "len": size[pick], "g": g[pick].astype(np.int64) | bucket}))
    return pd.concat(out, ignore_index=True)


def suffix_array(parts: list[bytes], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of parts from their first windows[i] positions, sorted: part, start, common-prefix length with the one before."""
    sizes = np.array([len(p) for p in parts])
    flat = np.frombuffer(b"".join(parts) + bytes(80), dtype=np.uint8)
    base = np.cumsum(sizes) - sizes
    part = np.repeat(np.arange(len(parts)), windows)
    start = np.arange(len(part)) - np.repeat(np.cumsum(windows) - windows, windows)
    left = (sizes[part] - start)
    most = int(left.max())
    width = -(-most // 8) * 8
    rows = flat[(base[part] + start)[:, None] + np.arange(width)]
    rows[np.arange(width) >= left[:, None]] = 0
    words = rows.reshape(len(rows), -1, 8).copy().view(">u8").reshape(len(rows), -1)
    order = np.lexsort(tuple(words[:, k] for k in range(words.shape[1] - 1, -1, -1)))
    rows, part, start, left = rows[order], part[order], start[order], left[order]
    same = rows[1:] == rows[:-1]
    lcp = np.where(same.all(axis=1), width, same.argmin(axis=1))
    lcp = np.minimum(lcp, np.minimum(left[1:], left[:-1]))
    return part, start, np.append(0, lcp)


def maximal_repeats(lcp: np.ndarray, before: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, last + 1, length) of the common-prefix intervals of length least or more whose suffixes
    differ in the byte before them; before is -1 - i where nothing is known to the left."""
    out, stack = [], []  # (length, first)
    n = len(lcp)
    for i in range(1, n + 1):
        now, first = (int(lcp[i]) if i < n else 0), i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            left = before[first:i]
            if length >= least and (left != left[0]).any():
                out.append((first, i, length))
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, first))
    return out


def _edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 3 for one bucket of contexts: what maximal repeat groups remove."""
    pdf = pdf.sort_values(["g", "did", "lo"], kind="stable")
    parts, did = pdf["bytes"].tolist(), pdf["did"].to_numpy()
    part, start, lcp = suffix_array(parts, pdf["n"].to_numpy())
    deep = lcp >= WINDOW
    edge = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
    rows, ends, starts = [], [], []
    for a, b in zip(edge[::2] - 1, edge[1::2]):  # suffixes a .. b - 1 share WINDOW bytes
        who = did[part[a:b]]
        if (who == who[0]).all():
            continue
        before = np.array([parts[p][s - 1] if s else -1 - i for i, (p, s) in enumerate(zip(part[a:b], start[a:b]))])
        piece = lcp[a:b].copy()
        piece[0] = 0
        for x, y, length in maximal_repeats(piece, before, WINDOW):
            gone = np.flatnonzero(who[x:y] > who[x:y].min()) + a + x
            rows.append(part[gone]), starts.append(start[gone]), ends.append(start[gone] + length)
    if not rows:
        return pd.DataFrame({k: pd.Series(dtype="int64") for k in ("did", "th", "lo", "len")}).astype({"len": "int32"})
    at, s, e = np.concatenate(rows), np.concatenate(starts), np.concatenate(ends)
    return pd.DataFrame({"did": did[at], "th": pdf["th"].to_numpy()[at], "lo": pdf["lo"].to_numpy()[at] + s, "len": (e - s).astype(np.int32)})


def _cut_contexts(joined: DataFrame) -> DataFrame:
    """The bytes of each needed context, from texts with their lists of needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = lanes.buffers(batch.column(2))
            needs = batch.column(3)
            flat, ends = needs.flatten(), needs.value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), ends)
            lo, n, g = (flat.field(k).to_numpy() for k in range(3))
            raw, at = memoryview(data), offsets[row] + lo
            for x in range(0, len(row), 20_000):
                y = min(len(row), x + 20_000)
                cut = [bytes(raw[i : i + m - 1 + WINDOW]) for i, m in zip(at[x:y].tolist(), n[x:y].tolist())]
                own = pa.array(row[x:y])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(lo[x:y]), pa.array(n[x:y]), pa.array(g[x:y]), pa.array(cut, pa.binary())], ["did", "th", "lo", "n", "g", "bytes"])

    return joined.mapInArrow(run, "did long, th long, lo long, n int, g long, bytes binary")


def find_repeats(docs: DataFrame) -> DataFrame:
    """(did, th, lo, len): byte intervals of docs (did, th, text) that repeat a smaller doc_id's."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * fan_out(docs), size // BUCKET_TEXT)  # so that a bucket's rows stay as many at any size
    found = materialise(_send(docs, buckets).groupBy("bucket").applyInPandas(_bucket, FOUND))
    release(docs.sparkSession)  # the places' shuffle files are the largest of this operator
    needs = found.where("kind = 1").groupBy("did", "th").agg(F.collect_set(F.struct("lo", F.col("len").alias("n"), "g")).alias("needs"))
    # a hashed side has one row a document, so whole texts pass it as a stream and are never sorted
    texts = docs.select("did", "th", "text").join(needs.hint("shuffle_hash"), ["did", "th"]).select("did", "th", "text", "needs")
    met = _cut_contexts(texts).dropDuplicates(["did", "th", "lo", "g"])
    edges = materialise(met.groupBy(F.pmod(F.xxhash64("g"), F.lit(buckets))).applyInPandas(_edges, "did long, th long, lo long, len int"))
    del texts, met
    release(docs.sparkSession)
    return found.where("kind = 0").select("did", "th", "lo", "len").unionByName(edges)


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of removed bytes) and kept (the remaining bytes) of each row."""
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    spans = find_repeats(keyed).groupBy("did", "th").agg(F.collect_list(F.struct("lo", "len")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = lanes.buffers(batch.column(1))
            raw, all_spans, all_kept = memoryview(data), [], []
            for i, found in enumerate(batch.column(2)):
                base, stop = int(offsets[i]), int(offsets[i + 1])
                if not found.is_valid:
                    all_spans.append([])
                    all_kept.append(bytes(raw[base:stop]))
                    continue
                lo = found.values.field(0).to_numpy()
                end = lo + found.values.field(1).to_numpy()
                o = np.argsort(lo)
                s, e = merged(lo[o], end[o])
                all_spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e)])
                all_kept.append(b"".join(bytes(raw[base + x : base + y]) for x, y in zip([0, *e.tolist()], [*s.tolist(), stop - base])))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(all_spans, span), pa.array(all_kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = keyed.join(spans.hint("shuffle_hash"), ["did", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start long, end long>>, kept binary")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


#: All windows of all texts, as hexadecimal strings, from pieces of 400 windows; doc_ids must be unique and not null.
OP3_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, o, substr(h, 2 * o + 1, {2 * (400 + WINDOW - 1)}) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 400)) AS o FROM d)),
w AS (SELECT doc_id, o + k AS k, substr(h, 2 * k + 1, {2 * WINDOW}) AS s FROM (SELECT doc_id, o, h, unnest(range(greatest(0, length(h) // 2 - {WINDOW - 1}))) AS k FROM c)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT w.doc_id, k, k > lag(k) OVER (PARTITION BY w.doc_id ORDER BY k) + {WINDOW} AS apart FROM w JOIN f USING (s) WHERE w.doc_id > first),
n AS (SELECT doc_id, k, sum(coalesce(apart, true)::INT) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM r),
x AS (SELECT doc_id, run, min(k) AS a, max(k) + {WINDOW} AS b FROM n GROUP BY doc_id, run),
y AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS before FROM x),
z AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) AS kept FROM y JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN z USING (doc_id)"""
