"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last WINDOW bytes cuts texts into chunks, so equal passages of different
documents are cut alike wherever they stand. A chunk is encoded by itself, once per task, and found
again by its 128-bit digest. Around a cut the chunks' own encodings need not be the text's, so each
join is re-encoded: the text is split anew from a place before the cut where its tokens must have an
edge, and the window grows to the right until the new split has an edge where the next chunk's own
split has one. The split pattern reads forward only, so from a common edge on both splits, and with
them the encodings, agree exactly; a chunk without such an edge becomes part of the window. To the left
the window begins at the last space after a character that is none, where every split has an edge, or
at the last join's end if the chunk has no such space.

The table of encoded chunks has a bound in bytes and starts afresh beyond it, which costs time and
changes no result.

The tokenizer is a byte-level BPE file of the tokenizers library; its vocabulary is turned into ranks.

Defined cases: null text is empty and has no tokens; the strings of special tokens in a text are
those tokens, as in the library's default; a text without cuts is one chunk; repeated rows give
the same ids; decoding replaces malformed UTF-8 by U+FFFD; extra columns are not read by the query.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import repeat
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import lanes
from quillframe.llm.common import arrow_bounds, documents

WINDOW = 32
CHUNK_BITS = 9
TABLE_BYTES = 16 << 20
#: Most pieces whose ids a worker keeps, some 200 bytes each.
PIECES = 400_000
#: The published split pattern of this kind of vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Kinds of characters in the split pattern; UNSURE ones have none in this Unicode version and perhaps another in the tokenizer's.
OTHER, LETTER, NUMBER, SPACE, UNSURE = range(5)
#: Bytes of a join's first window to each side, and characters beyond a match that decide on its end.
REACH, AHEAD = 96, 3


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level vocabularies without a prefix space are supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = _byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        for i, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if vocab[bytes(letters[c] for c in a + b)] != 256 + i:
                raise ValueError("ids do not follow the order of merges")
        self.core = tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks=vocab, special_tokens={})
        self.names: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.names[i] = token
        for token, i in self.special.items():
            self.names[i] = token.encode()
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.marks = [t.encode() for t in self.special]
        self.sizes = np.array([len(t) for t in self.names])
        space = r"\p{White_Space}"
        self.pieces = regex.compile(SPLIT.replace(r"[^\s", f"[^{space}").replace(r"\s", space).replace(r"\S", r"\P{White_Space}"))
        self.table: dict[bytes, np.ndarray] = {}
        self.held = 0
        self._forget()
        self.reused = self.encoded = 0  # bytes of chunks

    def plain(self, part: bytes) -> np.ndarray:
        """The ids of part, without reuse."""
        text = part.decode()
        if any(m in part for m in self.marks):
            ids: list[int] = []
            for piece in self.splitter.split(text):
                ids += [self.special[piece]] if piece in self.special else self.core.encode_ordinary(piece)
        else:
            ids = self.core.encode_ordinary(text)
        return np.array(ids, dtype="<u4")

    def _forget(self) -> None:
        """Empties the table of pieces: the row of each, and the rows' ids, one after the other."""
        self.rows: dict[bytes, int] = {}
        self.flat = np.zeros(0, dtype="<u4")
        self.firsts, self.lengths = np.zeros((2, 0), dtype=np.int64)

    def _rows(self, pieces: pa.Array) -> np.ndarray:
        """The rows of different pieces, of which new ones are encoded."""
        if len(self.rows) > PIECES:
            self._forget()
        edges, raw = np.frombuffer(pieces.buffers()[1], dtype=np.int32)[pieces.offset :][: len(pieces) + 1].tolist(), pieces.buffers()[2]
        raw = raw.to_pybytes() if raw else b""
        names = [raw[a:b] for a, b in zip(edges, edges[1:])]
        rows = np.fromiter(map(self.rows.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        new = np.flatnonzero(rows < 0).tolist()
        if new:
            spaces = [k for k in new if names[k].isspace() or not names[k].isascii() and names[k].decode().isspace()]
            own = set(spaces)
            order = [k for k in new if k not in own] + spaces
            rows[order] = len(self.rows) + np.arange(len(order))
            self.rows |= zip([names[k] for k in order], rows[order].tolist())
            words = [names[k] for k in order[: len(order) - len(spaces)]]
            for ids, lengths in (self._words(words), self._alone([names[k] for k in spaces])):
                self.firsts = np.append(self.firsts, len(self.flat) + np.cumsum(lengths) - lengths)
                self.lengths, self.flat = np.append(self.lengths, lengths), np.append(self.flat, ids)
        return rows

    def _words(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces other than spaces, and how many each has. Encoded in one text, where a space or else a line's end before each keeps it apart."""
        apart = np.array([x[0] != 0x20 for x in pieces], dtype=np.int64)
        text = b"".join([b"\n" + x if a else x for x, a in zip(pieces, apart.tolist())]).decode()
        ids = np.array(self.core.encode_ordinary(text), dtype="<u4")
        ends, wanted = np.cumsum(self.sizes[ids]), np.cumsum(apart + np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        stops = np.searchsorted(ends, wanted) + 1
        starts = np.append(0, stops)[:-1]
        if (ends[stops - 1] != wanted).any():
            return self._alone(pieces)
        return np.delete(ids, starts[apart > 0]), stops - starts - apart

    def _alone(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.core.encode_ordinary(x.decode()) for x in pieces]
        return np.array([i for x in parts for i in x], dtype="<u4"), np.array([len(x) for x in parts], dtype=np.int64)

    def many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has, as plain() gives them; a piece is encoded once for as long as the table holds it."""
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        starts = np.searchsorted(lead, np.append(0, ends))  # characters with which texts begin, and the end
        kind = _kinds()[points]
        at = piece_starts(points, kind, starts)
        edges = np.append(lead[at], len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        row = self._rows(pieces.dictionary)[pieces.indices.to_numpy()]
        each = self.lengths[row]
        done = np.append(0, np.cumsum(each))
        place = np.repeat(self.firsts[row] - done[:-1], each)
        place += np.arange(done[-1])
        ids = self.flat[place]
        cuts = done[np.searchsorted(at, starts)]
        unsure = np.searchsorted(starts, np.flatnonzero(kind == UNSURE), side="right") - 1
        odd = {k for k, t in enumerate(texts) if any(m in t for m in self.marks)} | set(unsure.tolist())
        if odd:
            parts = [self.plain(t) if k in odd else ids[cuts[k] : cuts[k + 1]] for k, t in enumerate(texts)]
            return np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, np.diff(cuts)

    def chunk(self, part: bytes) -> np.ndarray:
        """The ids of a chunk by itself."""
        key = blake2b(part, digest_size=16).digest()
        ids = self.table.get(key)
        if ids is None:
            ids = np.array(self.core.encode_ordinary(part.decode()), dtype="<u4")
            if self.held > TABLE_BYTES:
                self.table, self.held = {}, 0
            self.table[key] = ids
            self.held += 4 * len(ids) + 300
            self.encoded += len(part)
        else:
            self.reused += len(part)
        return ids

    def _edges(self, text: bytes, start: int, stop: int, most: int) -> Iterator[int]:
        """The edges after start of a split of text from there, as far as text up to stop decides them; most is where the split's text ends."""
        at = start
        view = text[start:stop].decode("utf-8", errors="ignore")  # stop may lie in a character
        sure = len(view) if stop >= most else len(view) - AHEAD
        for m in self.pieces.finditer(view):
            if m.end() > sure:
                return
            at += m.end() - m.start() if view.isascii() else len(m[0].encode())
            yield at

    def _join(self, text: bytes, start: int, cut: int, end: int) -> int | None:
        """The first edge from cut on that the split of text from start shares with that of text[cut:end] alone."""
        reach = REACH
        while True:
            stop_own, stop = min(end, cut + reach), min(len(text), cut + reach)
            real, own = self._edges(text, start, stop, len(text)), self._edges(text, cut, stop_own, end)
            a, b = next(real, None), cut
            while a is not None and b is not None and a != b:
                if a < b:
                    a = next(real, None)
                else:
                    b = next(own, None)
            if a is not None and a == b:
                return a
            if stop_own == end and (b is None or stop == len(text)):
                return None
            reach *= 4

    def _before(self, text: bytes, least: int, cut: int) -> int:
        """The last place before cut where any split has an edge, a space after a character that is none; else
        the last edge that a split from least, itself an edge, has whatever comes after cut; else least."""
        at = text.rfind(b" ", least + 1, cut)
        while at > 0:
            low = at - 1
            while low > least and text[low] & 0xC0 == 0x80:
                low -= 1
            if not text[low:at].decode("utf-8", errors="replace").isspace():
                return at
            at = text.rfind(b" ", least + 1, at)
        return max(self._edges(text, least, cut, len(text)), default=least)

    def _window(self, text: bytes, start: int, meet: int | None) -> np.ndarray:
        """The ids from an edge to another, or to the end. A run of spaces before meet would be split in another way if it ended the text."""
        part = text[start:meet].decode()
        if meet is None or not part[-1:].isspace():
            return np.array(self.core.encode_ordinary(part), dtype="<u4")
        edges = [start]
        for e in self._edges(text, start, min(len(text), meet + 4 * AHEAD), len(text)):
            if e <= meet:
                edges.append(e)
        return np.array([i for a, b in zip(edges, edges[1:]) for i in self.core.encode_ordinary(text[a:b].decode())], dtype="<u4")

    def joined(self, text: bytes, cuts: list[int]) -> list[np.ndarray]:
        """The ids of a text without special tokens, from those of its chunks."""
        edges = [0, *cuts, len(text)]
        first, done, out, k = 0, 0, [], 0  # the chunk whose encoding holds from done on begins at first
        ids = self.chunk(text[: edges[1]])
        while True:
            k += 1
            cut = edges[k]
            tail = ids
            if done > first:
                tail = ids[np.searchsorted(np.cumsum(self.sizes[ids]), done - first, side="right") :]
            if cut == len(text):
                return [*out, tail]
            start = self._before(text, done, cut)
            while True:  # to the first chunk whose split agrees somewhere
                meet = self._join(text, start, cut, edges[k + 1])
                if meet is not None or edges[k + 1] == len(text):
                    break
                k += 1
                cut = edges[k]
            out.append(tail[: np.searchsorted(np.cumsum(self.sizes[tail]), start - done, side="right")])
            out.append(self._window(text, start, meet))
            if meet is None or meet == len(text):
                return out
            first, done = cut, meet
            ids = self.chunk(text[cut : edges[k + 1]])

    def encode(self, text: bytes, cuts: list[int]) -> bytes:
        """The ids of a whole text, cut at the ends of characters."""
        if not cuts:
            return self.plain(text).tobytes()
        if any(m in text for m in self.marks):
            out, at = [], 0
            for piece in map(str.encode, self.splitter.split(text.decode())):
                if piece in self.marks:
                    out.append(np.array([self.special[piece.decode()]], dtype="<u4"))
                elif piece:
                    out += self.joined(piece, [c - at for c in cuts if at < c < at + len(piece)])
                at += len(piece)
        else:
            out = self.joined(text, cuts)
        return b"".join(x.tobytes() for x in out)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.names.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        text = "".join(map(chr, range(low, high)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+"), (UNSURE, r"\p{Cn}+")):
            for m in regex.finditer(pattern, text):
                out[low + m.start() : low + m.end()] = kind
        out[low:high][[category(c) == "Cn" for c in text]] = UNSURE  # in the older of two versions
    return out


def piece_starts(points: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The characters with which pieces of SPLIT begin, in texts that begin at starts, of which the last is the end of all.

    Pieces are runs of a kind. The last space character before another kind is a piece of its own, or the beginning
    of the next one if it is U+0020. A contraction counts where its apostrophe begins a piece.
    """
    n = len(points)
    first = np.zeros(n + 1, dtype=bool)
    first[starts] = True
    space = kind == SPACE
    out = first[:n].copy()
    out[1:] |= (kind[1:] != kind[:-1]) & ~(points[:-1] == 0x20)
    out[1:] |= space[1:] & ~space[:-1]
    out[:-1] |= space[:-1] & ~space[1:] & ~first[1:n]
    marks = np.flatnonzero(out & (points == 0x27))
    for word in ("s", "t", "re", "ve", "m", "ll", "d"):
        own = marks[marks + len(word) < n]
        for k, letter in enumerate(word, 1):
            own = own[(points[own + k] == ord(letter)) & ~first[own + k]]
        out[own + 1] = False
        after = own + len(word) + 1
        out[after[after < n]] = True
    return np.flatnonzero(out)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _gear() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Positions where the hash of the WINDOW bytes before them ends a chunk."""
    h, width = _gear()[data], 1
    while width < WINDOW:  # h[i] covers width bytes; double it
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width]
        h = h + shifted * np.uint32(pow(0x01000193, width, 1 << 32))
        width *= 2
    return np.flatnonzero((h >> np.uint32(32 - CHUNK_BITS)) == 0) + 1


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids, the token ids as little-endian unsigned 32-bit integers in one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            data, offsets = lanes.buffers(batch.column(1))
            for a, b in lanes.blocks(offsets):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(_encode_block(own, data, offsets[a : b + 1]), pa.binary())], ["doc_id", "ids"])

    return arrow_bounds(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def whole_characters(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """cuts moved on to the next beginning of a character."""
    for _ in range(3):
        inside = cuts < len(data)
        cuts = cuts + (inside & ((data[np.where(inside, cuts, 0)] & 0xC0) == 0x80))
    return np.unique(cuts)


def _encode_block(own: Codec, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Cuts depend on the WINDOW bytes before them; those of a text's first bytes see the text before, which changes no result."""
    base, block = int(offsets[0]), data[offsets[0] : offsets[-1]]
    raw, at = block.tobytes(), offsets - base
    cuts = whole_characters(block, chunk_ends(block))
    where, out = np.searchsorted(cuts, at, side="right"), []
    for i in range(len(at) - 1):
        lo, hi = int(at[i]), int(at[i + 1])
        inner = cuts[where[i] : where[i + 1]] - lo
        out.append(own.encode(raw[lo:hi], inner[inner < hi - lo].tolist()))
    return out


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text, the decoded ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = batch.column(1)
            for a in range(0, batch.num_rows, 512):
                part = ids.slice(a, 512)
                texts = [own.decode(np.frombuffer(x.as_buffer(), dtype="<u4")) for x in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 512), part, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return arrow_bounds(encoded).select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, of each row."""
    out = decode(encode(docs, path), path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir), default_path())


def stage(docs: DataFrame) -> DataFrame:
    return digest(docs, default_path())
