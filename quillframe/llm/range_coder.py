"""An adaptive range coder for token ids, many blocks in lockstep.

Ids of a segment are renumbered by falling frequency, so that numbers of like size are about equally
frequent. Blocks of BLOCK numbers are coded each from a fresh model and into words of their own; one numpy
step advances all blocks by an id. Three models predict the next number:

* order 2 names the number that last followed the two before it in the block, order 1 the one that last
  followed the one before it, each with how often it has just been right;
* order 0 has counts of classes of numbers (four to a power of two), and none within a class. Its counts take
  effect every SETTLE ids.

Their mixing weights are counts of the model that was right, kept for each state of the two upper
predictions (how often right, whether they agree). First the model that names the number is coded by these
weights, order 0 if neither other does; then, under order 0, the class by its counts and the place in the
class. All states are integers, so coder and decoder agree on any machine.

The range has 62 bits; whenever it has fewer than 47 after an id, words of 16 bits are put out. A carry stays
in a word's 17th bit until the block is done. Totals stay under 2 ** 16, which BLOCK and STEP bound, so an id
takes 45 bits of the range at most, or else the range is filled up before the place in the class.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
#: What a count grows by; STEP * BLOCK with the starting counts stays under 2 ** 16.
STEP = 14
SETTLE = 16
#: Ids below it are counted in an array, others by a sort.
COUNTED = 1 << 22
TABLE_BITS = 11
RANGE, TOP = 1 << 62, 1 << 46
DOWN = 1 - 2.0**-50
#: Blocks in lockstep; with fewer, numpy's calls take longer than their work.
LANES = 4096
#: Blocks that are sorted together, within the processor's cache.
ROWS = 32
#: Bits of the largest class for which an id needs no filling up.
SHALLOW = 13
#: Starting weights of a prediction by how often it was right, and of order 0.
TRUST, ORDER0 = (1, 6, 28, 120), 28
#: What the ends of the shares of order 2, 1 and 0 grow by, for each model that is right.
GROWTH = np.array([STEP * (1 | 1 << 20 | 1 << 40), STEP * (1 << 20 | 1 << 40), STEP << 40], dtype=np.int64)
HASH = np.array([0x9E3779B1, 0xC2B2AE35, 32 - TABLE_BITS, 15], dtype=np.uint32)
MAGIC = b"QFT2"


def _classes(count: int) -> tuple[np.ndarray, np.ndarray]:
    """First number and bits of each class of numbers under count."""
    first, bits = [0, 1, 2, 3], [0, 0, 0, 0]
    while first[-1] + (1 << bits[-1]) < count:
        bits.append(max(0, len(first) // 4 - 1))
        first.append(first[-1] + (1 << bits[-2]))
    return np.array(first, dtype=np.int64), np.array(bits, dtype=np.int64)


def _parts(span: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A total'th of each span, rounded down. Doubles divide faster than integers; DOWN outweighs their rounding, so total parts fit in the span."""
    out = span / total
    out *= DOWN
    return out.astype(np.int64)


def _quotients(code: np.ndarray, part: np.ndarray) -> np.ndarray:
    """code // part for quotients of few bits, by doubles that are set right where they round over an integer."""
    out = (code / part).astype(np.int64)
    left = code - out * part
    if left.min() < 0 or (part - left).min() <= 0:
        out += left >= part
        out -= left < 0
    return out


class _Model:
    """The state of all lanes; a lane is a block."""

    def __init__(self, lanes: int, symbols: int, tables: bool = True):
        self.first, self.bits = _classes(symbols)
        self.kinds, self.deep = len(self.first), bool(self.bits[-1] > SHALLOW)
        size = 1 << TABLE_BITS
        self.tables = np.empty((2, lanes * size * tables), dtype=np.int32)  # number << 2 | times right, by order 1 and 2
        self.tables.fill(0)  # not np.zeros, whose memory numpy does not ask large pages for
        self.lane = np.arange(lanes, dtype=np.int64)
        self.base, self.states = self.lane * size, self.lane * 32
        trust = np.array(TRUST, dtype=np.int64)
        second, first, same = np.meshgrid(trust, trust, [0, 1], indexing="ij")
        ends = np.cumsum([second.ravel(), np.where(same, 1, first).ravel(), np.full(32, ORDER0)], axis=0)
        self.weights = np.tile(ends[0] | ends[1] << 20 | ends[2] << 40, lanes)  # where the share of order 2, 1 and 0 ends, 20 bits each
        self.counts = np.ones((self.kinds, lanes), dtype=np.uint16)  # a row a class, so that one step adds or compares a class of all lanes
        self.sums, self.settled = np.zeros((self.kinds + 1, lanes), dtype=np.uint16), np.ones(lanes)
        self.flat_sums, self.seen = self.sums.reshape(-1), []  # seen: places of the classes coded since counts took effect
        self.one, self.two = np.zeros((2, lanes), dtype=np.uint32)  # the number before, and the one before that

    def settle(self) -> None:
        if self.seen:
            grown = np.bincount(np.concatenate(self.seen), minlength=self.counts.size).astype(np.uint16).reshape(self.counts.shape)
            grown *= STEP
            self.counts += grown
            self.seen = []
        for k in range(self.kinds):
            np.add(self.sums[k], self.counts[k], out=self.sums[k + 1])
        self.settled = self.sums[-1].astype(np.float64)

    def look(self, n: int) -> None:
        """Predicts the next number of the first n lanes: what order 1 and 2 name, and where the models' shares end."""
        h1 = self.one[:n] * HASH[0]
        h2 = h1 + self.two[:n] * HASH[1]
        self.at1 = (h1 >> HASH[2]).astype(np.int64)
        self.at2 = ((h2 ^ h2 >> HASH[3]) >> HASH[2]).astype(np.int64)
        self.at1 += self.base[:n]
        self.at2 += self.base[:n]
        held1, held2 = self.tables[0][self.at1], self.tables[1][self.at2]
        self.named1, self.named2 = held1 >> 2, held2 >> 2
        self.right1, self.right2 = held1 & 3, held2 & 3
        self.state = ((self.right2 << 2) + self.right1 << 1).astype(np.int64)
        self.state += self.named1 == self.named2
        self.weigh(self.state)

    def weigh(self, state: np.ndarray) -> None:
        """The shares of the models in these states of the predictions, for the first lanes."""
        state += self.states[: len(state)]
        self.state, self.shared = state, self.weights[state]
        self.total = self.shared >> 40

    def shares(self, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the share of each lane's model: 0 for order 2, 1 for order 1, 2 for order 0."""
        shift = by * 20
        start = (self.shared << 20 >> shift) & 0xFFFFF
        size = (self.shared >> shift) & 0xFFFFF
        size -= start
        return start, size

    def classes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of classes, by their places in the settled sums."""
        start = self.flat_sums[at].astype(np.int64)
        return start, self.flat_sums[at + len(self.lane)] - start

    def credit(self, by: np.ndarray) -> None:
        self.weights[self.state] = self.shared + GROWTH[by]

    def learn(self, x: np.ndarray) -> None:
        """Takes the next numbers x into account."""
        n = len(x)
        entry = (x << 2) + 1
        self.tables[0][self.at1] = entry + np.minimum(self.right1, 2) * (x == self.named1)
        self.tables[1][self.at2] = entry + np.minimum(self.right2, 2) * (x == self.named2)
        self.two[:n] = self.one[:n]
        self.one[:n] = x


def _last_in_slot(slots: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a table names for each number of rows of slots, and how often it was right, as look() finds them one after the other."""
    order = np.argsort(slots, axis=1, kind="stable")
    order += (np.arange(len(slots)) * slots.shape[1])[:, None]
    slots, x = slots.reshape(-1)[order], numbers.reshape(-1)[order]
    named, right = np.zeros_like(x), np.zeros(x.shape, dtype=np.uint8)
    same = slots[:, 1:] == slots[:, :-1]
    np.multiply(x[:, :-1], same, out=named[:, 1:])
    once = np.zeros(x.shape, dtype=bool)
    once[:, 1:] = same
    twice, thrice, hit = np.zeros_like(once), np.zeros_like(once), named == x
    twice[:, 1:] = same & hit[:, :-1] & once[:, :-1]
    thrice[:, 1:] = same & hit[:, :-1] & twice[:, :-1]
    np.add(once.view(np.uint8), twice.view(np.uint8), out=right)
    right += thrice.view(np.uint8)
    back = np.empty_like(named), np.empty_like(right)
    back[0].reshape(-1)[order], back[1].reshape(-1)[order] = named, right
    return back


def _foreseen(numbers: np.ndarray) -> np.ndarray:
    """For each number of rows that are blocks: 32 times the model that codes it, plus the state of the two upper predictions.

    The coder knows all numbers, so sorting by slots, a few rows at a time, replaces tables that a step at a time would fill.
    """
    out = np.empty(numbers.shape, dtype=np.uint8)
    for k in range(0, len(numbers), ROWS):
        x = numbers[k : k + ROWS]
        one, two = np.zeros((2, *x.shape), dtype=np.uint32)
        one[:, 1:], two[:, 2:] = x[:, :-1], x[:, :-2]
        h1 = one * HASH[0]
        h2 = h1 + two * HASH[1]
        named1, right1 = _last_in_slot((h1 >> HASH[2]).astype(np.uint16), x)
        named2, right2 = _last_in_slot(((h2 ^ h2 >> HASH[3]) >> HASH[2]).astype(np.uint16), x)
        state = ((right2 << 2) + right1 << 1) + (named1 == named2)
        out[k : k + ROWS] = np.where(named2 == x, 0, np.where(named1 == x, 32, 64)) + state
    return out


def encode_blocks(numbers: np.ndarray, symbols: int) -> list[bytes]:
    """The words of each block of numbers, all less than symbols."""
    out, step = [], LANES * BLOCK
    for k in range(0, len(numbers), step):
        out += _encode_lanes(numbers[k : k + step], symbols)
    return out


def _encode_lanes(numbers: np.ndarray, symbols: int) -> list[bytes]:
    lanes = -(-len(numbers) // BLOCK)
    longest = min(BLOCK, len(numbers))
    rows = np.zeros((lanes, longest), dtype=np.int32)
    rows.reshape(-1)[: len(numbers)] = numbers
    seen, steps = np.ascontiguousarray(_foreseen(rows).T), np.ascontiguousarray(rows.T)
    model = _Model(lanes, symbols, tables=False)
    low, span = np.zeros(lanes, dtype=np.int64), np.full(lanes, RANGE, dtype=np.int64)
    puts, words = [], []  # lanes and words in the order in which they are put out
    of = model.lane.astype(np.uint16 if lanes < 1 << 16 else np.int64)
    class_of = np.zeros(symbols, dtype=np.int64)
    class_of[model.first[model.first < symbols]] = 1
    class_of = np.cumsum(class_of) - 1

    def fill(n: int) -> None:
        short = np.flatnonzero(span[:n] < TOP)
        while len(short):
            part, left = low[short], span[short] << 16
            puts.append(of[short])
            words.append((part >> 46).astype(np.int32))
            low[short], span[short] = (part & TOP - 1) << 16, left
            short = short[left < TOP]

    for t in range(longest):
        n = lanes if t < len(numbers) - (lanes - 1) * BLOCK else lanes - 1
        if t % SETTLE == 0:
            model.settle()
        x, by = steps[t, :n], (seen[t, :n] >> 5).astype(np.int64)
        rest = by == 2
        model.weigh((seen[t, :n] & 31).astype(np.int64))
        start, share = model.shares(by)
        part = _parts(span[:n], model.total)
        low[:n] += start * part
        part *= share
        span[:n] = part
        # the classes of all lanes, which count where order 0 codes
        kind = class_of[x]
        at = kind * lanes + model.lane[:n]
        start, size = model.classes(at)
        part = _parts(part, model.settled[:n])
        start *= part
        start *= rest
        low[:n] += start
        part *= size
        model.seen.append(at[rest])
        if model.deep:
            np.copyto(span[:n], part, where=rest)
            fill(n)
            part = span[:n].copy()
        part >>= model.bits[kind]
        place = x - model.first[kind]
        place *= part
        place *= rest
        low[:n] += place
        np.copyto(span[:n], part, where=rest)
        fill(n)
        model.credit(by)
    for shift in (46, 30, 14, -2):
        part = low >> shift if shift > 0 else low << -shift
        puts.append(of)
        words.append((part if shift == 46 else part & 0xFFFF).astype(np.int32))
    puts = np.concatenate(puts)
    ends = np.cumsum(np.bincount(puts, minlength=lanes))
    flat = np.concatenate(words)[np.argsort(puts, kind="stable")]
    while len(over := np.flatnonzero(flat > 0xFFFF)):  # carries
        flat[over] &= 0xFFFF
        flat[over - 1] += 1
    raw = flat.astype("<u2").tobytes()
    return [raw[2 * a : 2 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def decode_blocks(payloads: list[bytes], lengths: np.ndarray, symbols: int) -> list[np.ndarray]:
    """The numbers of blocks, of which only the last may be shorter than the others."""
    out = []
    for k in range(0, len(payloads), LANES):
        out += _decode_lanes(payloads[k : k + LANES], lengths[k : k + LANES], symbols)
    return out


def _decode_lanes(payloads: list[bytes], lengths: np.ndarray, symbols: int) -> list[np.ndarray]:
    lanes, longest = len(payloads), int(lengths[0])
    flat = np.concatenate([np.frombuffer(b"".join(payloads), dtype="<u2").astype(np.int64), np.zeros(5, dtype=np.int64)])
    at = np.cumsum([0, *(len(p) // 2 for p in payloads[:-1])])
    code = (flat[at] << 46) | (flat[at + 1] << 30) | (flat[at + 2] << 14) | (flat[at + 3] >> 2)
    following = ((flat[:-1] << 14 & 0xFFFF) | (flat[1:] >> 2)).astype(np.uint16)  # 62 bits end within the fourth word
    at += 3
    span = np.full(lanes, RANGE, dtype=np.int64)
    model, last = _Model(lanes, symbols), len(following) - 1
    out = np.zeros((longest, lanes), dtype=np.int32)
    under = np.empty((model.kinds - 1, lanes), dtype=bool)  # at most 122 classes, as an id has 32 bits

    def fill(n: int) -> None:
        short = np.flatnonzero(span[:n] < TOP)
        while len(short):
            place, left = at[short], span[short] << 16
            code[short] = (code[short] << 16) | following[np.minimum(place, last)]
            at[short], span[short] = place + 1, left
            short = short[left < TOP]

    for t in range(longest):
        n = lanes if t < lengths[-1] else lanes - 1
        if t % SETTLE == 0:
            model.settle()
        model.look(n)
        part = _parts(span[:n], model.total)
        by = (code[:n] >= (model.shared & 0xFFFFF) * part).astype(np.int64)
        by += code[:n] >= (model.shared >> 20 & 0xFFFFF) * part
        start, share = model.shares(by)
        start *= part
        code[:n] -= start
        part *= share
        span[:n] = part
        # the classes of all lanes, which count where order 0 codes
        rest, own = by == 2, code[:n].copy()
        part = _parts(part, model.settled[:n])
        v = _quotients(own, part).astype(np.uint16)  # under the total, as the checksums held
        np.less_equal(model.sums[1:-1, :n], v, out=under[:, :n])
        kind = np.add.reduce(under[:, :n].view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)
        place = kind * lanes + model.lane[:n]
        start, size = model.classes(place)
        model.seen.append(place[rest])
        start *= part
        own -= start
        part *= size
        if model.deep:
            np.copyto(span[:n], part, where=rest)
            np.copyto(code[:n], own, where=rest)
            fill(n)
            part, own = span[:n].copy(), code[:n].copy()
        bits = model.bits[kind]
        part >>= bits
        v = _quotients(own, part)
        own -= v * part
        np.copyto(code[:n], own, where=rest)
        np.copyto(span[:n], part, where=rest)
        v += model.first[kind]
        x = np.where(by == 0, model.named2, model.named1)
        np.copyto(x, v, where=rest, casting="same_kind")
        fill(n)
        model.credit(by)
        model.learn(x)
        out[t, :n] = x
    rows = np.ascontiguousarray(out.T)
    return [rows[i, : lengths[i]] for i in range(lanes)]


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A segment: whole documents' ids, each block with its checksum and reset model.

    Layout, little-endian: MAGIC, u32 checksum of what follows up to the blocks, u64 ids, u64 documents, u32
    different ids, u32 blocks; then for each document u8 (0: null doc_id), i64 doc_id, u64 ids; the different
    ids by falling frequency, u32; for each block u32 bytes and u32 checksum of them; the blocks.
    """
    if len(ids) and ids.max() < COUNTED:
        counts = np.bincount(ids)
        order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        distinct, inverse, rank = np.arange(len(counts)), ids, np.zeros(len(counts), dtype=np.int32)
    else:
        distinct, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order, rank = np.argsort(-counts, kind="stable"), np.zeros(len(distinct), dtype=np.int32)
    rank[order] = np.arange(len(order))
    blocks = encode_blocks(rank[inverse], len(order))
    head = struct.pack("<QQII", len(ids), len(doc_ids), len(order), len(blocks))
    head += np.array([d is not None for d in doc_ids], dtype="u1").tobytes() + np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + np.array(lengths, dtype="<u8").tobytes()
    head += distinct[order].astype("<u4").tobytes()
    head += np.array([[len(b), zlib.crc32(b)] for b in blocks], dtype="<u4").tobytes()
    return MAGIC + struct.pack("<I", zlib.crc32(head)) + head + b"".join(blocks)


class Segment:
    """A segment's directory; blocks are decoded on demand, each alone or together."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC or len(raw) < 32:
            raise ValueError("this is no segment of token ids")
        self.raw = raw
        self.n_ids, docs, symbols, blocks = struct.unpack_from("<QQII", raw, 8)
        at = 32
        end = at + 17 * docs + 4 * symbols + 8 * blocks
        if zlib.crc32(raw[8:end]) != struct.unpack_from("<I", raw, 4)[0]:
            raise ValueError("the segment's directory does not match its checksum")
        self.has_id = np.frombuffer(raw, "u1", docs, at).astype(bool)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at + docs)
        self.lengths = np.frombuffer(raw, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.ids = np.frombuffer(raw, "<u4", symbols, at + 17 * docs)
        table = np.frombuffer(raw, "<u4", 2 * blocks, at + 17 * docs + 4 * symbols).reshape(-1, 2).astype(np.int64)
        self.sums, self.ends = table[:, 1], end + np.cumsum(table[:, 0])
        self.starts = self.ends - table[:, 0]

    def read(self, blocks: list[int] | None = None) -> np.ndarray:
        """The ids of the named blocks, in rising order, or of all."""
        which = list(range(len(self.ends))) if blocks is None else sorted(blocks)
        parts = [self.raw[self.starts[k] : self.ends[k]] for k in which]
        for k, part in zip(which, parts):
            if zlib.crc32(part) != self.sums[k]:
                raise ValueError(f"block {k} does not match its checksum")
        lengths = np.array([min(BLOCK, self.n_ids - k * BLOCK) for k in which], dtype=np.int64)
        numbers = decode_blocks(parts, lengths, len(self.ids))
        return self.ids[np.concatenate(numbers)] if numbers else np.zeros(0, dtype="<u4")
