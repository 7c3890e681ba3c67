"""Manifests, token files and vector codes against plain versions."""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pytest

from quillframe.llm import bpe, common, merkle, range_coder, token_file, vector_codes
from quillframe.llm.queries import queries
from tests.llm.test_operators import SCHEMA, awkward, expect, keyed


def hashed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return hashed(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(digests):
    """The root, and the siblings (left, right) of each leaf."""
    if len(digests) == 1:
        return digests[0], [[]]
    runs = [digests[i : i + 3] for i in range(0, len(digests), 3)]
    root, above = plain_tree([hashed(*r) for r in runs])
    return root, [[("".join(r[:k]), "".join(r[k + 1 :])), *above[i]] for i, r in enumerate(runs) for k in range(len(r))]


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0], plain_leaf(*r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = plain_tree([x[1] for x in by[s]])
    root, tops = plain_tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (doc_id, leaf, r), path in zip(by[s], trees[s][1]):
            at = leaf
            if doc_id is not None and r[1] is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                at = plain_leaf(doc_id, r[1].replace("\n", ""), *r[2:])
            for left, right in path + top:
                at = hashed(left, at, right)
            out.append((None if doc_id is None else float(doc_id), leaf, trees[s][0], root, hashed(*[a + b for a, b in path + top]), at, at == root))
    return out


COLUMNS = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest(spark, tables):
    got = queries()["op11_merkle"](spark, tables).toPandas()
    want = plain_manifest([r[:5] for r in awkward()])
    assert keyed(got, *COLUMNS) == expect(*want)
    assert {w[6] for w in want} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [81], [82], [1, 3, 243, 244], [3] * 100])
def test_manifest_of_tree_sizes_around_a_superstep(spark, tmp_path, sizes):
    rows = [(1000 * s + i, f"text\n{i}", None, f"s{s:03}", i) for s, n in enumerate(sizes) for i in range(n)]
    at = str(tmp_path)
    spark.createDataFrame([(*r, "own", 7, "odd") for r in rows], SCHEMA).write.parquet(f"{at}/documents.parquet")
    got = queries()["op11_merkle"](spark, at).toPandas()
    assert keyed(got, *COLUMNS) == expect(*[(int(w[0]), *w[1:]) for w in plain_manifest(rows)])


def test_manifest_lists_sources(spark, tables):
    got = merkle.manifest(merkle.leaves_of(common.documents(spark, tables))).collect()
    want = {w[2] for w in plain_manifest([r[:5] for r in awkward()])}
    assert len(got) == len(want) and {r.subroot for r in got} == want and len({r.root for r in got}) == 1


def test_token_files_equal_the_library(spark, tables):
    from tokenizers import Tokenizer

    t, at, want = Tokenizer.from_file(bpe.default_path()), 0, []
    for doc_id, text in sorted([(r[0], r[1] or "") for r in awkward()], key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((None if doc_id is None else float(doc_id), at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert keyed(queries()["op12_token_file"](spark, tables).toPandas(), "start", "n_tokens", "ids_crc32") == expect(*want)


def test_files_with_many_segments(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("some words "), F.col("id").cast("string")), F.col("id").cast("int") % 40).alias("text"))
    folder = str(tmp_path / "tokens")
    monkeypatch.setattr(token_file, "SEGMENT", 500)
    monkeypatch.setattr(token_file, "HANDED", 100)
    token_file.write(docs, folder, bpe.default_path())
    assert spark.read.parquet(folder).count() > 10
    own, at = bpe.Codec(bpe.default_path()), 0
    got = token_file.read(spark, folder).orderBy("doc_id").collect()
    assert len(got) == 300
    for r, d in zip(got, docs.orderBy("doc_id").collect()):
        ids = np.append(own.plain(d.text.encode()), 2).astype("<u4")
        assert (r.doc_id, r.start, bytes(r.ids)) == (d.doc_id, at, ids.tobytes())
        at += len(ids)


def test_pieces_are_encoded_once_and_as_the_library_does(monkeypatch):
    import random

    from tokenizers import Tokenizer

    some = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "\r\n", "a", "B", "\xe9", "\xdf", "\u8a9e", "1", "\xb2", "!", "-", "\xa0", "\u3000", "\u2028", "\x85", "\x1c"]
    some += ["\u0301", "\U0001f600", "\u200d", "<|endoftext|>", "'S", "\u02bc", "\u2019s", "\u0378", "\U0001fae9", "\U00011f00", "\u0438", "\u0639", "\U000323b0", "\ufeff", "\x00"]
    rng = random.Random(4)
    texts = ["", *("".join(rng.choice(some) for _ in range(rng.randrange(25))) for _ in range(4000)), ""]
    t, own = Tokenizer.from_file(bpe.default_path()), bpe.Codec(bpe.default_path())
    monkeypatch.setattr(bpe, "PIECES", 500)  # the table starts afresh now and then
    for k in range(0, len(texts), 100):
        ids, lengths = own.many([x.encode() for x in texts[k : k + 100]])
        want = [t.encode(x, add_special_tokens=False).ids for x in texts[k : k + 100]]
        assert (ids.tolist(), lengths.tolist()) == ([i for w in want for i in w], [len(w) for w in want])
    assert [len(x) for x in own.many([])] == [0, 0]

    class Counting:
        given = 0

        def encode_ordinary(self, text, core=own.core):
            self.given += len(text)
            return core.encode_ordinary(text)

    own._forget()
    own.core = Counting()
    for _ in range(3):
        ids, lengths = own.many([b"unheardof wordings, it's  so\n" * 50] * 2)
        assert ids.tolist() == t.encode("unheardof wordings, it's  so\n" * 50, add_special_tokens=False).ids * 2
    assert 0 < own.core.given < 60


def test_coder_foresees_what_the_decoder_looks_up():
    rng = np.random.default_rng(9)
    numbers = rng.integers(0, 6, (range_coder.ROWS + 3, 300)).astype(np.int32)
    seen, model = range_coder._foreseen(numbers), range_coder._Model(len(numbers), 6)
    for t in range(numbers.shape[1]):
        x = numbers[:, t]
        model.look(len(x))
        by = np.where(model.named2 == x, 0, np.where(model.named1 == x, 1, 2))
        assert (seen[:, t] == 32 * by + model.state - model.states).all()
        model.credit(by)
        model.learn(x)
    assert {0, 1, 2} == set((seen >> 5).reshape(-1).tolist())


@pytest.mark.parametrize("group", [1, 2, 4096])
def test_blocks_in_any_groups_have_the_same_words(monkeypatch, group):
    ids = (np.random.default_rng(3).zipf(1.3, 9000) % 60000).astype("<u4")
    whole = range_coder.pack([1], [9000], ids)
    monkeypatch.setattr(range_coder, "LANES", group)
    assert range_coder.pack([1], [9000], ids) == whole
    assert range_coder.Segment(whole).read().tolist() == ids.tolist()


def test_quotients_and_parts_are_whole():
    rng = np.random.default_rng(7)
    part, times = rng.integers(1 << 30, 1 << 46, 20000), rng.integers(1, 1 << 15, 20000)
    for off in (-1, 0, 1):
        code = part * times + off
        assert (range_coder._quotients(code, part) == code // part).all()
    span, total = rng.integers(1 << 46, (1 << 62) + 1, 20000), rng.integers(1, 1 << 16, 20000)
    parts = range_coder._parts(span, total)
    assert (parts * total <= span).all() and (parts > 0).all() and (span - parts * total <= (span >> 49) + total).all()


def test_range_coder_round_trips():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 3000, 40)
    for n, draw in [(0, None), (1, 1), (range_coder.BLOCK - 1, 9), (range_coder.BLOCK, 60000), (range_coder.BLOCK + 1, 2**31), (70000, 2**31), (13000, 500), (9000, 1), (20000, "words")]:
        ids = np.zeros(0, dtype="<u4") if draw is None else (rng.choice(words, n) if draw == "words" else rng.integers(0, draw, n)).astype("<u4")
        held = range_coder.Segment(range_coder.pack([3, None], [n, 0], ids))
        assert held.read().tolist() == ids.tolist()
        for k in range(len(held.ends)):  # each block by itself
            assert held.read([k]).tolist() == ids[k * range_coder.BLOCK : (k + 1) * range_coder.BLOCK].tolist()
        assert held.doc_ids.tolist() == [3, 0] and held.has_id.tolist() == [True, False] and held.lengths.tolist() == [n, 0]


def test_order_two_predictions_shorten_repeats():
    rng = np.random.default_rng(6)
    phrase = rng.integers(0, 50000, 200).astype("<u4")
    mixed, repeated = rng.integers(0, 50000, 4000).astype("<u4"), np.tile(phrase, 20)
    assert len(range_coder.pack([1], [4000], repeated)) < len(range_coder.pack([1], [4000], mixed)) / 5


def test_damage_is_found():
    ids = np.arange(9000, dtype="<u4") % 700
    raw = bytearray(range_coder.pack([1], [9000], ids))
    body = bytes(raw[:-9]) + bytes([raw[-9] ^ 1]) + bytes(raw[-8:])
    last = 9000 // range_coder.BLOCK
    with pytest.raises(ValueError, match=f"block {last} "):
        range_coder.Segment(body).read()
    assert range_coder.Segment(body).read(list(range(last))).tolist() == ids[: last * range_coder.BLOCK].tolist()
    raw[40] ^= 1
    with pytest.raises(ValueError, match="directory"):
        range_coder.Segment(bytes(raw))


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """vec_id, code, error, label_error and codebooks_sha256 by loops."""
    held = [(i, label, np.floor(np.array(v, dtype=np.float32).astype(np.float64) * 256).astype(int)) for i, v, label in rows if v is not None and None not in v and np.isfinite(v).all()]
    held.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2].tolist()))
    width = len(held[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[2], p) for r in held[:entries]] for p in range(parts)]
    near = lambda v, p: min((int(((cut(v, p) - c) ** 2).sum()), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [[] for _ in books[p]]
            for r in held:
                own[near(r[2], p)[1]].append(cut(r[2], p))
            new.append([np.array([sum(x) // len(g) for x in zip(*g)]) if g else c for g, c in zip(own, books[p])])
        books = new
    coded = [(i, label, [near(v, p) for p in range(parts)]) for i, label, v in held]
    by = {}
    for _, label, c in coded:
        by[label] = by.get(label, 0) + sum(x[0] for x in c)
    sha = hashed(",".join(str(int(x)) for b in books for c in b for x in c))
    return [(i, "".join(f"{e:02x}" for _, e in c), sum(x[0] for x in c), by[label], sha) for i, label, c in coded]


def vectors():
    rng = np.random.default_rng(8)
    some = lambda: rng.integers(-3, 4, 32) / 256 + rng.integers(0, 2) * 0.001  # noqa: E731 - many ties
    rows = [(i, some().tolist(), i % 3 if i % 5 else None) for i in range(150)]
    rows += [(7, some().tolist(), 1), (7, rows[7][1], 1), (None, some().tolist(), 2), (200, None, 1), (201, [None, *rows[0][1][1:]], 1)]
    rows += [(202, [float("nan"), *rows[0][1][1:]], 1), (3, [float("inf"), *rows[0][1][1:]], 1), (-5, [-2.5] * 32, 9), (204, [0.0] * 32, None)]
    return rows


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("few", [False, True])
def test_codes(spark, tmp_path, few):
    rows = vectors()[-12:] if few else vectors()
    spark.createDataFrame(rows, VECTORS).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries()["op13_vector_codes"](spark, str(tmp_path)).toPandas().rename(columns={"vec_id": "doc_id"})
    want = [(None if i is None else float(i), *rest) for i, *rest in plain_codes(rows)]
    assert keyed(got, "code", "error", "label_error", "codebooks_sha256") == expect(*want)


def test_kd_tree_takes_the_lower_index_of_equally_near_entries():
    rng = np.random.default_rng(9)
    for width in (1, 2, 4, 7):
        for n in (1, 2, 5, 64, 200):
            entries = rng.integers(-4, 5, (n, width))
            points = np.concatenate([rng.integers(-6, 7, (400, width)), entries])
            far = ((points[:, None, :] - entries) ** 2).sum(axis=2)
            index, best = vector_codes.KdTree(entries).nearest(points)
            assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_codes_stand_for_their_entries(spark):
    table = vector_codes.whole(spark.createDataFrame(vectors(), VECTORS)).withColumn("__table", vector_codes.F.lit(1))
    books = vector_codes.train(table)
    coded = vector_codes.encode(table, books, ["vec_id", "embedding"])
    for r in vector_codes.decode(coded, books).collect():
        x = np.floor(np.array(r.embedding, dtype=np.float64) * 256)
        assert ((x - np.array(r.approximate) * 256) ** 2).sum() == r.error


@pytest.mark.parametrize("odd", [[0.0] * 31, [0.0] * 16, [3e9] * 32])
def test_vectors_that_do_not_fit_are_refused(spark, odd):
    table = spark.createDataFrame([(1, [0.5] * 32, 1), (2, odd, 1)], VECTORS)
    with pytest.raises(Exception, match="components|component is beyond"):
        vector_codes.encode(table, vector_codes.train(table), ["vec_id"]).collect()
