"""Every registered query on awkward rows, against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

from quillframe.llm import bpe, common, exact_dedup, language_id, mixing, quality, repeats, secrets, sharding, simhash, toxicity
from quillframe.llm.automata import Dfa
from quillframe.llm.queries import oracle_sql, queries

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, shard int, size string"


def awkward() -> list[tuple]:
    shared = "the quick brown fox jumps over the lazy dog and then sleeps all day in the sun"
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "b"), (None, "no id here at all", "en", "a"),
        (4, f"start one {shared} end one", "en", "a"), (5, f"another start {shared} other end", "en", "a"), (6, f"x {shared}", None, None),
        (7, "Same  text\n", "en", "b"), (8, "Same text ", "en", "b"), (8, "Same text ", "en", "b"), (9, "same text ", "en", "b"),
        (10, 'password: "abcdef12" token=token: secretvalue AKIA' + "Q" * 16 + " " + "0a" * 14, "en", "c"),
        (11, "é" * 60 + " <|endoftext|> don't we'll  two   spaces\n\n\n", "fr", "c"), (12, "one two three", "en", "c"),
        (13, "a b c d e " * 3000, "en", "big"), (14, "line\nline\n \nline two words here again and more of them", "en", "c"),
        (15, "٣٤٥ ⅷ ½ 12345", "xx", "d"), (16, "\u0000 zero byte " * 5, "en", "d"),
    ]
    words = {"en": "the and of to in that was with for his".split(), "de": "der die und ein ist nicht mit sich auf das".split()}
    rng = np.random.default_rng(3)
    for i in range(20, 140):
        lang = "en" if i % 2 else "de"
        text = " ".join(rng.choice(words[lang], 30)) + (" vile" * 2 if i % 7 == 0 else "")
        rows.append((i, text, lang, f"s{i % 4}"))
    return [(*r, 0, "own", 7, "odd") for r in rows]


def keyed(frame, *columns):
    """Rows as a sorted list, for tables with repeated rows."""
    return sorted((tuple(None if x != x else x for x in r) for r in frame[["doc_id", *columns]].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, name):
    from tests.oracle import compare

    assert not compare(spark, queries()[name], oracle_sql()[name], "/root/testdata/sf0.001")


def texts():
    return [(float(r[0]) if r[0] is not None else None, r[1] or "") for r in awkward()]


def expect(*rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, empty, name):
    assert queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(set(queries()) - {"op13_vector_codes"}))
def test_every_row_once(spark, tables, name):
    got = queries()[name](spark, tables).toPandas()
    assert keyed(got) == expect(*[(i,) for i, _ in texts()])


def test_bpe_equals_the_library(spark, tables):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    want = []
    for i, x in texts():
        ids = t.encode(x, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert keyed(queries()["op1_bpe"](spark, tables).toPandas(), "n_tokens", "ids_sha256", "decoded_sha256") == expect(*want)


ODD = list("ab c'strvel \n\t\r19é.,😀٣ж中ｗ\u3000\u00a0\u0301\x1c\x85 ")


def test_joins_agree_wherever_chunks_are_cut():
    own, rng = bpe.Codec(bpe.default_path()), np.random.default_rng(1)
    for k in range(1500):
        n = int(rng.integers(2, 400))
        alphabet = [ODD, list("abc"), list("中文"), list(" \n"), list("don't we'll 're  ")][k % 5]
        text = "".join(rng.choice(alphabet, n)).encode()
        data = np.frombuffer(text, dtype=np.uint8)
        cuts = bpe.whole_characters(data, np.sort(rng.integers(1, len(text), int(rng.integers(1, 12)))))
        assert own.encode(text, [c for c in cuts.tolist() if c < len(text)]) == own.plain(text).tobytes(), text
    assert own.reused > 0


def test_long_texts_in_all_scripts_equal_the_library(spark):
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(bpe.default_path()), np.random.default_rng(4)
    own = bpe.Codec(bpe.default_path())
    texts = ["".join(rng.choice(ODD, 9000)), "中文字" * 4000, "word " * 5000, "x" * 9000, " " * 3000 + "y", "da" * 300 + "<|endoftext|>" + "b c" * 900, "привет мир, " * 900]
    blob = [x.encode() for x in texts]
    data, offsets = np.frombuffer(b"".join(blob), dtype=np.uint8), np.cumsum([0, *map(len, blob)])
    for text, ids in zip(texts, bpe._encode_block(own, data, offsets)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_mix(spark, tables):
    x = mixing.taken(mixing.sizes(common.documents(spark, tables))).toPandas()
    assert (x.taken <= 3 * x["size"]).all()
    by = x.groupby(x.source_size)[["taken", "size"]].sum()
    assert abs(x.taken.sum() - x["size"].sum()) <= 10 and len(by)
    again = mixing.taken(mixing.sizes(common.documents(spark, tables))).toPandas()
    assert keyed(x, "size", "taken") == keyed(again, "size", "taken")
    parts = mixing.mix(mixing.sizes(common.documents(spark, tables)), 64).toPandas()
    assert parts["take"].sum() == x.taken.sum()


def plain_targets(size):
    """Sizes by source to targets, by resharing the excess until there is none."""
    order = sorted(size, key=lambda s: (s is None, s))
    weight, target, open_ = {s: 1 + i % 3 for i, s in enumerate(order)}, {}, set(order)
    left = float(sum(size.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * size[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mix_targets_blocks_and_draws(spark):
    rng = np.random.default_rng(12)
    rows = [(i, "w " * int(rng.integers(0, 90)), None if i % 11 == 0 else f"s{int(rng.integers(0, 8)) ** 2 // 9}") for i in range(900)]
    rows += [(2000, "w " * 7, "tiny"), (2001, "w " * 20000, "s1"), (2002, None, "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = mixing.sizes(docs)
    size: dict = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = plain_targets(size)
    x = mixing.taken(sizes).toPandas()
    names = {r[0]: r[2] for r in rows}
    x["source"] = [names[i] for i in x.doc_id]
    assert len(x) == len(rows) and np.allclose(x.target, [want[s] for s in x.source]) and list(x.source_size) == [size[s] for s in x.source]
    assert (x.taken <= 3 * x["size"]).all()
    for s, total in x.groupby("source", dropna=False).taken.sum().items():
        assert abs(total - want[None if s != s else s]) <= 1
    block = 8
    slots = mixing.slots(common.cut(mixing.targets(sizes)), block).toPandas()
    shards = slots.groupby("shard").size()
    assert shards.max() <= mixing.SHARD_SLOTS and len(shards) == -(-len(slots) // mixing.SHARD_SLOTS)
    sid = {s: k + 1 for k, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    for s, n in size.items():
        of = slots[slots.sid == sid[s]].sort_values("slot")
        assert list(of.slot) == list(range(len(of))) and abs(of.words.sum() - want[s]) <= 1
        for _, p in of.groupby("pass"):  # a pass has each block once
            assert p.block_index.is_unique and p.block_index.max() <= (n - 1) // block
    counts = slots[slots["shard"] < shards.index.max()].pivot_table(index="shard", columns="sid", values="slot", aggfunc="count", fill_value=0)
    share = np.array([want[s] for s in sorted(size, key=lambda s: (s is None, s)) if sid[s] in counts.columns]) / sum(want.values())
    spread = (counts.var() / (mixing.SHARD_SLOTS * share * (1 - share)))[share > 0.02]
    assert spread.between(0.4, 2).all()  # the variance of a multinomial draw


def test_repeats_against_all_windows(spark, tables):
    docs = sorted(((i if i is not None else np.inf), (x or "").encode()) for i, x in texts())
    want = []
    for i, b in docs:
        seen = {o[k : k + 50] for j, o in docs if j < i for k in range(len(o) - 49)}
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append((None if i == np.inf else i, len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert keyed(queries()["op3_repeats"](spark, tables).toPandas(), "n_bytes", "n_removed", "n_spans", "kept_sha256") == expect(*want)


def test_maximal_repeats_have_all_occurrences():
    parts = [b"xxabcabcab", b"yyabcabzz"]
    part, start, lcp = repeats.suffix_array(parts, np.array([10, 9]))
    before = np.array([parts[p][s - 1] if s else -1 - i for i, (p, s) in enumerate(zip(part, start))])
    found = {(parts[part[a]][start[a] : start[a] + n], b - a) for a, b, n in repeats.maximal_repeats(lcp, before, 2)}
    assert (b"abcab", 3) in found and (b"ab", 5) in found and not any(x[0] == b"bcab" for x in found)


def test_perfect_hash_finds_members_only():
    words = np.random.default_rng(0).integers(0, 1 << 63, (5000, 4)).astype("<u8")
    mph = exact_dedup.PerfectHash.load(*exact_dedup.PerfectHash.build(words).dump())
    assert sorted(mph.slots(words)) == list(range(5000))


def test_exact_dedup(spark, tables):
    x = queries()["op4_exact_dedup"](spark, tables).toPandas()
    same = x[x.doc_id.isin([7, 8])]
    assert set(same.keep_id) == {7.0} and set(same.group_size) == {3} and same.kept.sum() == 1
    assert x.groupby("text_sha256").kept.sum().eq(1).all()
    assert exact_dedup.stage(common.documents(spark, tables)).count() == x.kept.sum()


def test_toxicity_learns_the_word(spark, tables):
    x = queries()["op5_toxicity"](spark, tables).toPandas()
    held = x[x.held_out & x.doc_id.between(20, 139)]
    assert len(held) and ((held.doc_id % 7 == 0) == (held.predicted == 1)).mean() > 0.9 and x.score.between(0, 1).all()


def test_toxicity_learns_many_rare_words():
    rng = np.random.default_rng(8)
    foul, plain = (["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)) for _ in range(n)] for n in (500, 60))

    def text(toxic):
        return " ".join([*rng.choice(plain, 20), *(rng.choice(foul, 8, replace=False) if toxic else [])])

    index = toxicity.Index([(i, i % 2, 1.0, text(i % 2)) for i in range(2 * toxicity.EXAMPLES)])  # each foul word in 1.6 % of the toxic ones
    assert np.mean([w in index.vocabulary for w in foul]) > 0.95 and not set(plain) & set(index.vocabulary)
    assert all((index.score(text(i % 2))[0] >= 0.5) == (i % 2) for i in range(100))


def test_copies_of_an_example_teach_no_words():
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    rows = [(i, i % 2, 1.0, " ".join([*rng.choice(plain, 40), *(["vile"] if i % 2 else [])])) for i in range(400)]
    once = " ".join([*rng.choice(plain, 60), "chance"])
    rows += [(1000 + i, 1, 1.0, f"{once} end{i}") for i in range(30)]
    index = toxicity.Index(rows)
    assert "vile" in index.vocabulary and "chance" not in index.vocabulary
    assert index.votes.sum() == len(rows)


class PlainToxicity:
    """The model from the examples alone: dense vectors, all cosines, and the rising fit by its max-min formula."""

    def __init__(self, rows, calibrated=True):
        rows = toxicity.without_copies(rows) if calibrated else rows
        bags = [self.bag(x) for *_, x in rows]
        n = [sum(r[1] == y for r in rows) for y in (0, 1)]
        df = [{t: sum(t in b for b, r in zip(bags, rows) if r[1] == y) for t in {t for b in bags for t in b}} for y in (0, 1)]
        chi = {}
        for t in df[0]:
            table = np.array([[df[y][t], n[y] - df[y][t]] for y in (0, 1)], dtype=float)
            want = table.sum(axis=1, keepdims=True) * table.sum(axis=0) / table.sum()
            chi[t] = ((table - want) ** 2 / want).sum() if (want > 0).all() and df[0][t] + df[1][t] >= toxicity.LEAST_DOCS else 0.0
        self.terms = [t for t in chi if chi[t] >= toxicity.LEAST_CHI2 - 1e-9 and df[1][t]]
        self.idf = np.array([toxicity.COMMON_WEIGHT, *(np.log(1 + len(rows) / (df[0][t] + df[1][t])) for t in self.terms)])
        groups = {}
        for (_, label, stands, _), bag in zip(rows, bags):
            groups.setdefault(tuple(bag.get(t, 0) for t in self.terms), [0.0, 0.0])[label] += stands
        self.vectors, self.votes = np.array([self.vector(k) for k in groups]), np.array(list(groups.values()))
        self.knots, self.rates = [0.0, 1.0], [0.0, 1.0]
        if calibrated:
            self.fit([(PlainToxicity(rows[1 - h :: 2], False).score(x), y, s) for h in (0, 1) for _, y, s, x in rows[h::2] if {r[1] for r in rows[1 - h :: 2]} == {0, 1}])

    def fit(self, seen):
        by = {}
        for share, y, stands in seen:
            held = by.setdefault(round(share, 9), [0.0, 0.0])
            held[0] += y * stands
            held[1] += stands
        x = sorted(by)
        toxic, rows = (np.array([by[s][k] for s in x]) for k in (0, 1))
        fit = [max(min(toxic[a : b + 1].sum() / rows[a : b + 1].sum() for b in range(i, len(x))) for a in range(i + 1)) for i in range(len(x))]
        knots, rates = [0.0], [0.0]
        for value in sorted(set(np.round(fit, 9))):
            at = np.isclose(fit, value, atol=1e-8)
            knots.append((np.array(x)[at] * rows[at]).sum() / rows[at].sum())
            rates.append(max(rates[-1], (toxic[at].sum() + 0.1) / (rows[at].sum() + 0.2)))
        self.knots, self.rates = [*knots, 1.0], [*rates, 1.0]

    @staticmethod
    def bag(text):
        found = {}
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            for t in [w, *(w[:k] + "*" for k in range(4, 9) if k < len(w))]:
                found[t] = found.get(t, 0) + 1
        return found

    def vector(self, counts):
        x = np.array([1, *counts])
        w = np.where(x > 0, self.idf * (1 + np.log(np.maximum(x, 1))), 0.0)
        return w / np.sqrt((w * w).sum())

    def score(self, text):
        bag = self.bag(text)
        cosine = np.round(self.vectors @ self.vector([bag.get(t, 0) for t in self.terms]), 12)
        near = np.argsort(-cosine, kind="stable")[: toxicity.NEIGHBOURS]
        clean, foul = (cosine[near] / cosine[near[0]]) ** toxicity.POWER @ self.votes[near]
        return float(np.interp((foul + 0.02) / (clean + foul + 0.2), self.knots, self.rates))


def test_toxicity_scores_against_a_plain_model(spark, tables):
    docs, labels = common.documents(spark, tables), spark.read.parquet(f"{tables}/labels.parquet")
    rows = toxicity.examples(docs, labels)
    own, index = PlainToxicity(rows), toxicity.Index(rows)
    assert set(index.vocabulary) == set(own.terms) and len(own.votes) <= toxicity.NEIGHBOURS
    got = {r.doc_id: r.score for r in queries()["op5_toxicity"](spark, tables).collect()}
    for r in docs.where("doc_id is not null and doc_id <> 8").collect():
        assert abs(got[r.doc_id] - own.score(r.text or "")) < 1e-9


def test_toxicity_finds_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic in (0, 1)").select("doc_id", "toxic")
    rows = queries()["op5_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").select("toxic", "score", "predicted").toPandas()
    foul = rows.toxic == 1
    assert rows.predicted[foul].mean() >= 0.9 and rows.predicted[~foul].mean() <= 0.03
    for low, high in ((0.0, 0.1), (0.9, 1.01)):  # the score is a rate
        part = rows[(rows.score >= low) & (rows.score < high)]
        assert abs(part.toxic.mean() - part.score.mean()) < 0.12


def test_of_several_texts_of_a_doc_id_the_same_one_is_learned(spark):
    docs = spark.createDataFrame([(i, f"text {k} of {i}") for i in range(60) for k in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    first = toxicity.examples(docs, labels)
    assert first == toxicity.examples(docs.repartition(7), labels) and len({r[0] for r in first}) == len(first)


def test_block_max_neighbours_are_exact():
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 3 == 0), 1.0, " ".join(rng.choice(["foul", "nasty", "kind", "calm", "sky"], 6)) + (" vile" if i % 3 == 0 else "")) for i in range(300)]
    index = toxicity.Index(rows)
    dense = np.zeros((len(index.votes), len(index.idf)))
    for (t, b), (at, w) in index.postings.items():
        dense[b * toxicity.BLOCK + at, t] = w
    for *_, text in rows[:50]:
        key = index.key(toxicity.Counter(text.split()))
        ids, w = index.weights(key)
        best = np.sort(dense[:, ids] @ w)[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose([s for s, _ in index.neighbours(key)], best)


def test_language(spark, tables):
    x = queries()["op6_language_id"](spark, tables).toPandas().set_index("doc_id")
    assert x.lang_pred.loc[[1, 2, 3]].eq("und").all() and x.score.between(0, 1).all()
    assert [x.lang_pred[i] for i in range(20, 140)] == ["en" if i % 2 else "de" for i in range(20, 140)]
    assert set(x.index[x.held_out]) == {i for i in x.index if i == i and zlib.crc32(str(int(i)).encode()) % 5 == 0}


def test_every_language_is_learned_and_not_its_header(spark):
    rng = np.random.default_rng(9)
    words = {f"l{k:02d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for k in range(70)}
    header = ("this file is given as it is and may be copied by all who keep these lines " * 6)[:400]
    rows, n = [], 0
    for lang, own in words.items():
        for _ in range(8 if lang < "l60" else 6):
            n += 1
            rows.append((n, header + " ".join(rng.choice(own, 170)), lang))
    rows.append((n + 1, "1 " * 600 + "only letters", "late"))
    learned = spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 or r[2] != "late"], "doc_id long, text string, lang string")
    samples = language_id.learn(learned)
    assert set(words) <= set(samples) and all(re.search("[a-z]", x.decode()) for x in samples.values())
    asked = [(i, " ".join(rng.choice(own, 20)), lang) for i, (lang, own) in enumerate(words.items())]
    got = {r.doc_id: r.lang_pred for r in language_id.predict(spark.createDataFrame(asked, "doc_id long, text string, lang string"), samples).collect()}
    assert all(got[i] == lang for i, _, lang in asked)


def test_language_costs_are_of_one_parse_of_the_whole_text():
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdeé "), rng.integers(1, 9))) for _ in range(40)]
    text = " ".join(rng.choice(words, 3000))
    samples = {"x": " ".join(words).encode(), "y": b"abc " * 30, "z": text[500:9000].encode()}
    parser = language_id.CrossParser(samples)
    texts = [text.encode(), text[700:8000].encode(), b"", b"#" * 2000, ("q" + text[600:3000]).encode(), b"abc " * 700]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    want = np.zeros((len(texts), 3))
    for k, table in enumerate(parser.tables):
        for i, t in enumerate(texts):
            state, phrases = 0, 1 if t else 0
            for c in t:
                state = int(table[state + int(parser.lut[c])])
                phrases += state >> language_id.FLAG
                state &= (1 << language_id.FLAG) - 1
            want[i, k] = phrases * parser.bits[k]
    assert np.allclose(parser.costs(data, offsets), want)


def test_suffix_automaton_knows_all_substrings():
    step = language_id.suffix_automaton(b"abcbc")
    for a in range(5):
        for b in range(a + 1, 6):
            state = 0
            for c in b"abcbc"[a:b]:
                state = step[state][c]
    assert ord("a") not in step[step[0][ord("c")]]


def plain_jump(key, shards):
    """The published loop of jump consistent hashing, on one key."""
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding_against_the_plain_loop(spark, tables):
    from pyspark.sql import functions as F

    keys = {r.doc_id: r.k % (1 << 64) for r in common.documents(spark, tables).select("doc_id", F.xxhash64("doc_id").alias("k")).collect()}
    got = queries()["op7_sharding"](spark, tables).collect()
    text = {r[0]: r[1] or "" for r in awkward()}
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (plain_jump(keys[r.doc_id], 40), plain_jump(keys[r.doc_id], 41))


def test_growing_moves_rows_only_into_the_new_shard():
    keys = np.random.default_rng(0).integers(-(1 << 63), 1 << 63 - 1, 20_000)
    a, b = sharding.jump_hash(keys, 40), sharding.jump_hash(keys, 41)
    assert set(b[a != b]) == {40} and 0.015 < (a != b).mean() < 0.035 and a.max() == 39


def test_slots_have_no_gaps(spark, tables):
    x = queries()["op7_sharding"](spark, tables).toPandas()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in x.groupby("shard"))


def test_fingerprints_and_components_against_plain_ones(spark, tables):
    import xxhash

    rows = []
    for i, t in texts():
        words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        rows.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if (rows[a][1] ^ rows[b][1]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, np.inf), np.inf if i is None else i)
    want = [(i, f"{f:016x}", None if least[r] == np.inf else float(least[r])) for (i, f), r in zip(rows, root)]
    assert keyed(queries()["op8_simhash"](spark, tables).toPandas(), "fingerprint", "component_id") == expect(*want)


def test_simhash_links(spark, tables):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, d, replace=False))) for d in (1, 3, 4, 5) for _ in range(6)]]))
    root = np.arange(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            root[root == root[j]] = min(root[i], root[j])
            root[root == root[i]] = min(root[i], root[j])
    frame = spark.createDataFrame([(i, int(f.astype(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.group(common.cut(frame)).collect()}
    assert len(set(got.values())) == len(set(root)) and all((got[i] == got[j]) == (root[i] == root[j]) for i in range(0, len(fps), 7) for j in range(len(fps)))


def test_long_runs_link_like_pairs():
    fps = np.random.default_rng(1).choice(1 << 10, 300, replace=False).astype(np.uint64)
    a, b = simhash.forest(*simhash.links_in_runs(np.zeros(300, dtype=np.int64), fps, 1))
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps) <= 1, 1))
    x, y = simhash.forest(fps[i], fps[j])
    assert sorted(zip(a, b)) == sorted(zip(x, y))


def test_stage_links_by_similarity(spark):
    rng = np.random.default_rng(7)
    lines = []
    for _ in range(30):  # a middle, and copies with 0 to 7 of 120 words changed
        words = [f"w{k}" for k in rng.integers(0, 5000, 120)]
        for changes in (0, 1, 2, 3, 4, 5, 6, 7):
            copy = list(words)
            for at in rng.choice(120, changes, replace=False):
                copy[at] = f"x{rng.integers(0, 10**9)}"
            lines.append(" ".join(copy))
    middle = [f"v{k}" for k in range(100)]  # a block that many texts share
    lines += [" ".join([*middle[:97], f"y{i}", f"y{i}", f"y{i}"]) for i in range(60)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, lines)]
    root = np.arange(len(lines))
    for i in range(len(lines)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    rows = [(i, x) for i, x in enumerate(lines)] + [(1000, lines[3].upper()), (1001, None), (1002, " "), (None, lines[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(r.doc_id for r in simhash.stage(docs).where("doc_id is not null").collect())
    assert left == sorted({*root.tolist(), 1001}) and 31 < len(left) < len(lines) - 60


def test_quality_base_columns(spark, tables):
    want = []
    for i, t in texts():
        w, at, cover = re.findall(WORD, t), {}, set()
        for k in range(len(w) - 4):
            at.setdefault(tuple(w[k : k + 5]), []).append(k)
        for ks in at.values():
            cover |= {k + d for k in ks for d in range(5)} if len(ks) > 1 else set()
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)))
    got = quality.judge(common.documents(spark, tables)).toPandas()
    assert keyed(got, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == expect(*want)


def test_each_quality_measure_rejects_and_follows_its_group(spark):
    rng = np.random.default_rng(4)

    def words(n, prefix="w"):
        return [f"{prefix}{k:04d}" for k in rng.integers(0, 9999, n)]

    def repeats(n):  # n of 200 words are in repeats of five
        x = words(200 - n)
        return " ".join(x + x[:5] * (n // 5))

    def lines(same):
        return "\n".join(" ".join(words(8)) + "\nthe same again" * (i < same) for i in range(12 - same))

    odd = {1: " ".join(words(60, "w" * 20)), 2: " ".join(w + "#" for w in words(60)), 3: lines(6), 4: repeats(35)}
    rows = [(i, x, "en", "clean") for i, x in odd.items()]
    rows += [(100 + i, " ".join(words(100)), "en", "clean") for i in range(300)]
    rows += [(1000 + i, (lines(6) if i % 5 == 1 else repeats(35)) if i % 5 < 3 else " ".join(words(100)), "en", "forms") for i in range(300)]
    x = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().set_index("doc_id")
    assert not x.base_failed.any() and not x.kept[list(odd)].any()
    assert x.kept[x.index >= 100].all()
    for m, i in zip(quality.MEASURES, odd):  # each by its own measure
        assert x.loc[i, m] > x.loc[i, f"{m}_high"]
    for m in ("duplicate_line_rate", "repeated_word_rate"):
        assert x.loc[100, f"{m}_high"] < x.loc[1000, f"{m}_high"]


def plain_cell(x):
    return 0 if x <= quality.LEAST else 1 + int(np.floor(np.log(x / quality.LEAST) / np.log(1 + quality.GRID)))


def plain_points(weighted):
    """The cells of a distribution at even places, PRIOR rows in all."""
    order, at, out = sorted(weighted), 0.0, []
    whole = sum(w for _, w in order)
    for i in range(quality.POINTS):
        at, want = 0.0, (i + 0.5) / quality.POINTS * whole
        for cell, w in order:
            at += w
            if at >= want - 1e-6:
                break
        out.append((cell, quality.PRIOR / quality.POINTS))
    return out


def plain_fence(own, lang, everything, lower, upper, wide, floor):
    """(low, high) from order statistics of a group's cells, its language's points and those of all rows."""
    cells = lambda values: [(plain_cell(v), 1.0) for v in values]
    mixed = sorted(cells(own) + plain_points(cells(lang) + plain_points(cells(everything))))
    whole = sum(w for _, w in mixed)

    def middle(q):
        at = 0.0
        for cell, w in mixed:
            at += w
            if at >= q * whole - 1e-6:
                break
        return 0.0 if cell == 0 else quality.LEAST * (1 + quality.GRID) ** (cell - 0.5)

    a, b = middle(lower), middle(upper)
    return a - wide * max(b - a, floor), b + wide * max(b - a, floor)


def test_quality_verdicts_against_order_statistics(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(2500):
        lang, source = [("en", "a"), ("en", "b"), ("en", "few"), ("de", "a"), (None, None)][i % 5] if i % 25 else ("xx", "rare")
        words = ["x" * int(rng.integers(2, 3 + i % 9 + (60 if rng.random() < 0.02 else 0))) + "#" * int(rng.random() < 0.1 * (i % 3)) for _ in range(int(rng.integers(5, 80)))]
        if i % 61 == 7:  # odd ones, each by a measure
            words = [[w + "#" * 9, "y" * 90 + str(k), w][i % 3] for k, w in enumerate(words)]
        text = " ".join(words) + "\nsame line" * int(rng.integers(0, 6 if source == "b" else 2)) + (" ".join(words[:20]) if rng.random() < 0.1 else "")
        rows.append((i, text if source != "few" or i % 50 == 2 else None, lang, source))
    x = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    good = x[~x.base_failed]
    none = lambda v: v is None or v != v
    same = lambda col, v: col.isna() if none(v) else col == v
    known: dict = {}
    for _, r in x.iterrows():
        group = tuple(None if none(v) else v for v in (r.lang, r.source))
        if group not in known:
            own, lang = good[same(good.lang, r.lang) & same(good.source, r.source)], good[same(good.lang, r.lang)]
            known[group] = {m: plain_fence(own[m], lang[m], good[m], a, b, wide, floor) for m, (floor, _, (a, b, wide)) in quality.MEASURES.items()} if len(own) else {}
        kept = not r.base_failed
        for m, (lo, hi) in known[group].items():
            kept = kept and r[m] <= hi and (not quality.MEASURES[m][1] or r[m] >= lo)
        assert kept == r.kept, r
    assert 5 < (~x.kept & ~x.base_failed).sum()
    assert all(len({round(f[m][1], 6) for f in known.values() if f}) > 1 for m in quality.MEASURES)


def test_secrets_against_a_regex_engine(spark, tables):
    kinds = [re.compile(rf"(?i:{secrets._KEY})({secrets._VALUE}+)"), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    want = []
    for i, t in texts():
        spans = [(m.start(), k, m.end()) for k, p in enumerate(kinds) for m in p.finditer(t) if (len(m[2]) >= 6 if k == 0 else len(m[0]) >= (0, 20, 24)[k])]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        want.append((i, *[sum(s[1] == k for s in spans) for k in range(3)], hashlib.sha256(joined.encode()).hexdigest()))
    assert keyed(queries()["op10_secret_scan"](spark, tables).toPandas(), "n_assign", "n_access", "n_hex", "base_sha256") == expect(*want)


@pytest.mark.parametrize("pattern", ["a(b|c)*d?", "[a-c]{2,3}x+", "(ab|a)(c|bcd)?", "[^ab]c"])
def test_automata_match_like_regexes(pattern):
    dfa, rng = Dfa([(pattern, False)], search=False), np.random.default_rng(0)
    for _ in range(300):
        text = bytes(rng.choice(list(b"abcdx"), 7))
        state = 0
        for c in text:
            state = dfa.table[state + dfa.classes[c]]
        assert bool(dfa.accepts[state // dfa.width]) == bool(re.fullmatch(pattern.encode(), text))


def test_pipeline_stages_against_plain_versions(spark, tables):
    """Each stage on what the one before it kept."""
    import corpus_pipeline as c
    from tokenizers import Tokenizer

    before = common.documents(spark, tables)
    stages = dict(c.STAGES)

    def after(name):
        out = common.materialise(stages[name](spark, before, tables))
        assert out.columns == before.columns
        return out, sorted(((r.doc_id, r.text) for r in before.collect()), key=repr), sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)

    samples = language_id.learn(before)
    parser = language_id.CrossParser(samples)
    kept, was, now = after("language_id")

    def clear(text):
        raw, least = text.encode(), np.inf
        for k, table in enumerate(parser.tables):
            state, phrases = 0, 1
            for b in raw:
                state = int(table[state + int(parser.lut[b])])
                phrases += state >> language_id.FLAG
                state &= (1 << language_id.FLAG) - 1
            least = min(least, phrases * parser.bits[k])
        return any(x.isalpha() for x in text) and (len(raw) < language_id.LEAST_JUDGED or least <= language_id.REJECT_BITS * len(raw))

    assert now == [r for r in was if clear(r[1] or "")] and 0 < len(now) < len(was)

    before = kept
    kept, was, now = after("exact_dedup")
    first: dict = {}
    for i, t in sorted(was, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    assert [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in now] == sorted(((i, k) for k, (i, _) in first.items()), key=repr) and len(now) < len(was)

    before = kept
    kept, was, now = after("simhash_dedup")
    sets = []
    for _, t in was:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(was)))
    for a in range(len(was)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    least: dict = {}
    for (i, _), r in zip(was, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    assert now == [x for x, r in zip(was, root) if x[0] is None or least[r] == x[0]]

    before = kept
    kept, was, now = after("mixing")
    text = dict(was)
    assert set(now) <= set(was) and all(text[i] == t for i, t in now)
    source = {r.doc_id: r.source for r in before.collect()}
    size: dict = {}
    got: dict = {}
    for rows, into in ((was, size), (now, got)):
        for i, t in rows:
            into[source[i]] = into.get(source[i], 0) + len(re.findall(WORD, t or ""))
    for s, want in plain_targets(size).items():  # whole documents, so within a few of the source's largest
        assert abs(got.get(s, 0) - want) <= 0.25 * want + 2 * max(len(re.findall(WORD, t or "")) for i, t in was if source[i] == s)
    assert max(now.count(r) for r in set(now)) <= 4

    before = kept
    t = Tokenizer.from_file(bpe.default_path())
    want = []
    for i, x in now:
        ids = t.encode(x, add_special_tokens=False).ids
        want.append((float(i) if i is not None else None, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert keyed(stages["bpe"](spark, before, tables).toPandas(), "n_tokens", "ids_sha256", "decoded_sha256") == expect(*want)


@pytest.mark.parametrize("stage, name", [
    (exact_dedup.stage, "__digest"), (exact_dedup.stage, "__of"), (simhash.stage, "__gone"), (simhash.stage, "__OF"), (mixing.stage, "__id"), (mixing.stage, "__tie"),
    (mixing.stage, "__copies"), (mixing.stage, "__copy"), (language_id.stage, "__lettered"),
])
def test_clashing_columns_are_refused(spark, tables, stage, name):
    docs = common.documents(spark, tables).withColumn(name, common.F.lit("own"))
    with pytest.raises(ValueError, match="the input has columns"):
        stage(docs)


def test_near_copies_go_by_doc_id_and_text(spark):
    x, y, z = ("".join(f"{c}{i} " for i in range(40)) for c in "xyz")
    rows = [(1, x), (2, x + "a"), (2, y), (3, z), (None, y + "b"), (None, z + "c"), (None, "alone in its words and with none like it"), (4, y), (4, y)]
    rows += [(5, "one two three four five six seven eight nine ten"), (5, "ONE two three four five six seven eight nine ten eleven")]
    got = simhash.stage(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = sorted((r.doc_id or 0, r.text) for r in got)
    assert left[:4] == sorted([(0, "alone in its words and with none like it"), (1, x), (2, y), (3, z)])
    assert [r[0] for r in left[4:]] == [5]


def test_near_copies_of_equal_rows_stay_or_go_together(spark):
    x = "".join(f"w{i} " for i in range(40))
    docs = spark.createDataFrame([(1, x), (1, x), (2, x + "a"), (2, x + "a")], "doc_id long, text string")
    assert [tuple(r) for r in simhash.stage(docs).collect()] == [(1, x), (1, x)]


def test_pipeline(spark, tables):
    import corpus_pipeline as c

    docs = common.documents(spark, tables)
    for name, stage in c.STAGES[:-1]:
        out = common.materialise(stage(spark, docs, tables))
        assert out.columns == docs.columns, name
        docs = out
    assert c.run(spark, tables).count() == docs.count() > 0
    left = {r[0] for r in docs.select("doc_id").collect()}
    assert not left & {1, 2, 3, 8}


def test_stage_takes_candidates_by_simhash(spark):
    """Without any min-wise block, texts whose fingerprints are close are found, each group whole; others are not."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(2000)]
    base = [" ".join(rng.choice(words, 400)) for _ in range(4)]
    texts = [*base, *(f"{b} end{i}" for b in base[:3] for i in range(2)), *(f"{base[0]} tail {i}" for i in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = common.cut(simhash.wide_fingerprints(docs).withColumn("keys", F.array().cast("array<long>")))
    sims = {r.fp: r.sim for r in prints.collect()}
    far = lambda a, b: ((sims[a] ^ sims[b]) & (1 << 64) - 1).bit_count()
    pairs = {(r.a, r.b) for r in simhash.close_pairs(prints.select(F.col("sim").alias("fp"), F.col("fp").alias("id"))).collect()}
    assert pairs and all(far(a, b) <= simhash.DISTANCE for a, b in pairs)
    found = {(r.a, r.b) for r in simhash.components(simhash.similar_forest(docs, prints)).collect()}
    root = {}
    for a, b in found:
        root[a] = b
    want = {}
    for a in sims:
        near, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for y in sims:
                if y not in near and far(x, y) <= simhash.DISTANCE:
                    near.add(y)
                    todo.append(y)
        want[a] = min(near)
    assert {a: root.get(a, a) for a in sims} == want
    assert len(set(want.values())) < len(texts) - 20
