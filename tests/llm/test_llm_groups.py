"""Near-duplicates, repeated strings, sharding, packing and the pipeline against brute force."""
import hashlib
import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline
from learnlog.llm import common, neardup, packing, repeats, sharding
from llm_cases import ROWS, SCHEMA, SF, components, edge_docs, near_copies, removed_bytes, shingles


# ---- shared helpers

def test_gram_hashes_and_windows():
    rng = np.random.default_rng(1)
    codes = common.coded(rng.integers(0, 256, 300).astype(np.uint8))
    for k in (1, 2, 5, 16, 31):
        got = common.gram_hashes(codes, k)
        want = [sum(int(c) * pow(common._MULT, k - 1 - j, 1 << 64) for j, c in enumerate(codes[i:i + k])) % (1 << 64)
                for i in range(len(codes) - k + 1)]
        assert got.tolist() == want
        assert common.window_reduce(codes, k, np.minimum).tolist() == [int(codes[i:i + k].min())
                                                                      for i in range(len(codes) - k + 1)]
    assert len(common.gram_hashes(codes[:3], 5)) == 0


def test_word_hashes_do_not_depend_on_place():
    texts = [b"alpha beta", b"", b"beta  alpha gamma", b" ", b"gamma"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    h, row = common.word_hashes(data, np.r_[0, np.cumsum([len(t) for t in texts])], neardup._SPACE)
    assert row.tolist() == [0, 0, 2, 2, 2, 4]
    assert h[0] == h[3] and h[1] == h[2] and h[4] == h[5] and len(set(h.tolist())) == 3


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    n = 120
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["comp"] for r in common.connected_components(df).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}
    assert common.connected_components(df.limit(0)).count() == 0


# ---- near-duplicates

def _check_components(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = neardup.near_duplicates(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components(texts)
    assert all(r["n_shingles"] == len(shingles(texts[r["doc_id"]])) for r in got)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["component_id"] for r in neardup.op5_near_duplicates(spark, SF).collect()}
    assert got == components(texts)


@pytest.mark.parametrize("block_rows", [neardup.BLOCK_ROWS, 16])
def test_large_group_of_near_copies(spark, monkeypatch, block_rows):
    """Copies with few and with many edits: most hang together, the rest must be ruled out; with
    small blocks the group takes several tasks and the second pass."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block_rows)
    texts = dict(enumerate(near_copies(90, seed=4)))
    texts |= {1000 + i: t for i, t in enumerate(near_copies(40, words=200, seed=9, most_edits=14))}
    _check_components(spark, texts)


def test_two_texts_under_one_id(spark):
    """Rows with equal ids are one node, whatever their texts, and whichever of them a third one is near."""
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    rows = [(5, a), (5, b), (6, [*a, "x"]), (7, [*b, "y"]), (7, [*b, "y"]), (9, b), (9, c), (10, [*c, "z"]), (3, ["alone"] * 9)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(5, 5), (6, 5), (7, 5), (9, 5), (10, 5), (3, 3)}


def test_many_blocks_of_texts_that_are_not_linked(spark, monkeypatch):
    """One candidate cluster of different families: hardly anything hangs together with block 0."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 8)
    texts = {}
    for f in range(8):
        texts |= {100 * f + i: t for i, t in enumerate(near_copies(12, words=60, seed=f % 2, most_edits=16 + f))}
    _check_components(spark, texts)


def test_links_across_blocks_are_found():
    """cluster_links connects what the pair function connects, however the blocks fall."""
    sets = [np.unique(np.random.default_rng(i // 3).integers(0, 1 << 62, 40, dtype=np.uint64)) for i in range(12)]
    size = np.array([len(s) for s in sets])
    a, b = neardup.true_pairs(size, [s.tobytes() for s in sets], 12)
    assert {(i, j) for i, j in zip(a, b)} == {(i, j) for i in range(12) for j in range(i + 1, 12) if i // 3 == j // 3}
    a, b = neardup.true_pairs(size, [s.tobytes() for s in sets], 2)
    assert {(i, j) for i, j in zip(a, b)} == {(0, 1), (0, 2), (1, 2)}


def test_joint_likelihood_is_near_the_truth():
    rng = np.random.default_rng(8)
    for j in (0.3, 0.6, 0.75, 0.9):
        both, one = int(1000 * j), int(1000 * (1 - j) / 2)
        pool = rng.integers(0, 1 << 63, both + 2 * one, dtype=np.uint64)
        x, y = pool[:both + one], np.r_[pool[:both], pool[both + one:]]
        rx, ry = neardup.registers(x), neardup.registers(y)
        sim, ratio = neardup.joint_likelihood(*[np.array([float(v)]) for v in (
            len(x), len(y), (rx > ry).sum(), (rx < ry).sum(), (rx == ry).sum())])
        assert abs(sim[0] - j) < 0.15
        assert (np.maximum(rx, ry) == neardup.registers(pool)).all()  # merging is the maximum
        if j >= 0.75:
            assert sim[0] >= 0.75 or ratio[0] <= neardup.RULED_OUT


def test_near_duplicates_edges(spark):
    got = neardup.near_duplicates(edge_docs(spark)).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert by[None][1:] == (None, True)
    for i in (1, 2, 4, 16):
        assert by[i] == (0, i, True)
    assert [by[i][1] for i in (6, 7, 8, 12, 13, 14, 15)] == [6, 6, 6, 12, 12, 14, 14]
    assert by[5][0] == len(shingles(ROWS[5][1])) and by[14][0] == 1
    assert neardup.near_duplicates(edge_docs(spark, [])).count() == 0


# ---- repeated strings

def _check_repeats(spark, texts, **options):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    gone = removed_bytes(texts)
    got = repeats.remove_repeats(df, kept_col="left", **options).collect()
    assert len(got) == len(texts)
    for r in got:
        raw, cut = (texts[r["doc_id"]] or "").encode(), set(gone[r["doc_id"]])
        kept = bytes(c for p, c in enumerate(raw) if p not in cut)
        assert (r["n_bytes"], r["n_removed"]) == (len(raw), len(cut))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert r["n_spans"] == sum(1 for p in cut if p - 1 not in cut)
        assert r["left"] == kept.decode("utf-8", "ignore")


def _passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    shared = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(6)] + ["z" * 130, "ab" * 60]
    texts = {}
    for i in range(40):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 30)))]
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += [s[a:] if rng.random() < 0.3 else s, " ".join(word() for _ in range(rng.randrange(0, 12)))]
        texts[rng.randrange(10 ** 6)] = " ".join(parts)
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_repeats_brute_force(spark, seed):
    _check_repeats(spark, _passages(seed))


def test_repeats_beyond_a_tasks_memory(spark):
    texts = _passages(7)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    small = repeats.repeated_ranges(df, kept_strings=3)
    large = repeats.repeated_ranges(df)

    def covered(spans):
        return {r["id"]: {p for s in r["spans"] for p in range(s["start"], s["start"] + s["size"])} for r in spans.collect()}

    want = {i: set(p) for i, p in removed_bytes(texts).items() if p}
    assert covered(small) == covered(large) == want


def test_repeats_edges(spark):
    copied = "a text of more than fifty bytes that is there three times over"
    rows = [*ROWS, (20, "short"), (21, "q" * 49), (22, "q" * 49), (23, "q" * 50), (24, "q" * 51), (None, "q" * 60),
            (30, copied), (31, copied), (32, copied), (32, "another text under the same id, also of over fifty bytes"),
            (33, "another text under the same id, also of over fifty bytes")]
    got = {}
    for r in repeats.remove_repeats(edge_docs(spark, rows), columns=("key", "spans"), kept_col="text").collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"]))
    assert sum(map(len, got.values())) == len(rows)
    assert got[12] == [(5000, 0, 0)] and got[13] == [(5000, 5000, 1)]
    assert got[22] == [(49, 0, 0)] and got[23] == [(50, 0, 0)] and got[24] == [(51, 51, 1)]
    assert sorted(got[None]) == [(len(ROWS[0][1]), 0, 0), (60, 0, 0)]
    assert got[1] == got[2] == [(0, 0, 0)] and len(got[8]) == 2
    n, m = len(copied), len(rows[-1][1])
    assert got[30] == [(n, 0, 0)] and got[31] == [(n, n, 1)] and got[33] == [(m, m, 1)]
    assert sorted(got[32]) == sorted([(n, n, 1), (m, 0, 0)])
    assert repeats.remove_repeats(edge_docs(spark, [])).count() == 0


def test_merged_ranges():
    a, b = repeats.merged(np.array([9, 0, 3, 20]), np.array([12, 4, 9, 21]))
    assert (a.tolist(), b.tolist()) == ([0, 20], [12, 21])


# ---- sharding

def test_shards_match_the_mixture(spark):
    rng = random.Random(3)
    rows = [(i, "t" * (i % 40), rng.choice(["a"] * 6 + ["b"] * 3 + ["c", None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.interleave(df, 8).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(2000))
    source = {i: s for i, _, s in rows}
    per = Counter(r["shard"] for r in got)
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 1
    for s, n in Counter(source.values()).items():
        share = Counter(r["shard"] for r in got if source[r["doc_id"]] == s)
        assert all(abs(share[k] - n / 8) <= 2 for k in range(8))
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(per[k]))
    text = {i: t.encode() for i, t, _ in rows}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 1, zlib.crc32(text[r["doc_id"]])) for r in got)
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.interleave(df, 8, slots=3).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}  # not a matter of the dealing


def test_sharding_edges(spark):
    got = sharding.interleave(edge_docs(spark), 5).collect()
    assert len(got) == len(ROWS) and max(Counter(r["shard"] for r in got).values()) <= 4
    assert {r["size"] for r in got if r["doc_id"] in (1, 2, 16)} == {1}
    assert sharding.interleave(edge_docs(spark, []), 8).count() == 0
    few = sharding.interleave(edge_docs(spark, ROWS[:2]), 8).collect()
    assert len({r["shard"] for r in few}) == 2


# ---- packing

def _check_packed(rows, texts, limit=1024):
    """texts: list of (id, text); every id of every text in exactly one piece, sequences gapless."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want, have = Counter(), Counter()
    for i, t in texts:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for r in {(r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i and r["doc_tokens"] == len(ids)}:
            if zlib.crc32(ids[r[0]:r[0] + r[1]].tobytes()) == r[2]:
                have[i] += r[1]
        want[i] += len(ids)
    assert sum(r["length"] for r in rows) == sum(want.values())
    assert have == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= limit
    return len(by)


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = packing.op10_packing(spark, SF).collect()
    n = _check_packed(rows, [(r["doc_id"], r["text"]) for r in docs])
    assert sum(r["length"] for r in rows) / (1024 * n) > 0.97


def test_packing_edges(spark):
    rows = packing.pack(edge_docs(spark), docs_per_task=5).collect()
    once = [r for r in ROWS if r[0] != 8]
    _check_packed([r for r in packing.pack(edge_docs(spark, once)).collect()], once)
    assert sum(r["doc_tokens"] for r in rows if r["doc_id"] == 8 and r["start"] == 0) == 2 * next(
        r["doc_tokens"] for r in rows if r["doc_id"] == 8)
    assert [(r["start"], r["length"]) for r in rows if r["doc_id"] == 1] == [(0, 1)]
    assert packing.pack(edge_docs(spark, [])).count() == 0


def test_fast_ids_are_the_tokenizers_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    tok, enc = Tokenizer.from_file(path), packing.Encoder(path)
    assert enc.fast is not None
    same = lambda t: enc.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids
    rng = random.Random(6)
    bits = ["word", "Ünï", "don't", "'s", "'S", "'ll", "漢字", "🙂", "12", "½²", "...", "\n", "\n\n", " ", "  ", "\t",
            "<|endoftext|>", "$$$", "a" * 30, "x\ny", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "“q”", "…", "ﬁ"]
    for _ in range(3000):
        text = rng.choice([" ", "", "\n"]).join(rng.choice(bits) for _ in range(rng.randrange(25)))
        assert same(text), repr(text)
    latin = [chr(c) for r in ((0, 0x250), (0x2010, 0x2028), (0x2030, 0x205F)) for c in range(*r)]
    assert all(same(x) for c in latin for x in (c, f"a{c}b", f" {c} {c}{c} 1{c}2", f"{c}\n{c}'s"))
    assert all(same(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))  # another kind: no fast way
    other = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.fast and other.encode("Some words").tolist() == word.encode("Some words", add_special_tokens=False).ids


def test_sum_of_squares_rule():
    """Each placement is one that no other level beats."""
    rng = random.Random(2)
    cap = 20
    p = packing.SumOfSquares(cap, 0)
    count = [0] * (cap + 1)
    for _ in range(500):
        size = rng.randrange(1, cap + 1)

        def after(level):
            c = list(count)
            if level:
                c[level] -= 1
            if level + size < cap:
                c[level + size] += 1
            return sum(x * x for x in c[1:cap])

        options = [0] + [h for h in range(1, cap - size + 1) if count[h]]
        _, level = p.place(size)
        assert level in options and after(level) == min(after(h) for h in options)
        if level:
            count[level] -= 1
        if level + size < cap:
            count[level + size] += 1
    assert p.count[1:cap].tolist() == count[1:cap]


# ---- pipeline

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = common.materialize(stage(spark, docs, SF), f"test-{k}")
        rows = docs.collect()
        if k == len(corpus_pipeline.STAGES) - 1:
            _check_packed(rows, [(i, r["text"]) for i, r in before.items()])
            continue
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        after = {r["doc_id"]: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        texts = {i: r["text"] for i, r in before.items()}
        if k == 0:
            assert len(after) >= 0.98 * len(before)
        if k == 1:
            assert set(after) == {i for i, c in components(texts).items() if i == c}
        if k == 2:
            gone = removed_bytes(texts)
            for i, r in after.items():
                cut = set(gone[i])
                kept = bytes(c for p, c in enumerate(texts[i].encode()) if p not in cut).decode("utf-8", "ignore")
                assert (r["text"], r["n_chars"]) == (kept, len(kept))
                assert (r["lang"], r["source"]) == (before[i]["lang"], before[i]["source"])
        if k == 3:
            items = [b["text"] for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(t in r["text"] for r in after.values() for t in items)
            assert len(after) >= 0.9 * len(before)
        if k in (0, 1, 3):
            assert all(after[i] == before[i] for i in after)


def test_pipeline_edges(spark):
    docs = edge_docs(spark, [*ROWS, (20, "the and of the in a house " * 8), (None, "y" * 200), (None, "y" * 200)])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.materialize(stage(spark, docs, SF), f"edge-{k}")
    assert docs.count() > 0
    docs = spark.createDataFrame([], SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.materialize(stage(spark, docs, SF), f"empty-{k}")
    assert docs.count() == 0


def test_run_gives_the_last_stages_rows(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert corpus_pipeline.ORACLE_SQL is None
