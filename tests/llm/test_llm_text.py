"""Fingerprints, decontamination, toxicity, chat formatting, language ID, licences."""
import hashlib
import os
import random
import sys
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from learnlog.llm import chat_format as C
from learnlog.llm import decontamination as D
from learnlog.llm import fingerprints as P
from learnlog.llm import language as L
from learnlog.llm import licenses as S
from learnlog.llm import toxicity as T
from llm_cases import CONTROL, ROWS, SF, edge_docs, infix_distance


# ---- fingerprints

def test_digest_is_stable_and_bounded():
    a = P.digest(b"the quick brown fox jumps over the lazy dog " * 9)
    assert a == P.digest(b"the quick brown fox jumps over the lazy dog " * 9) and len(a) == 132
    assert P.likeness(a, a) == 1.0
    b = P.digest(os.urandom(900))
    assert 0 <= P.likeness(a, b) <= 1 and P.likeness(a, b) == P.likeness(b, a)
    assert len({P.digest(b"x" * n) for n in range(3)}) == 3  # the length alone tells these apart


def test_likeness_falls_with_edits():
    rng = random.Random(5)
    words = [f"w{rng.randrange(900)}" for _ in range(800)]
    whole = P.digest(" ".join(words).encode())
    few = P.digest(" ".join(words[:760] + [f"q{i}" for i in range(40)]).encode())
    half = P.digest(" ".join(words[:400] + [f"q{i}z" for i in range(400)]).encode())
    assert 1 > P.likeness(whole, few) > P.likeness(whole, half)


def test_compare_with_next_edges(spark):
    rows = [r for r in ROWS if r[0] != 8] + [(8, "same WORDS in the same order, seven of them.")]
    got = {r["doc_id"]: r for r in P.compare_with_next(edge_docs(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    assert len(got) == len(rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        n = len(t)
        edited = t[:n - n // 2] + nxt[:n // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (P.digest(t.encode()), P.digest(edited.encode()))
        assert r["near_next"] == P.likeness(P.digest(t.encode()), P.digest(nxt.encode()))
    assert P.compare_with_next(edge_docs(spark, [])).count() == 0
    assert P.compare_with_next(edge_docs(spark, ROWS)).count() == len(ROWS)  # repeated rows stay
    one = P.compare_with_next(edge_docs(spark, [(3, "abcd")])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert P.fingerprint(edge_docs(spark)).count() == len(ROWS)


# ---- decontamination

def _edited(text, k, rng):
    c = list(text)
    for _ in range(k):
        p = rng.randrange(len(c))
        rng.choice([lambda: c.pop(p), lambda: c.insert(p, "~"), lambda: c.__setitem__(p, "^")])()
    return "".join(c)


def test_segments_within_budget_are_always_found():
    rng = random.Random(11)
    items = [(i, D.normalized(" ".join(f"tok{rng.randrange(3000)}" for _ in range(20)))) for i in range(12)]
    index = D.SegmentIndex.build(items, D.SEGMENT, D.Q, D.ERROR)
    noise = lambda n: " ".join(f"n{rng.randrange(10 ** 6)}" for _ in range(n))
    texts, want = [], []
    for t in range(60):
        s = rng.randrange(len(index.item))
        seg = "".join(map(chr, index.chars[s][:index.length[s]]))
        k = rng.randrange(int(index.budget[s]) + 1)
        texts.append(noise(rng.randrange(30)) + " " + _edited(seg, k, rng) + " " + noise(rng.randrange(30)))
        want.append((t, s))
    found = {(t, s): e for t, s, e, _, _ in D.search(index, texts)}
    assert set(want) <= set(found)
    for (t, s), e in found.items():
        seg = "".join(map(chr, index.chars[s][:index.length[s]]))
        assert infix_distance(seg, texts[t]) <= e <= index.budget[s]


def test_excerpts_at_every_offset_and_short_items():
    rng = random.Random(12)
    noise = lambda n: " ".join(f"n{rng.randrange(10 ** 6)}" for _ in range(n))
    long = D.normalized(" ".join(f"tok{rng.randrange(3000)}" for _ in range(40)))
    items = [(1, long), (2, "paris"), (3, "x = 7?"), (4, "漢字"), (5, long[:70])]
    index = D.SegmentIndex.build(items, D.SEGMENT, D.Q, D.ERROR)
    for size, most in ((64, 3), (70, 6), (82, 6)):
        for edits in (0, most):
            texts = [noise(9) + "#" + _edited(long[o:o + size], edits, rng) + "#" + noise(9)
                     for o in range(len(long) - size + 1)]
            assert {t for t, s, *_ in D.search(index, texts) if index.item[s] == 1} == set(range(len(texts)))
    texts = ["paris", "is it paris?", "comparison", "parish", "so x = 7? no", "max = 7?", "漢字", "漢字仮", "", noise(30)]
    got = {(t, index.item[s], texts[t][a:z]) for t, s, _, a, z in D.search(index, texts)}
    assert got == {(0, 2, "paris"), (1, 2, "paris"), (4, 3, "x = 7?"), (6, 4, "漢字")}


def test_leaks_and_edges(spark):
    passage = "A passage of the benchmark that is long enough to be told from chance, with some words more."
    bench = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (4, "short"), (5, "y" * 3000)],
                                  "item_id long, text string")
    rows = [*ROWS, (20, "before it " + passage.upper().replace(" ", "\n ") + " after"), (None, passage),
            (21, "y" * 5000), (22, passage[:40])]
    docs = edge_docs(spark, rows)
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, bench).collect()}
    assert got == {(20, 1), (None, 1), (21, 5)}
    for limit in (10, D.BLOCK_CHARS):  # many blocks or one
        assert {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, bench, block_chars=limit).collect()} == got
        left = D.without_leaks(docs, bench, block_chars=limit)
        assert left.columns == docs.columns
        assert sorted(map(str, (r["doc_id"] for r in left.collect()))) == sorted(
            str(i) for i, t in rows if (i, t) not in ((20, rows[-4][1]), (None, passage), (21, "y" * 5000)))
    assert D.leaks(edge_docs(spark, []), bench).count() == 0
    assert D.leaks(docs, bench.limit(0)).count() == 0
    assert D.without_leaks(docs, bench.limit(0)).count() == len(rows)


def test_query_finds_every_whole_item(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    truth = {(d["doc_id"], b["item_id"]) for d in docs for b in items if b["text"] in d["text"]}
    assert truth and {(r["doc_id"], r["item_id"]) for r in D.op2_decontamination(spark, SF).collect()} >= truth


# ---- toxicity

def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in T.op3_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(got[r["doc_id"]], r["toxic"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert len(got) == 1000 and len(held) > 50
    assert sum(r["predicted"] == y for r, y in held) / len(held) >= 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_toxicity_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(i, int(i in (5, 9)), 0) for i in range(3, 16)] + [(3, None, 0), (None, 1, 0)],
                                   "doc_id long, toxic int, quality int")
    net = T.train(docs, labels)
    got = T.score(docs, net).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 4, 16)}) == 1  # no words: one score
    assert T.train(docs, labels.where("toxic = 0")) is None
    assert {r["score"] for r in T.score(docs, None).collect()} == {0.0}
    assert T.score(edge_docs(spark, []), net).count() == 0


def test_rare_language_gets_a_threshold_of_its_own(spark):
    rng = random.Random(4)
    rows, labels = [], []

    def add(lang, n, bad, length):
        for i in range(n):
            toxic = int(i % 2)
            words = [f"{lang}{rng.randrange(300)}" for _ in range(length)]
            if toxic:
                words[rng.randrange(length)] = bad
            labels.append((len(rows), toxic))
            rows.append((len(rows), " ".join(words), lang))

    add("common", 6000, "slur", 30)
    add("rare", 60, "slur", 30)       # 1 % of the rows
    add("long", 60, "slur", 5500)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    net = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), max_rows=400)
    at = dict(zip(("common", "long", "rare"), net.threshold))
    assert len(net.threshold) == 3 and len(set(at.values())) == 3
    got = {r["doc_id"]: r["predicted"] for r in T.score(docs, net).collect()}
    for lang, least in (("common", 0.95), ("rare", 0.9), ("long", 0.9)):
        own = [got[i] == y for (i, y), r in zip(labels, rows) if r[2] == lang]
        assert sum(own) / len(own) >= least, (lang, sum(own) / len(own), at)


def test_toxic_words_of_long_texts_are_learned(spark):
    """All toxic texts have over 6,000 words and say the word once near the end; so have half of the clean ones."""
    rng = random.Random(8)
    rows = [(i, " ".join([f"w{rng.randrange(500)}" for _ in range(6500 if i % 4 in (1, 3) else 40)]
                         + ["slur"] * (i % 4 == 1) + ["fine"]), "en") for i in range(240)]
    rows += [(300 + i, " ".join([f"w{rng.randrange(500)}" for _ in range(T.WORDS + 100)] + ["slur"] * i), "en")
             for i in range(2)]  # behind the first pass of the filters
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(240)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in T.score(docs, T.train(docs, labels)).collect()}
    assert sum(got[i] == (i % 4 == 1) for i in range(240)) >= 230
    assert (got[300], got[301]) == (0, 1)


def test_toxicity_equals_a_naive_forward_pass(monkeypatch):
    rng = np.random.default_rng(5)
    vocab = rng.integers(1, 1 << 63, 60, dtype=np.uint64)
    texts = [rng.choice(vocab, n) for n in (0, 1, 2, 3, 7, 40, 0, 25)]
    y = np.array([0, 1, 0, 1, 0, 1, 0, 1], float)
    net = T.fit(texts, y, np.ones(8), ["a", "b"] * 4, epochs=3)
    h, row = np.concatenate(texts), np.repeat(np.arange(8), [len(t) for t in texts])

    def naive(text):
        a, b = net.rows(text)
        x = [net.tables[0][i] + net.tables[1][j] for i, j in zip(a, b)]
        best = []
        for i, k in enumerate(net.widths):
            for f in range(net.filters):
                z = [float(np.concatenate(x[s:s + k]) @ net.weight[i][:, f] + net.bias[i][f])
                     for s in range(len(x) - k + 1)]
                best.append(max([0.0, *z]))
        return float(np.dot(best, net.out)) + net.out_bias

    want = [naive(t) for t in texts]
    for words in (1 << 16, 5, 1):  # any number of words a pass
        monkeypatch.setattr(T, "WORDS", words)
        assert np.allclose(net.logits(h, row, 8), want, atol=1e-4)
        best, where = net.pooled(h, row, 8)
        assert (row[where[where >= 0]] == np.nonzero(where >= 0)[0]).all() and ((where >= 0) == (best > 0)).all()


def test_sample_is_bounded_by_bytes_whatever_the_length():
    picked = [{"id": i, "y": int(i == 99), "lang": "a", "size": 10 if i % 2 else 1000, "u": (i * 37 % 100) / 100}
              for i in range(100)]
    got = T.within(picked, 10_000)
    assert sum(r["size"] for r in got if r["y"] == 0) <= 11_000 and {r["y"] for r in got} == {0, 1}
    assert 0.3 <= sum(r["size"] == 1000 for r in got) / len(got) <= 0.7
    assert len(T.within(picked, 1 << 30)) == 100


def test_filter_of_labelled_ids_loses_none(spark):
    docs = spark.range(2000).select("id", F.lit("t").alias("text"))
    known = spark.range(0, 2000, 40).select("id")
    for bits in (64, 1 << 10, 1 << 24):
        got = {r["id"] for r in T.labelled(docs, known, bits).collect()}
        assert got >= set(range(0, 2000, 40))
    assert len(got) < 60


def test_convolution_sees_word_order():
    rng = np.random.default_rng(2)
    vocab = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
    bad = vocab[:2]
    texts, y = [], []
    for i in range(600):
        t = rng.choice(vocab[2:], 30)
        at = rng.integers(0, 28)
        t[at:at + 2] = bad if i % 2 else bad[::-1]  # the same two words, in one order or the other
        texts.append(t)
        y.append(i % 2)
    net = T.fit(texts, np.array(y, float), np.ones(600), ["a"] * 600, epochs=60)
    row = np.repeat(np.arange(600), 30)
    assert ((net.scores(np.concatenate(texts), row, 600) >= 0.5) == np.array(y)).mean() > 0.9


# ---- chat formatting

@pytest.mark.parametrize("template", [C.CHAT, C.Template(open="[INST]", says="|>", close="</s>", reserved=("<s>",))])
def test_chat_round_trip(spark, template):
    rng = random.Random(1)
    bits = [*template.controls, "\\", "\\\\", "<", "[", "|", " ", "\n", "é🙂", "word", "<\\", ""]
    turns = [(c, t, rng.choice(["user", "assistant", "system", "to<|ol", None]),
              "".join(rng.choice(bits) for _ in range(rng.randrange(12))) if rng.random() > 0.1 else None)
             for c in range(60) for t in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = C.format_conversations(df, template)
    got = {r["conv_id"]: r for r in C.read_back(formatted, template).collect()}
    for c in range(60):
        own = [(r or "", x or "") for k, _, r, x in turns if k == c]
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_text"] == "".join(f"{r}\n{x}\n" for r, x in own)
        assert got[c]["loss_text"] == "".join(x for r, x in own if r == "assistant")
    joined = {}
    for r in C.segment_rows(formatted).orderBy("conv_id", "segment").collect():
        joined[r["conv_id"]] = joined.get(r["conv_id"], "") + r["text"]
    assert joined == {c: r["formatted"] for c, r in got.items()}


def test_role_machine_and_edges(spark):
    say = lambda c, *roles: [(c, i, r, "x", 1) for i, r in enumerate(roles)]
    rows = [*say(1, "system", "user", "assistant"), *say(2, "user", "user", "assistant"), *say(3, "assistant"),
            *say(4, "user", "assistant", "user"), *say(5, "user", "assistant", "system"), (None, 0, "user", "a", 1),
            (None, None, None, None, 1), (6, 0, "user", "b", 1), (6, 0, "user", "b", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: (r["valid"], r["bad_turn"]) for r in C.format_conversations(df).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (False, 0), 4: (False, None), 5: (False, 2), None: (False, 0),
                   6: (False, 1)}
    assert C.format_conversations(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        C.Template(open="aa")


def test_planted_conversation(spark):
    r = C.op4_chat_format(spark, SF).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert (r["n_turns"], r["loss_chars"], r["valid"]) == (2, len(text), True)
    assert r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


# ---- language ID

def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = L.op7_language(spark, sf).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and held
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["rejected"] for r in got) <= 0.01 * len(got)


def test_language_edges(spark):
    learn = spark.createDataFrame(
        [(i, t, k) for i in range(30) for t, k in ((f"the cat and the dog number {i} of this house", "en"),
                                                   (f"le chat et le chien de la maison du voisin {i}", "fr"))]
        + [(99, "unlabelled", None)], "doc_id long, text string, lang string")
    model = L.train(learn)
    docs = edge_docs(spark, [*ROWS, (30, "the dog of this house and the cat"), (31, "le chien de la maison et le chat"),
                             (32, "漢字仮名交じり文の例です")])
    out = L.identify(docs, model)
    assert out.columns == [*[c for c in docs.columns if c != "score"], "lang_pred", "score", "rejected"]
    rows = out.collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in rows if r["doc_id"] is not None}
    assert got[30] == ("en", False) and got[31] == ("fr", False)
    assert {got[i] for i in (1, 2, 4, 11, 16)} == {("und", True)}
    assert got[32][0] in ("en", "fr") and got[32][1]
    assert L.train(learn.limit(0)) is None
    assert {r["lang_pred"] for r in L.identify(docs, None).collect()} == {"und"}
    assert L.identify(docs.limit(0), model).count() == 0


def test_long_texts_in_unlearned_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = spark.createDataFrame([(10 ** 6 + i, t, "en") for i, t in enumerate(("zq", "0x7 kv", "##q"))], docs.schema)
    for out in ("es", "fr"):
        model = L.train(docs.where(f"lang != '{out}'").unionByName(junk))
        rows = L.identify(docs.where("length(text) >= 300"), model, columns=["lang"]).collect()
        new = [r["rejected"] for r in rows if r["lang"] == out]
        known = [r["rejected"] for r in rows if r["lang"] != out]
        assert len(new) > 90 and sum(new) / len(new) >= 0.85 and sum(known) / len(known) <= 0.01


# ---- licences

def test_licences(spark):
    rows = [*ROWS, (30, "bla bla. RELEASED under   the MIT-License! bla"), (31, "All rights reserved"),
            (32, "This work is licensed under the GNU General Public License, version 2."),
            (33, "That work is licensed under the GNU General Public License, version 3."),
            (34, "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0."), (35, "licensed under the old mill"),
            (36, "Licensed under CC BY-NC 4.0. " * 3)]
    got = {(r["doc_id"], r["license"]): r for r in S.scan(edge_docs(spark, rows)).collect()}
    assert set(got) == {(30, "MIT"), (31, "all-rights-reserved"), (32, "GPL-2.0"), (33, "GPL-3.0"),
                        (34, "CC-BY-NC-4.0"), (34, "CC-BY-4.0"), (36, "CC-BY-NC-4.0")}
    assert got[(30, "MIT")]["first_word"] == 2 and got[(30, "MIT")]["containment"] == 1.0
    assert 0.8 <= got[(33, "GPL-3.0")]["containment"] < 1
    assert S.scan(edge_docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        S.scan(edge_docs(spark), notices=(("a", "two words"),))
    assert CONTROL  # its control strings hold no notice


#: Copied from the publishers' texts, with the line breaks and comment signs they come with.
PUBLISHED = (
    ("GPL-3.0", """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,"""),
    ("GPL-2.0", """ * This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version 2
 * of the License, or (at your option) any later version."""),
    ("GPL-2.0", """# it under the terms of the GNU General Public License version 2 as
# published by the Free Software Foundation."""),
    ("LGPL-2.1", """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version."""),
    ("LGPL-3.0", """This library is free software: you can redistribute it and/or modify it under the terms of the
GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""),
    ("AGPL-3.0", """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published
    by the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""),
    ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991"),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007"),
    ("LGPL-2.1", "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999"),
    ("LGPL-3.0", "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007"),
    ("AGPL-3.0", "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007"),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004"),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n=================================="),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
                        "International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under CC BY-NC-ND 4.0. To view a copy of this license, visit "
                        "https://creativecommons.org/licenses/by-nc-nd/4.0/"),
    ("CC-BY-4.0", 'the terms and conditions of this Creative Commons Attribution 4.0 International Public License '
                  '("Public License").'),
    ("CC0-1.0", "To the extent possible under law, the person who associated CC0 with\nthis work has waived all "
                "copyright and related or neighboring\nrights to this work."),
    ("MIT", "// SPDX-License-Identifier: MIT"), ("MIT-0", "// SPDX-License-Identifier: MIT-0"),
    ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */"), ("GPL-3.0", "# SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-2.1", "# SPDX-License-Identifier: LGPL-2.1-or-later"), ("BSD", "# SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"), ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
)


def test_publishers_own_notices_are_found(spark):
    docs = spark.createDataFrame([(i, f"Some words before.\n{t}\nand more after it.") for i, (_, t) in enumerate(PUBLISHED)],
                                 "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in S.scan(docs).collect()}
    assert got == {(i, name) for i, (name, _) in enumerate(PUBLISHED)}


def test_repeated_and_overlapping_notices_equal_the_definition(spark):
    """Notices in a row, cut and mixed, also in several texts under one id: the rows of the SQL without MinHash."""
    rng = random.Random(21)
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            words = rng.choice(S.NOTICES[:36])[1].split()
            cut = rng.randrange(3) == 0
            parts += words[rng.randrange(2) * cut:len(words) - rng.randrange(2) * cut] * rng.randrange(1, 4)
            parts += ["and"] * rng.randrange(3)
        rows.append((i - i % 2 if i > 30 else i, " ".join(parts)))
    rows.append((99, "All rights reserved. Released under the MIT License. " * 60))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = {(i, name, round(c, 9), at) for i, name, c, at in con.execute(S._ORACLE).fetchall()}
    got = S.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r["doc_id"], r["license"], round(r["containment"], 9), r["first_word"]) for r in got} == want
    assert len(want) > 80


def test_a_notice_thousands_of_times_takes_time_in_proportion(spark):
    """A quadratic scan looks at 10^9 pairs of hits here."""
    begin = time.monotonic()
    df = spark.createDataFrame([(1, "All rights reserved. " * 30_000)], "doc_id long, text string")
    assert [tuple(r) for r in S.scan(df).collect()] == [(1, "all-rights-reserved", 1.0, 0)]
    assert time.monotonic() - begin < 60


def test_no_language_is_left_out_of_a_small_sample(spark):
    """More languages than the sample has rows: each has centroids, and its texts find them."""
    rng = random.Random(6)
    rows = []
    for k in range(14):
        letters = [chr(0x0430 + 2 * k + j) for j in range(2)] + [chr(0x05D0 + k), chr(0x0561 + k)]
        for i in range(7):
            words = ["".join(rng.choice(letters) for _ in range(5)) for _ in range(40)]
            rows.append((100 * k + i, " ".join(words), f"l{k}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs, max_sample=5)
    assert set(model.names) == {f"l{k}" for k in range(14)}
    got = L.identify(docs, model).where("lang_pred = lang").count()
    assert got >= 0.95 * len(rows)


def test_all_findings_equal_plain_dynamic_programming():
    """A segment is found in a text exactly if some part of the text is within its edits, with the fewest."""
    rng = random.Random(12)
    items = [(i, "".join(rng.choice("abcde ") for _ in range(n)).strip() or "x" * n) for i, n in enumerate((64, 90, 110, 40))]
    items = [(i, D.normalized(t)) for i, t in items] + [(9, "ab" * 45)]
    index = D.SegmentIndex.build(items, D.SEGMENT, D.Q, D.ERROR)
    texts = ["ab" * 60, "", "-" * 100]
    for _ in range(12):
        t = list(rng.choice(items)[1])
        for _ in range(rng.randrange(9)):
            t[rng.randrange(len(t))] = rng.choice("abcxyz")
        texts.append(D.normalized("qq " * rng.randrange(9) + "".join(t) + " ww" * rng.randrange(9)))
    got = {(t, s): e for t, s, e, _, _ in D.search(index, texts)}
    want = {}
    for t, text in enumerate(texts):
        for s, (chars, n, k) in enumerate(zip(index.chars, index.length, index.budget)):
            d = infix_distance("".join(map(chr, chars[:n])), text)
            if d <= k:
                want[t, s] = d
    assert got == want and len({s for _, s in got}) > 20


def test_repeats_on_both_sides_take_bounded_memory(monkeypatch):
    """Windows of any size find the same; a long run of one character against another is cut into them."""
    items = [(0, "-" * 300), (1, "ab" * 120), (2, D.normalized("one two three four five six seven eight nine ten eleven twelve"))]
    index = D.SegmentIndex.build(items, D.SEGMENT, D.Q, D.ERROR)
    texts = ["-" * 3000, "xx " + "ab" * 700, "say one two three four five six seven eight nine ten eleven twelve yes"]
    want = D.search(index, texts)
    assert {index.item[s] for t, s, *_ in want if t == 0} == {0} and {t for t, s, *_ in want if index.item[s] == 2} == {2}
    pairs = []
    for most in (1, 100, 20_000):
        monkeypatch.setattr(D, "MOST_PAIRS", most)
        plain = D._bands
        monkeypatch.setattr(D, "_bands", lambda i, j, p, w: pairs.append(len(p)) or plain(i, j, p, w))
        assert D.search(index, texts) == want
        monkeypatch.setattr(D, "_bands", plain)
    # one window is about as large as asked for, or two regions' span times the repeats of a gram
    assert max(pairs) <= 20_000 + 2 * 90 * 300
