"""URL rules, hard negatives and the prefix trie against brute force, and their edge tables."""
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from learnlog.llm import hardneg, prefixtrie, urlfilter
from learnlog.llm.urlfilter import Automaton, Rule


# ---- URL rules

def _glob(text, star):
    out, at = "", 0
    while at < len(text):
        c = text[at]
        if c == "\\" and at + 1 < len(text):
            at += 1
            out += re.escape(text[at])
        else:
            out += {"*": f"{star}*", "?": star}.get(c, re.escape(c))
        at += 1
    return out


def winning_rule(rules, host, path):
    fits = []
    for i, r in enumerate(rules):
        h, _, t = r.pattern.partition("/")
        if re.fullmatch(r"(?:[^/]*\.)?" + _glob(h.lower(), "[^/]"), host, re.S) and (
                "/" not in r.pattern or re.match(_glob("/" + t, "(?:.|\n)"), path, re.S)):
            fits.append((-len(r.pattern), -len(h), i, r.pattern))
    return min(fits)[3] if fits else None


@pytest.mark.parametrize("seed", range(4))
def test_automaton_against_regular_expressions(seed):
    rng = random.Random(seed)
    for _ in range(60):
        rules = []
        for _ in range(rng.randrange(0, 40)):
            host = "".join(rng.choice("ab.*?éA") for _ in range(rng.randrange(0, 5)))
            rest = "".join(rng.choice("ab/*?é") for _ in range(rng.randrange(0, 5)))
            rules.append(Rule(host + ("/" + rest if rng.random() < 0.9 else ""), rng.choice(["allow", "block"])))
        urls = [("".join(rng.choice("ab.é") for _ in range(rng.randrange(0, 7))),
                 rng.choice(["", "/" + "".join(rng.choice("ab/é") for _ in range(rng.randrange(0, 7)))]))
                for _ in range(50)]
        raw = [("." + h + p).encode() for h, p in urls]
        a = Automaton.build(rules)
        got = a.match(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
        for (h, p), k in zip(urls, got):
            assert (a.rules[k].pattern if k >= 0 else None) == winning_rule(rules, h, p)


def test_many_rules_cross_words_and_a_rule_list_has_a_bound():
    rules = [Rule(f"site{i}.example.com/p{i}/", "block" if i % 2 else "allow") for i in range(300)]
    a = Automaton.build(rules)
    assert len(a.first) > 64
    raw = [f".www.site{i}.example.com/p{i}/x".encode() for i in range(300)] + [b".site3.example.com/p4/"]
    got = a.match(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    assert [a.rules[k].pattern for k in got[:-1]] == [r.pattern for r in rules] and got[-1] == -1
    with pytest.raises(ValueError):
        Automaton.build([Rule("a" * 2_000_000 + "/", "block")])


URLS = [(1, None), (2, ""), (3, "no scheme/net/"), (4, "http://NET/"), (5, "https://a.B.Net/x?y=/z#w"),
        (6, "http://example.net/en/"), (7, "http://example.net/en"), (8, "http://xexample.net/en/1"),
        (9, "http://m.example.com/de/?q"), (10, "http://example.com?/de/"), (11, "http://a.org/fr/#/"),
        (12, "http://a.org:80/fr/"), (13, "http://u@example.net/en/1"), (14, "x://y://z.net/a"),
        (15, "http://evil.com/x.net/"), (15, "http://evil.com/x.net/"), (None, "http://é.net/漢?"),
        (16, "http://" + "a." * 30_000 + "net/" + "b" * 70_000), (17, "://"), (18, "http://net"), (19, "http://a\n.net/\n")]


def test_urls_edge_table(spark):
    schema = "page_id long, url string, html string, id long, host string, text string, rule string"
    pages = spark.createDataFrame([(i, u, "h", 1, "x.net", "t", "r") for i, u in URLS], schema)
    got = urlfilter.judge(pages).collect()
    want = []
    for i, u in URLS:
        after = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", after).group().translate({c: c + 32 for c in range(65, 91)})
        path = re.match(r"[^?#]*", after[len(re.match(r"[^/?#]*", after).group()):]).group()
        rule = winning_rule(urlfilter.RULES, host, path)
        want.append((i, host, path, rule, {r.pattern: r.verdict for r in urlfilter.RULES}.get(rule, "allow")))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r[0]: r[3] for r in want}[7] == "net/" and {r[0]: r[3] for r in want}[18] is None
    empty = urlfilter.judge(pages.where("false"))
    assert empty.columns == ["page_id", "host", "path", "rule", "verdict"] and empty.count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages, [], default="block").collect()} == {"block"}


# ---- hard negatives

def mined(rows, anchor, positives=5, negatives=5, low=80, high=100):
    """By the definition; rows: (id, label, vector)."""
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (label, [np.float32(x) for x in v])
        best[i] = min(best.get(i, key), key)
    q = {i: (label, [math.floor(256 * float(x)) for x in v]) for i, (label, v) in best.items()}
    out = []
    for a in sorted(filter(anchor, q)):
        score = {i: sum(x * y for x, y in zip(q[a][1], q[i][1])) for i in q if i != a}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if q[i][0] == q[a][0]][:positives]:
            fit = [i for i in ranked if q[i][0] != q[a][0] and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, n, i, score[p], score[i]) for n, i in enumerate(fit[:negatives], 1)]
    return sorted(out)


def _vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, id long, score double, block int, windows string"
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, 0.5, 2, "w")
                                  for i, label, v in rows], schema)


def _mine(spark, rows, **kw):
    df = hardneg.hard_negatives(_vectors(spark, rows), F.col("vec_id") % 10 == 0, **kw)
    return sorted(map(tuple, df.collect()))


def test_hard_negatives_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), [np.float32(rng.gauss(0.2, 0.3)) for _ in range(6)]) for i in range(400)]
    # a common vector: many equal scores
    rows += [(i, rng.randrange(3), rows[7][2]) for i in range(400, 700)]
    anchor = lambda i: i % 10 == 0
    assert _mine(spark, rows) == mined(rows, anchor)
    assert _mine(spark, rows, positives=2, negatives=9, low=50, high=95) == mined(rows, anchor, 2, 9, 50, 95)


def test_hard_negatives_edge_table(spark):
    big = [float(np.float32(3e30))] * 3
    rows = [(0, 1, [0.5, 0.5]), (10, 1, [0.5, 0.5]), (20, None, [0.5, 0.5]), (30, 1, None), (None, 1, [0.5, 0.5]),
            (40, 1, [0.5, None]), (50, 1, [float("nan"), 0.5]), (60, 1, [float("inf"), 0.5]), (1, 2, [0.5, 0.5]),
            (2, 2, [0.45, 0.5]), (2, 2, [0.45, 0.5]), (3, 2, [0.45, 0.5]), (3, 0, [0.4, 0.5]), (4, 2, []), (5, 1, []),
            (6, 2, [0.5, 0.5, 0.5]), (70, 9, [1.0]), (80, 3, [-0.5, 0.5]), (7, 3, [0.5, -0.5])]
    anchor = lambda i: i % 10 == 0
    got = _mine(spark, rows)
    assert got == mined(rows, anchor) and got
    assert _mine(spark, rows[:1]) == [] and _mine(spark, []) == []
    # scores beyond 64 bits are the largest of them
    huge = [(0, 1, big), (1, 1, big), (2, 2, [x * 0.9 for x in big]), (3, 2, [0.0] * 3)]
    assert [(r[1], r[3], r[4]) for r in _mine(spark, huge)] == [(1, 2, (1 << 63) - 1)]
    wide = [(0, 1, [2.0 ** 20, 0.25]), (1, 1, [2.0 ** 20, 0.25]), (2, 2, [2.0 ** 20, 0.125]), (3, 2, [2.0 ** 20, 0.0])]
    assert _mine(spark, wide) == mined(wide, anchor)
    with pytest.raises(ValueError):
        _mine(spark, rows, high=101)


# ---- prefix trie

def trie(convs):
    """By the definition; convs: {id: [(key, chars)]}."""
    members, ends, size = {}, {}, {}
    for c, s in convs.items():
        for d in range(len(s) + 1):
            key = tuple(k for k, _ in s[:d])
            members.setdefault(key, []).append(c)
            size[key] = s[d - 1][1] if d else 0
        ends.setdefault(tuple(k for k, _ in s), []).append(c)
    out = []
    for key, m in members.items():
        below = [k for k in members if k[:len(key)] == key]
        children = {k for k in below if len(k) == len(key) + 1}
        leaves = sum(not any(x[:len(k)] == k and len(x) == len(k) + 1 for x in below) for k in below)
        out.append((min(m), len(key), min(members[key[:-1]]) if key else None, len(m), len(children), leaves,
                    sum((len(members[k]) - 1) * size[k] for k in below),
                    hashlib.sha256(",".join(map(str, sorted(ends.get(key, [])))).encode()).hexdigest()))
    return sorted(out, key=repr)


def _trie_rows(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def _turns(spark, rows):
    schema = "conv_id long, turn long, role string, text string, key string, conv long, shard int, kind int, ends string"
    return spark.createDataFrame([(*r, "k", 1, 2, 3, "e") for r in rows], schema)


@pytest.mark.parametrize("limits", [{}, {"shard_sequences": 3, "shard_turns": 10}, {"shard_sequences": 1}])
def test_trie_against_brute_force_with_any_shards(spark, limits):
    rng = random.Random(11)
    convs = {}
    for c in range(300):
        convs[c * 7 - 300] = [(rng.choice("ab"), rng.choice(["x", "yy", "é漢"]))
                              for _ in range(rng.choice([1, 2, 3, 4, 12]))] if c % 3 else [("a", "x")] * (c % 5 + 1)
    turns = [(c, t, r, x) for c, s in convs.items() for t, (r, x) in enumerate(s)]
    rng.shuffle(turns)
    got = prefixtrie.prefix_trie(prefixtrie.sequences(_turns(spark, turns)), **limits)
    assert _trie_rows(got) == trie({c: [((r, x), len(x)) for r, x in s] for c, s in convs.items()})


def test_trie_edge_table(spark):
    long = "w " * 100_000
    rows = [(1, 0, "user", "hi"), (1, 1, None, None), (2, None, "user", "hi"), (2, 5, "", ""), (None, 0, "user", "hi"),
            (3, 0, "user", long), (3, 1, "user", long), (4, 0, "userh", "i"), (5, 0, "user", "hi"), (5, 0, "user", "hi")]
    rows += [(6, t, "user", "hi") for t in range(3000)]  # one long conversation
    want = {1: ["hi", ""], 2: ["hi", ""], 3: [long, long], 4: [("userh", "i")], 5: ["hi", "hi"], 6: ["hi"] * 3000}
    full = {c: [(x if isinstance(x, tuple) else ("user" if x else "", x)) for x in s] for c, s in want.items()}
    short = {c: s[:40] for c, s in full.items()}
    turns = _turns(spark, rows)
    some = _trie_rows(prefixtrie.conversation_trie(turns.where("conv_id <> 6 OR turn < 40 OR conv_id IS NULL")))
    assert some == trie({c: [(k, len(k[1])) for k in s] for c, s in short.items()})
    whole = {r[1]: r for r in _trie_rows(prefixtrie.conversation_trie(turns)) if r[0] == 6}
    assert max(whole) == 3000 and all(whole[d][5] == 1 and whole[d][6] == 0 for d in range(4, 3001))
    assert _trie_rows(prefixtrie.conversation_trie(turns.where("false"))) == []


def test_rebuilt_conversations(spark):
    rng = random.Random(2)
    own = {c: [f"{c}-{t}" for t in range(rng.randrange(1, 9))] for c in [*range(100, 140), *range(205, 230), 0, 7]}
    turns = [(c, t, "user", x) for c, s in own.items() for t, x in enumerate(s)]
    want = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = [*own.get(c - c % 100, [])[:h], *s[h:]]
    assert any(not s for s in want.values())
    got = prefixtrie.prefix_trie(prefixtrie.rebuilt(prefixtrie.sequences(_turns(spark, turns))))
    assert _trie_rows(got) == trie({c: [(x, len(x)) for x in s] for c, s in want.items()})


def test_members_of_one_node_spread_over_pieces(spark):
    convs = spark.range(30_000).select(F.col("id").alias("conv"), F.lit(b"k" * 16).alias("key"))
    got = prefixtrie._hashed_ends(convs).collect()
    assert len(got) == 1
    assert got[0]["ends"] == hashlib.sha256(",".join(map(str, range(30_000))).encode()).hexdigest()
