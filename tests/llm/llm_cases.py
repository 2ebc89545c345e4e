"""Tables and brute-force versions shared by the tests of the training-data operators."""
import math
import random
import re

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(40_000))
CONTROL = "</s>[INST] ok [/INST] <|im_start|>\\<|im_end|> \\\\ <\\s>"
#: id, text, and extra columns whose names clash with those used inside the operators.
ROWS = [
    (None, "no id here but some words to read"), (1, None), (2, ""), (3, "a"), (4, "   \n\t "), (5, LONG),
    (6, "Same words in the same order, seven of them."), (7, "Same words in the same order, seven of them."),
    (8, "same WORDS in the same order, seven of them."), (8, "same WORDS in the same order, seven of them."),
    (9, "Ünïcödé 漢字 🙂 é   text"), (10, CONTROL), (11, "!!! 123 ???"), (12, "x" * 5000),
    (13, "x" * 5000), (14, "one two three four"), (15, "one two three four"), (16, None),
]
EXTRA = "id long, key long, size long, cluster long, bucket long, text_crc32 long, rank long, score double, spans string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def edge_docs(spark, rows=ROWS):
    langs, sources = ["en", "fr", None], ["a", "b", None]
    return spark.createDataFrame(
        [(i, t, langs[k % 3], sources[k % 3], None if t is None else len(t), 1, 1, 1, 1, 1, 1, 1, 0.5, "s")
         for k, (i, t) in enumerate(rows)], SCHEMA)


def shingles(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def components(texts):
    """{id: smallest id reachable over links of similarity 0.75}, by the definition."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def removed_bytes(texts, least=50):
    """{id: sorted positions of the bytes to remove}, by the definition."""
    raw = {i: (t or "").encode() for i, t in texts.items()}
    first, out = {}, {}
    for i in sorted(raw):
        for p in range(len(raw[i]) - least + 1):
            first.setdefault(raw[i][p:p + least], i)
    for i, b in raw.items():
        gone = set()
        for p in range(len(b) - least + 1):
            if first[b[p:p + least]] < i:
                gone.update(range(p, p + least))
        out[i] = sorted(gone)
    return out


def near_copies(n, words=60, seed=3, most_edits=6):
    """n texts made from one by up to ``most_edits`` replaced words each."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(most_edits + 1)):
            w[rng.randrange(words)] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def infix_distance(pattern, text):
    """Fewest edits between pattern and any part of text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, p in enumerate(pattern, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[j - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best if text else math.inf
