import math
import random
import re

import numpy as np

from gridtrend.llm import ranked_search as R

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))


def plain(docs, items, k=10):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n, whole = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for i, text in dict.fromkeys(items):
        scored = []
        for d, t in held:
            m = 100 - 75 + (75 * len(t) * n) // whole
            score = 0
            for x in terms(text):
                tf = t.count(x)
                if tf:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1)))
                    score += w * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, j, d, -s) for j, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    docs, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    return sorted((tuple(r) for r in R.ranked(docs, items, **options).collect()), key=str)


def corpus(n=400):
    r = random.Random(8)
    common = ["the", "of", "Ñandú", "a1", "É", "x_y"]
    rare = ["".join(r.choice("abcdeñ") for _ in range(r.randint(2, 5))) for _ in range(300)]
    line = lambda m: " ".join(r.choice(common if r.random() < 0.5 else rare) for _ in range(m))
    docs = [(i, line(r.randint(1, 80))) for i in range(n)]
    docs += [(900 + i, docs[7][1]) for i in range(25)]  # ties
    docs += [(3, docs[3][1]), (3, "the THE of"), (None, docs[9][1]), (None, docs[9][1])]
    docs += [(950, None), (951, ""), (952, " .,;\x7f\x00"), (953, "the " * 3000 + line(2000)), (954, "TIEİK"), (955, "a-b_c")]
    items = [(i, line(r.randint(1, 40))) for i in range(25)]
    items += [(30, docs[7][1]), (31, docs[9][1]), (32, "the the the The of"), (33, None), (34, ""), (35, "nowhere"), (None, "the É")]
    items += [items[0], (0, line(5)), (36, "tieİK"), (37, "a b c")]
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = corpus()
    want = plain(docs, items)
    assert found(spark, docs, items) == want and len(want) > 200
    monkeypatch.setattr(R, "BLOCK_DOCS", 50)
    monkeypatch.setattr(R, "WINDOW", 8)
    monkeypatch.setattr(R, "SHORT", 4)
    monkeypatch.setattr(R, "PIECE", 64)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, k=3) == plain(docs, items, 3)


def test_items_in_several_passes(spark, monkeypatch):
    docs, items = corpus(80)
    monkeypatch.setattr(R, "ITEM_BYTES", 700)
    assert found(spark, docs, items) == plain(docs, items)


def test_windows_and_lists_are_skipped(monkeypatch):
    """A list below the score to beat is only sought in: fewer documents get a score."""
    r = np.random.default_rng(1)
    number = {b"often": 0, b"rare": 1, b"mid": 2}
    docs = [["often"] + ["mid"] * (r.random() < 0.4) + ["rare"] * (i % 97 == 0) for i in range(5000)]
    parts = [], [], [], [], [], []
    for i, d in enumerate(docs):
        for t in set(d):
            parts[3].append(number[t.encode()])
            parts[4].append(i)
            parts[5].append(1)
        parts[0].append(i)
        parts[1].append(True)
        parts[2].append(len(d))
    block = R.Block(R._block(number, *parts), 5000, sum(map(len, docs)))
    touched = []
    real = R.Block._window

    def watched(self, k, lists, upto, cuts, best):
        touched.append(int(np.searchsorted(upto, best.beat)))
        return real(self, k, lists, upto, cuts, best)

    monkeypatch.setattr(R.Block, "_window", watched)
    best = R.Best(5)
    block.search([(0, 1), (1, 4000), (2, 50)], best)
    assert touched[0] == 0 and touched[-1] == 2  # only the accumulators of the rare term name candidates
    assert [d for _, _, d in best.rows] == sorted(d for _, _, d in best.rows) and len(best.rows) == 5


def test_clashing_names_and_empty_tables(spark, clash):
    docs, items = corpus(30)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    extra = R.ranked(clash(d, "item_id", "score", "terms", "ids"), clash(i, "doc_id", "item", "rank", "term"))
    assert sorted((tuple(x) for x in extra.collect()), key=str) == plain(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []


def test_very_long_text():
    text = "Word, " * 1_000_000 + "énd"
    assert R.counted(text) == {b"word": 1_000_000, "énd".encode(): 1}
