import random

import numpy as np

from gridtrend.llm import decontaminate as D

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))


def planted():
    r = random.Random(5)
    items = [(i, prose(r, 15 + i)) for i in range(30)]
    docs, want = [], set()
    for i, t in items:
        w = t.split()
        docs.append((i, prose(r, 80) + " " + t + "%%% " + prose(r, 30)))
        want.add((i, i))
        near = [*w[: len(w) - 1], "changed"]  # one shingle of at least eleven differs
        docs.append((100 + i, prose(r, 3) + " " + " ".join(near) + " " + prose(r, 30)))
        want.add((100 + i, i))
        docs.append((200 + i, prose(r, 100) + " ".join(w[:6]) + prose(r, 50)))  # six words are no leak
        docs.append((300 + i, t.upper().replace(" ", ",\n")))
        want.add((300 + i, i))
    docs += [(900, None), (901, ""), (902, "... !!"), (903, items[4][1]), (903, items[4][1]), (904, "z " * 40_000)]
    items += [(50, None), (51, ""), (52, items[4][1]), (None, "zz yy xx")]
    want |= {(d, 52) for d, i in want if i == 4} | {(903, 4), (903, 52)}
    return docs, items, want


def test_planted_leaks(spark, clash):
    docs, items, want = planted()
    df = clash(spark.createDataFrame(docs, DOCS), "match", "item_id")
    bench = spark.createDataFrame(items, ITEMS)
    for size in (D.BLOCK_BYTES, 300):  # one block, many blocks
        found = D.contamination(df.drop("match", "item_id"), bench, block_bytes=size)
        rows = found.select("doc_id", "match.*").collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == want
        assert sum(r["doc_id"] == 903 for r in rows) == 4
        assert all(r["similarity"] >= 0.8 and r["distance"] <= D.RADIUS for r in rows)
    clean = D.drop_contaminated(df, bench)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_equals_all_windows(spark):
    """Against every window of every item's length, without index or anchors."""
    docs, items, _ = planted()
    items = [x for x in items if x[1]]
    index = D.Index(items)
    for _, text in docs[:24]:
        words, best = D.tokens(text), {}
        for n, (item, _) in enumerate(items):
            k = len(index.words[n])
            for at in range(max(1, len(words) - k + 1)):
                counts = D.shingles(words[at : at + k])
                s = D.similarity(counts, index.counts[n]) if counts else 0
                near = counts and (D.weighted_simhash(counts) ^ int(index.prints[n])).bit_count() <= D.RADIUS
                if s >= D.SIMILARITY and near:
                    best[item] = max(best.get(item, 0), s)
        assert {m["item_id"]: m["similarity"] for m in index.matches(text)} == best


def test_index_finds_all_within_radius():
    r = np.random.default_rng(0)
    index = D.Index([(i, prose(random.Random(i), 20)) for i in range(50)])
    for p in index.prints.tolist():
        for flips in (0, 7, D.RADIUS):
            q = p
            for b in r.choice(64, flips, replace=False).tolist():
                q ^= 1 << b
            want = {n for n, x in enumerate(index.prints.tolist()) if (x ^ q).bit_count() <= D.RADIUS}
            assert {n for n, _ in index.within(q)} == want


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b c d e f")], DOCS)
    assert D.contamination(docs, spark.createDataFrame([(1, "a b c d e f")], ITEMS)).collect() == []
    assert D.contamination(some, items).collect() == []
    assert D.drop_contaminated(some, items).count() == 1
