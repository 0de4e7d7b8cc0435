import random

import xxhash

from gridtrend.llm import simhash as S

SCHEMA = "doc_id long, text string"
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text, shingle=3):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_TO_Z))
    if not w:
        return 0
    grams = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows, radius=3):
    prints = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    lows = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lows[find(i)] = min(lows.get(find(i), d), d)
    return sorted(((d, S.signed(prints[i]), lows.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def found(df, **options):
    rows = S.near_classes(df, **options).collect()
    return sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in rows), key=str)


def corpus():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcDEFÉ") for _ in range(r.randint(2, 8)))
    base = [word() for _ in range(400)]
    rows = [(i, " ".join(word() for _ in range(r.randint(1, 40)))) for i in range(40)]
    for i in range(60):  # a chain of near copies: every one differs a little from the one before
        base[r.randrange(400)] = word()
        rows.append((1000 - i, " ".join(base)))
    rows += [(50, None), (51, ""), (52, " \t\n"), (53, "One Two"), (54, "one\ttwo"), (55, rows[3][1]), (3, rows[3][1])]
    rows += [(None, rows[5][1]), (None, "nobody else"), (60, "\u0085 a"), (61, "a b c d")]
    return rows


def test_equals_all_pairs(spark, clash):
    rows = corpus()
    df = clash(spark.createDataFrame(rows, SCHEMA), "fp", "id", "n_links", "d")
    want = classes(rows)
    assert found(df) == want
    assert found(df, hot=2) == want  # crowded keys take the finer cut
    assert len({c for _, _, c in want}) < len(rows) - 40


def test_links_of_clustered_fingerprints(spark):
    r = random.Random(1)
    prints = {0, S.signed(S.ONES)}
    for _ in range(6):
        center = r.getrandbits(64)
        for _ in range(40):
            p = center
            for b in r.sample(range(64), r.randint(0, 4)):
                p ^= 1 << b
            prints.add(S.signed(p))
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & S.ONES).bit_count() <= 3}
    for hot in (1_000, 4):
        assert {tuple(x) for x in S.links(df, hot=hot).collect()} == want


def planted():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    passage = [word() for _ in range(30)]
    rows = []
    for g in range(40):
        base = [word() for _ in range(r.randint(60, 300))]
        rows += [(g, " ".join(base))] * r.randint(1, 3)  # repeated rows
        rows += [(100 + 10 * g + k, " ".join(base)) for k in range(r.randint(0, 4))]
        rows += [(100 + 10 * g + 9, " ".join([*base[:-1], word()]))]
    rows += [(1000 + i, " ".join([word() for _ in range(60)] + passage)) for i in range(80)]  # no copies
    base = [word() for _ in range(900)]
    for i in range(60):  # a large group of near copies of one text
        copy = list(base)
        copy[r.randrange(900)] = word()
        rows.append((2000 + i, " ".join(copy)))
    rows += [(5000, " ".join(word() for _ in range(70))) for _ in range(3)]  # one id, three texts
    return rows


def stays(rows, radius=3):
    """The rows that stay, over all pairs: smallest id of each class, null ids last."""
    prints = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row)
    return [sorted(d for d, _ in g if d is not None)[0] if any(d is not None for d, _ in g) else None for g in groups.values()]


def test_one_of_each_class_stays(spark, clash):
    rows = [*corpus(), *planted()]
    df = clash(spark.createDataFrame(rows, SCHEMA), "fp", "component_id", "root", "low", "id", "last")
    kept = S.drop_near_copies(df)
    assert kept.columns == df.columns
    got = [tuple(x)[:2] for x in kept.collect()]
    assert sorted((d for d, _ in got), key=str) == sorted(stays(rows), key=str)
    assert set(got) <= set(rows) and len({plain(t) for _, t in got}) == len(got)
    assert {d for d, _ in got} >= set(range(1000, 1080))
    assert [d for d, _ in got].count(5000) == 3  # three texts under one id are three classes


def test_rows_that_share_an_id_and_repeat(spark):
    rows = [(1, "one two three four", "b"), (1, "one two three four", "a"), (1, "quite another text here", "c"), (2, "x y z", None), (2, "x y z", None)]
    df = spark.createDataFrame(rows, SCHEMA + ", source string")
    got = {tuple(x) for x in S.drop_near_copies(df).collect()}
    again = {tuple(x) for x in S.drop_near_copies(df.repartition(7)).collect()}
    assert got == again and len(got) == 3
    assert {(d, t) for d, t, _ in got} == {(d, t) for d, t, _ in rows}


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert S.drop_near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text():
    text = "word " * 300_000
    assert S.simhash(text.encode()) == S.signed(xxhash.xxh64_intdigest(b"word word word", 42))
