import hashlib
import random

import numpy as np
import pytest

from gridtrend.llm import suffix_dedup, suffixes

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    key = lambda d: suffix_dedup.NO_ID if d is None else d
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            least[s] = min(least.get(s, key(d)), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < key(d):
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **options):
    rows = suffix_dedup.remove_repeats(df, **options).collect()
    for r in rows:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] == r["n_bytes"] - len(r["kept"])
    return sorted(
        ((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows),
        key=str,
    )


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, short = prose(20), prose(8)[:49]
    rows = [(i, prose(r.randint(1, 60))) for i in range(40)]
    rows += [(100 + i, prose(5) + " " + passage + " " + prose(5)) for i in range(30)]  # a hot passage
    rows += [(200 + i, prose(5) + short + prose(5)) for i in range(10)]  # too short to count
    rows += [(300 + i, rows[3][1]) for i in range(5)] + [(2, rows[3][1])]  # copies, one with a smaller id
    rows += [(400, "a" * 300), (401, "b" + "a" * 120), (402, "ab" * 100)]  # ties: periodic texts
    rows += [(500, None), (501, ""), (None, passage), (None, passage + prose(9)), (502, "x" * 49), (503, "x" * 49)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (504, (passage + " ") * 40)]  # repeated rows, repeated ids
    return rows


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 2_000, "hot": 3}, {"length": 30, "hot": 5}])
def test_equals_brute_force(spark, clash, options):
    rows = corpus()
    df = clash(spark.createDataFrame(rows, SCHEMA), "chunk", "doc", "digest", "body", "id")
    assert found(df, **options) == brute(rows, options.get("length", 50))


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert found(df) == brute([tuple(r) for r in df.collect()], 50)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_suffix_sort_with_colliding_hashes(monkeypatch):
    r = np.random.default_rng(1)
    text = np.concatenate([r.integers(97, 99, 4000).astype(np.uint8), np.zeros(suffixes.PAD, np.uint8)])
    at, group = np.arange(3900), np.arange(3900) % 3
    for prime in (suffixes.PRIME, 7):  # modulo 7 nearly everything collides
        monkeypatch.setattr(suffixes, "PRIME", prime)
        order, same = suffixes.suffix_sort(text, at, group.astype(np.uint64), 12)
        keys = [(int(group[i]), text[i : i + 12].tobytes()) for i in order]
        assert keys == sorted(keys)
        assert same.tolist() == [False, *(a == b for a, b in zip(keys, keys[1:]))]


def test_tiles_give_the_same_anchors(monkeypatch):
    r = np.random.default_rng(2)
    text = np.concatenate([r.integers(97, 100, 9000).astype(np.uint8), np.zeros(4096, np.uint8)])
    ends = np.array([40, 4000, 4000, 4049, 4100, 9000])
    whole = suffixes.runs(text, ends, 50)
    windows = {p: int(a) for f, n, a, _ in zip(*whole) for p in range(f, f + n)}
    starts = [p for s, e in zip([0, *ends[:-1]], ends) for p in range(s, e - 49)]
    assert sorted(windows) == starts
    monkeypatch.setattr(suffixes, "TILE", 777)
    again = suffixes.runs(text, ends, 50)
    assert windows == {p: int(a) for f, n, a, _ in zip(*again) for p in range(f, f + n)}


def test_suffixes_compare_by_pieces():
    r = np.random.default_rng(4)
    text = np.concatenate([np.tile(r.integers(97, 99, 700).astype(np.uint8), 3), np.zeros(suffixes.PAD, np.uint8)])
    text[r.integers(0, 2100, 20)] = 200
    s, t = r.integers(0, 2000, (2, 4000))
    s[:1000] = t[:1000] % 700 + 700  # many pairs with long common beginnings
    for length in (1, 7, 12, 50, 64):
        a, b = ([text[i : i + length].tobytes() for i in x] for x in (s, t))
        sign = suffixes.Pieces(text, length).compare(s, t)
        assert sign.tolist() == [(x > y) - (x < y) for x, y in zip(a, b)]


def sort_input(seed, length):
    """Periodic text with planted changes: groups of equal, nearly equal and other suffixes."""
    r = np.random.default_rng(seed)
    text = np.concatenate([np.tile(r.integers(97, 99, 900).astype(np.uint8), 4), np.zeros(suffixes.PAD, np.uint8)])
    text[r.integers(0, 3600, 40)] = 200
    at = r.permutation(3600 - length)
    return text, at, (at % 7).astype(np.uint64)


def check_sorted(text, at, group, length):
    order, same = suffixes.suffix_sort(text, at, group, length)
    keys = [(int(group[i]), text[at[i] : at[i] + length].tobytes()) for i in order]
    assert sorted(order.tolist()) == list(range(len(at)))
    assert keys == sorted(keys)
    assert same.tolist() == [False, *(a == b for a, b in zip(keys, keys[1:]))]


@pytest.mark.parametrize("length", [1, 7, 8, 12, 50, 64, 200])
def test_suffixes_are_sorted_word_by_word(monkeypatch, length):
    # Hashing every substring of the text cost most of the CPU time of op1.
    monkeypatch.setattr(suffixes, "Pieces", None)
    text, at, group = sort_input(5, length)
    check_sorted(text, at, group, length)
    check_sorted(text, at, group + np.uint64(1 << 63), length)  # keys that leave no bits for places


@pytest.mark.parametrize("prime", [suffixes.PRIME, 7])
def test_long_suffixes_are_sorted_by_pieces(monkeypatch, prime):
    monkeypatch.setattr(suffixes, "SPELT", 30)
    monkeypatch.setattr(suffixes, "PRIME", prime)
    for length in (31, 64, 200):
        check_sorted(*sort_input(6, length), length)


def test_sort_of_nothing():
    order, same = suffixes.suffix_sort(np.zeros(suffixes.PAD, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.uint64), 50)
    assert len(order) == len(same) == 0


def test_long_strings_equal_brute_force(spark, monkeypatch):
    r = random.Random(8)
    base = "".join(r.choice("abcd ") for _ in range(900))
    rows = [(i, base[r.randint(0, 400) :] + "".join(r.choice("xyz") for _ in range(i))) for i in range(30)]
    assert found(spark.createDataFrame(rows, SCHEMA), length=200, chunk_bytes=4_000, hot=3) == brute(rows, 200)


def test_a_large_group_of_copies_is_told_once_to_a_chunk(spark, monkeypatch):
    kept = []
    keep = suffix_dedup.keep
    monkeypatch.setattr(suffix_dedup, "keep", lambda df: kept.append(keep(df)) or kept[-1])
    text = "a text of which there are many copies, longer than fifty bytes"
    rows = [(i, text) for i in range(300)] + [(-1, "x" + text), (None, text)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows, 50)
    assert kept[1].filter("kind = 'copy'").count() == 1
