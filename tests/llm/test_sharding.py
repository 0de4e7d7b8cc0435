import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridtrend.llm import sharding as S

SCHEMA = "doc_id long, text string"


def laws(rows, got, shards, spread):
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(
        ((d, size(t), crc(t)) for d, t in rows), key=str
    )
    slots, loads = defaultdict(list), Counter(dict.fromkeys(range(shards), 0))
    for r in got:
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(slots) <= set(range(shards))
    assert max(loads.values()) - min(loads.values()) <= spread
    return loads


def corpus(n=3000):
    r = random.Random(8)
    text = lambda: "".join(r.choice("abcdefgh é") for _ in range(r.choice([3, 40, 200, 900])))
    rows = [(i, text()) for i in range(n)]
    for g in range(100):
        t = text()
        rows += [(10_000 + 10 * g + k, t) for k in range(r.randint(2, 6))]
    rows += [(20_000 + i, rows[0][1] * 3) for i in range(n // 2)]  # a third of all rows are copies
    rows += [(1, None), (2, None), (3, ""), (None, "x"), (None, "x"), (5, rows[5][1])]
    return rows


def test_sizes_are_even_and_copies_together(spark, clash):
    rows = corpus()
    df = clash(spark.createDataFrame(rows, SCHEMA), "size", "shard", "rid", "group", "key", "to")
    got = S.sharded(df).collect()
    mean = sum(r["size"] for r in got) / 16
    laws(rows, got, 16, 0.01 * mean)
    where = defaultdict(set)
    for r in got:
        if r["doc_id"] and 10_000 <= r["doc_id"] < 20_000:
            where[r["text"]].add(r["shard"])
    together = sum(len(x) == 1 for x in where.values())
    assert together >= 0.8 * len(where)  # by chance, hardly any would be
    hot = Counter(r["shard"] for r in got if r["doc_id"] and r["doc_id"] >= 20_000)
    assert sum(n for _, n in hot.most_common(8)) >= 0.6 * sum(hot.values())


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_whole_table_and_heavy_documents(spark, shards):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    got = S.sharded(df, shards).collect()
    largest = max(len(t.encode()) + 1 for _, t in rows)
    mean = sum(r["size"] for r in got) / shards
    laws(rows, got, shards, max(0.05 * mean, largest - mean + 0.1 * mean))


def test_few_rows(spark):
    assert S.sharded(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a"), (1, "a"), (2, "b" * 99)]
    laws(rows, S.sharded(spark.createDataFrame(rows, SCHEMA)).collect(), 16, 100)


def test_quotas_and_placing():
    where, loads = S.place_heavy([(9, 1), (7, 2), (5, 3), (5, 4)], 3)
    assert sorted(loads) == [7, 9, 10] and len(where) == 4
    q = S.quotas(30, loads)
    assert abs(sum(q) - 4) < 1e-9
    assert S.quotas(30, [20, 2, 2]) == [0.0, 3.0, 3.0]


def hot(n=4000, copies=2000):
    """Single texts, and a group of equal ones with about a third of all bytes."""
    r = random.Random(3)
    text = lambda: "".join(r.choice("abcdefgh ") for _ in range(60))
    same = text()
    return [(i, text()) for i in range(n)] + [(10_000 + i, same) for i in range(copies)]


def test_a_large_group_fills_one_shard_after_the_other(spark):
    rows = hot()
    got = S.sharded(spark.createDataFrame(rows, SCHEMA)).collect()
    laws(rows, got, 16, 0.01 * sum(r["size"] for r in got) / 16 + 70)
    on = Counter(r["shard"] for r in got if r["doc_id"] >= 10_000)
    assert len(on) <= 7


def test_reruns_and_partitions_agree(spark):
    rows = corpus(400) + [(7, "twice"), (7, "twice"), (None, None), (None, None)]
    df = spark.createDataFrame([(*x, str(i % 3)) for i, x in enumerate(rows)], SCHEMA + ", source string")
    seen = [sorted(map(str, S.sharded(d).collect())) for d in (df, df, df.repartition(7), df.orderBy(F.desc("doc_id")))]
    assert all(s == seen[0] for s in seen[1:])


def test_cut_share(spark):
    """Brute force over the result, and far below what chance would cut."""
    rows = corpus(1500)
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "__rid long, " + SCHEMA)
    measures = S.keep(S.measured(df))
    placed = S.keep(S.assign(measures))
    where = defaultdict(Counter)
    for r in placed.collect():
        where[rows[r["rid"]][1] or ""][r["shard"]] += 1
    groups = [c for c in where.values() if sum(c.values()) > 1]
    want = sum(sum(c.values()) - max(c.values()) for c in groups) / sum(sum(c.values()) for c in groups)
    small = [c for c in groups if sum(c.values()) <= 6]
    assert abs(S.cut_share(measures, placed) - want) < 1e-12
    assert sum(sum(c.values()) - max(c.values()) for c in small) < 0.2 * sum(sum(c.values()) for c in small)  # by chance about 0.7
    assert S.cut_share(measures.limit(0), placed) is None
