import math
import random
import re

from pyspark.sql import functions as F

from gridtrend.llm import curriculum as C

SCHEMA = "doc_id long, source string, text string"


def targets(sizes, weights=C.WEIGHTS, share=C.SHARE, most=C.MOST):
    """Sharing again by weight what stands above a limit, until nothing does."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= over
    return out


def corpus():
    r = random.Random(2)
    rows = []
    for i, s in enumerate(["b", "a", "Z", "é", None, "a b", "", "c"]):
        for k in range(1 + 7 * i):
            rows.append((100 * i + k, s, "wé " * r.choice([1, 5, 30, 400])))
    rows += [(9000, "b", None), (9001, "b", " \t\n"), (9002, "zz", ""), (None, "a", "one two"), (5, "a", "x y"), (5, "a", "x y")]
    return rows


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_takes(spark, clash):
    rows = corpus()
    df = clash(spark.createDataFrame(rows, SCHEMA), "size", "target", "place", "turn")
    got = C.takes(df).collect()
    assert sorted((r["doc_id"], r["__size"]) for r in got if r["doc_id"] is not None) == sorted(
        (d, size(t)) for d, _, t in rows if d is not None
    )
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        n = sum(t["words"] for t in r["__takes"])
        assert n <= 2 * r["__size"] and r["__source_size"] == sizes[r["source"]]
        assert math.isclose(r["__target"], want[r["source"]], rel_tol=1e-12, abs_tol=1e-9)
        assert all(0 <= t["position"] <= 1 for t in r["__takes"])
        taken[r["source"]] += n
    assert all(want[s] - 1 < taken[s] <= want[s] for s in sizes)
    assert math.isclose(sum(want.values()), 1.5 * sum(sizes.values()))


def test_reruns_and_partitions_agree(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    runs = [
        sorted(map(str, C.takes(x).select("doc_id", "source", "__takes").collect())) for x in (df, df.repartition(7, "text"))
    ]
    assert runs[0] == runs[1]


def test_positions_invert_the_schedule(spark):
    """At position t the integral of the schedule is the part that was asked for."""
    parts = [i / 50 for i in range(51)]
    for place, knots in enumerate(C.SCHEDULES):
        rows = spark.createDataFrame([(p,) for p in parts], "part double")
        at = [r[0] for r in rows.orderBy("part").select(C.position_at(F.col("part"), F.lit(place))).collect()]

        def area(t):
            total = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                end = min(max(t, t0), t1)
                total += (end - t0) * (w0 + w0 + (w1 - w0) * (end - t0) / (t1 - t0)) / 2
            return total

        assert at == sorted(at)
        assert all(math.isclose(area(t) / area(1.0), p, abs_tol=1e-12) for t, p in zip(at, parts))


def test_training_order(spark, clash):
    rows = corpus()
    df = clash(spark.createDataFrame(rows, SCHEMA), "__at")
    takes = C.takes(df).select("doc_id", F.explode("__takes").alias("t")).collect()
    out = C.training_order(df)
    assert out.columns == df.columns
    got = [r["doc_id"] for r in out.collect()]
    assert sorted(map(str, got)) == sorted(str(r["doc_id"]) for r in takes)
    at = {}
    for r in takes:
        at.setdefault(r["doc_id"], []).append(r["t"]["position"])
    one = [d for d in got if len(at[d]) == 1]
    assert [at[d][0] for d in one] == sorted(at[d][0] for d in one)


def test_empty_and_wordless(spark):
    assert C.takes(spark.createDataFrame([], SCHEMA)).collect() == []
    got = C.takes(spark.createDataFrame([(1, "a", None), (2, None, "")], SCHEMA)).collect()
    assert [(r["__size"], r["__target"], r["__takes"]) for r in got] == [(0, 0.0, [])] * 2
