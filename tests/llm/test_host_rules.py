import random
import re
from collections import Counter

from gridtrend.llm import host_rules as H

SCHEMA = "doc_id long, source string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in H.SYMBOLS for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 9)))
    good = lambda: " ".join(word() for _ in range(r.randint(50, 120)))
    rows = [(i, f"good{i % 4}", good()) for i in range(80)]
    rows += [(100 + i, "bad", "too short") for i in range(30)] + [(130 + i, "bad", good()) for i in range(3)]
    rows += [(140, "once", "one short document")]
    rows += [(150, "good1", "a b c " * 40), (151, "good1", "a a a a"), (152, "good1", "x y z w x y z" + " q" * 60)]
    rows += [(153, "good2", "l one\nl one\n\n \nl two\nl one" + "\nw" * 50), (154, None, good()), (155, None, "short")]
    rows += [(156, "good0", None), (157, "good0", ""), (None, "good0", good()), (158, "good3", "### && <b> " + good())]
    rows += [(159, "good3", "   "), (160, "good0", rows[0][2]), (160, "good0", rows[0][2]), (161, "good0", "w " * 30_000)]
    return rows


def test_measures_and_verdicts(spark, clash):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = H.verdicts(H.measured(df)).collect()
    want = [(d, s, *measures(t)) for d, s, t in rows]
    assert sorted((tuple(r[c] for c in ("doc_id", "source", *H.MEASURES)) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and r["source"] != "bad")
    clashing = clash(df, "n_words", "kept", "base_failed", "short")
    kept = H.keep_good(clashing)
    assert kept.columns == clashing.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert {r["n_words"] for r in kept.collect()} == {"own"}


def test_shrinkage(spark):
    """Rates move towards the mean by the moments' prior, small hosts more."""
    n = {"a": (40, 4), "b": (40, 30), "c": (2, 2), "d": (10, 0)}
    rows = [(h, int(i < x)) for h, (k, x) in n.items() for i in range(k)]
    flags = spark.createDataFrame(rows, "source string, short int")
    for r in H.RULES[1:]:
        flags = flags.selectExpr("*", f"0 AS {r}")
    got = {r["source"]: r for r in H.shrunk_rates(flags).collect()}
    total, fails = sum(k for k, _ in n.values()), sum(x for _, x in n.values())
    m = fails / total
    over = sum(k * (x / k - m) ** 2 for k, x in n.values()) - (len(n) - 1) * m * (1 - m)
    strength = m * (1 - m) / (over / (total - sum(k * k for k, _ in n.values()) / total)) - 1
    for h, (k, x) in n.items():
        assert abs(got[h]["short"] - (x + m * strength) / (k + strength)) < 1e-12
        assert got[h]["repeats"] == 0
    assert m < got["c"]["short"] < 1


def test_empty_and_single_host(spark):
    assert H.verdicts(H.measured(spark.createDataFrame([], SCHEMA))).collect() == []
    one = H.verdicts(H.measured(spark.createDataFrame([(1, "h", "w%d " * 3 + "a b c d e f g h i j " * 6)], SCHEMA))).collect()
    assert len(one) == 1
    assert H.keep_good(spark.createDataFrame([(1, None, None)], SCHEMA)).collect() == []


def test_no_python_on_the_path(spark):
    plan = H.measured(spark.createDataFrame([(1, "h", "a")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
