"""The pipeline and the registered queries on the smallest tables, against brute force."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import compare  # noqa: E402
import corpus_pipeline  # noqa: E402
from test_curriculum import size, targets  # noqa: E402
from test_host_rules import measures  # noqa: E402
from test_sharding import laws  # noqa: E402
from test_simhash import stays  # noqa: E402

import __spark_entry__  # noqa: E402
from gridtrend.llm import decontaminate, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append([r.asDict() for r in docs.collect()])
        assert docs.columns[: len(columns)] == columns
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]

    def ids(rs):
        return sorted(r["doc_id"] for r in rs)

    good = []
    for r in rows:
        n, _, _, _, repeated = measures(r["text"])
        if n >= 50 and 100 * repeated <= 50 * n:
            good.append(r)
    assert ids(kept[0]) == ids(good)
    assert ids(kept[1]) == sorted(stays([(r["doc_id"], r["text"]) for r in good]))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    index = decontaminate.Index(items)
    clean = [r for r in kept[1] if not index.matches(r["text"])]
    assert ids(kept[2]) == ids(clean) and len(clean) < len(kept[1])
    sizes = {}
    for r in clean:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    want, text = targets(sizes), {r["doc_id"]: r for r in clean}
    for s in sizes:
        taken = [r for r in kept[3] if r["source"] == s]
        whole = sum(size(r["text"]) for r in taken)
        last = max(size(r["text"]) for r in clean if r["source"] == s)
        assert want[s] - 1 < whole < want[s] + last  # the last document is whole
    assert all(text[r["doc_id"]] == r for r in kept[3])
    laws([(r["doc_id"], r["text"]) for r in kept[3]], kept[4], 16, max(len(r["text"].encode()) for r in kept[3]))


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "text", "shard", "slot"} <= set(out.columns)


def test_registration():
    found = __spark_entry__.queries()
    assert "pipeline" in found
    for n in range(1, 14):
        assert len([q for q in found if q.startswith(f"op{n}_")]) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(found)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, monkeypatch, name):
    monkeypatch.setitem(compare.QUERIES, name, queries.QUERIES[name])
    monkeypatch.setitem(compare.ORACLES, name, queries.ORACLES[name])
    assert compare.compare(spark, compare.oracle(SF), name, SF)[1] == "ok"
