import numpy as np
from pyspark.sql import functions as F

from gridtrend.llm import language_id as L
from gridtrend.llm.common import remainder

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = L.learned(docs.filter(~held_out))
    found = docs.filter(held_out).select("lang", L.language(docs, model).alias("m")).collect()
    assert np.mean([r["lang"] == r["m"]["lang"] for r in found]) >= 0.95
    assert all(0 <= r["m"]["score"] <= 1 and abs(sum(r["m"]["proportions"]) - 1) < 1e-3 for r in found)


def test_counts_equal_plain_counting(spark):
    rows = [("aé b", "x"), ("B1c  d", "x"), ("aé b", "y"), (None, "x"), ("zz", None), ("", "y")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = {(r["lang"], r["bucket"]): r["n"] for r in L.counted(df, "text", "lang").collect()}
    want = {}
    for t, l in rows:
        for b in L.trigrams(t).tolist() if t and l else ():
            want[l, b] = want.get((l, b), 0) + 1
    assert got == want
    assert len(L.trigrams("aé b")) == 4  # " aé", "aé ", "é b", " b "
    assert L.trigrams("a--1B").tolist() == L.trigrams("A b").tolist()


def test_mixture_of_two_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.learned(docs)
    by = {r["lang"]: r["text"] for r in docs.filter("n_chars > 4000").collect()}
    a, b = by["en"][:4000], by["de"][:2000]
    m = model.infer(a + "\n" + b)
    assert m["languages"][:2] == ["en", "de"] and abs(m["proportions"][0] - 2 / 3) < 0.1
    assert model.infer(a)["languages"] == ["en"] and model.infer(a)["score"] == 1.0
    assert model.infer((a + "\n") * 60)["lang"] == "en"  # long texts go by counts of trigrams


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, "12 !", "x"), (4, "abc", "x")], "doc_id long, text string, lang string")
    for df in (docs, docs.filter("doc_id < 0")):
        model = L.learned(df)
        got = {r["doc_id"]: r["m"] for r in docs.select("doc_id", L.language(docs, model).alias("m")).collect()}
        assert [got[i]["lang"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0 and got[1]["languages"] == []
        assert got[4]["lang"] == ("x" if df is docs else "und")
    assert docs.filter("doc_id < 0").select(L.language(docs, model).alias("m")).collect() == []
