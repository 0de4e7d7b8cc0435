import random

import numpy as np
import pytest

from gridtrend.llm import toxicity as T


def corpus(n=500, seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        lang = r.choice(["en", "de", None])
        w, y = [word() for _ in range(r.randint(5, 60))], int(r.random() < 0.2)
        if y:
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(["zorgle", "Quaffed", "xylotoxen" + word()])
        docs.append((i, " ".join(w), lang))
        labels.append((i, y))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, toxic int"


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = corpus()
    train = [x for x in labels if x[0] % 4 != 2] + [(1, 0), (3, None), (None, 1), (99_999, 1)]
    df = spark.createDataFrame(docs, DOCS)
    return df, labels, T.learned(df, spark.createDataFrame(train, LABELS))


def test_held_out_and_reruns(spark, trained):
    df, labels, model = trained
    scores = {r["doc_id"]: r["s"] for r in df.select("doc_id", T.scored(df, model).alias("s")).collect()}
    y = np.array([l for d, l in labels if d % 4 == 2])
    s = np.array([scores[d] for d, _ in labels if d % 4 == 2])
    assert np.mean(s[y == 1][:, None] > s[y == 0][None, :]) >= 0.95
    assert ((s >= 0.3) == (y == 1)).mean() >= 0.93
    again = T.learned(df.repartition(5), spark.createDataFrame([x for x in labels if x[0] % 4 != 2], LABELS))
    assert abs(again.score("zorgle abc quaffed") - model.score("zorgle abc quaffed")) < 0.2


def test_edge_cases(spark, trained):
    df, _, model = trained
    odd = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "...", "xx"), (4, "abc " * 50_000 + "zorgle quaffed", "en")], DOCS)
    got = {r["doc_id"]: r for r in odd.select("doc_id", T.scored(odd, model).alias("s"), T.flagged(T.scored(odd, model), odd["lang"], model).alias("f")).collect()}
    assert got[1]["s"] == got[2]["s"] == got[3]["s"] < 0.3
    assert got[4]["s"] > 0.3 and all(0 <= r["s"] <= 1 for r in got.values())
    assert None in model.thresholds
    assert df.limit(0).select(T.scored(df, model)).collect() == []


def test_one_class_or_no_label(spark):
    df = spark.createDataFrame([(1, "a", "en"), (2, "b", "en")], DOCS)
    for rows, want in (([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)):
        model = T.learned(df, spark.createDataFrame(rows, LABELS))
        assert model.score("anything") == want


def test_parts_of_long_texts_agree(monkeypatch):
    model = T.Network()
    ids = T.word_buckets(" ".join(f"w{i}" for i in range(1000)))
    whole = model.pooled(ids)
    monkeypatch.setattr(T, "PART", 37)
    parts = model.pooled(ids)
    assert np.allclose(whole[0], parts[0], atol=1e-5) and (whole[1] == parts[1]).all()


def test_every_labelled_row_takes_part(spark):
    rows = [(i, f"lone{i} quaffed", "en") for i in range(8_000)] + [(i, f"lone{i} abc", "en") for i in range(8_000, 9_000)]
    labels = [(i, int(i < 8_000)) for i, _, _ in rows]
    model = T.learned(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    seen = [model.tables[0][T.word_buckets(f"lone{i}")[0, 0], 0] != 0 for i in range(8_000)]
    assert np.mean(seen) > 0.75  # the fifth that calibrates is not in the embeddings


def test_many_shards(spark, trained, monkeypatch):
    df, labels, _ = trained
    monkeypatch.setattr(T, "SHARD_BYTES", 15_000)
    train = spark.createDataFrame([x for x in labels if x[0] % 4 != 2], LABELS)
    model, again = T.learned(df, train), T.learned(df.repartition(5), train)
    scores = {r["doc_id"]: r["s"] for r in df.select("doc_id", T.scored(df, model).alias("s")).collect()}
    y = np.array([l for d, l in labels if d % 4 == 2])
    s = np.array([scores[d] for d, _ in labels if d % 4 == 2])
    assert np.mean(s[y == 1][:, None] > s[y == 0][None, :]) >= 0.9
    text = "zorgle abc quaffed"
    assert again.score(text) == pytest.approx(model.score(text), abs=1e-6)


def test_changes_move_a_network_to_where_they_were_made():
    r = np.random.default_rng(3)
    texts = [T.word_buckets(" ".join(r.choice(list("abcdefgh"), r.integers(0, 9)))) for _ in range(200)]
    labels = np.array([int(len(t) > 4) for t in texts])
    shared, model = T.Network(), T.Network()
    model.epoch(texts, labels, 1)
    slots, values = model.changes(shared)
    shared.move(slots, values / T.UNIT)
    for a, b in zip([*shared.tables, *shared.squares, *shared.state()], [*model.tables, *model.squares, *model.state()]):
        assert np.allclose(a, b, atol=1e-6)


def test_empty_labelled_texts(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "", None) for i in range(40)], DOCS)
    model = T.learned(df, spark.createDataFrame([(i, int(i < 10)) for i in range(40)], LABELS))
    assert 0 <= model.score(None) == model.score("") <= 1
