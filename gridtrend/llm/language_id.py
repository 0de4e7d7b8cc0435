"""Languages of a text as a mixture inferred by expectation-maximisation.

Each language is a distribution over hashed letter trigrams, counted over all training
texts. A text's trigrams are a mixture of the languages; EM estimates the proportions,
and of the nested sets of the leading languages the one with the best penalised
likelihood is selected. The language is the leading one of that set and its score is
its proportion in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.1
ROUNDS = 12
#: Units of log(n) that one more language has to gain.
PENALTY = 2.0
UNKNOWN = "und"
FIELDS = ("lang", "score", "languages", "proportions")
RESULT = "struct<lang: string, score: double, languages: array<string>, proportions: array<double>>"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the letter trigrams of a text: lower case, everything else one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    codes = np.where(is_letter, codes, np.uint32(32))
    keep = np.ones(len(codes), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)
    h = (codes[:-2] * np.uint32(0x9E3779B1)) ^ (codes[1:-1] * np.uint32(0x85EBCA77)) ^ (codes[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def counted(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n) over all documents with a language; each partition sums first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for x, l in zip(*(c.to_pylist() for c in batch.columns)):
                into = sums.setdefault(l, np.zeros(BUCKETS, np.int64))
                into += np.bincount(trigrams(x), minlength=BUCKETS)
        for l, n in sums.items():
            used = np.flatnonzero(n)
            columns = [pa.array([l] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(n[used])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    rows = docs.select(F.col(text).alias("x"), F.col(lang).alias("l")).filter("x is not null and l is not null")
    parts = rows.mapInArrow(run, "lang string, bucket int, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixture:
    """Trigram distributions of the languages, in code-point order."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        n = np.array([counts[l] for l in self.languages], float).reshape(-1, BUCKETS) + SMOOTHING
        self.share = np.ascontiguousarray((n / n.sum(axis=1, keepdims=True)).T.astype(np.float32))

    def infer(self, text: str | None) -> dict:
        grams = trigrams(text) if text and self.languages else np.zeros(0, np.int64)
        if not len(grams):
            return {"lang": UNKNOWN, "score": 0.0, "languages": [], "proportions": []}
        weight, total = None, float(len(grams))
        if len(grams) > BUCKETS // 4:
            n = np.bincount(grams, minlength=BUCKETS)
            grams = np.flatnonzero(n)
            weight = n[grams].astype(np.float32)
        table = self.share[grams]
        best = None
        leading = np.argsort(-self.fit(table, weight, total)[0], kind="stable")
        for k in range(1, len(leading) + 1):
            part = np.ascontiguousarray(table[:, leading[:k]])
            mix, fit = self.fit(part, weight, total)
            value = fit - (k - 1) * PENALTY * np.log(total)
            if best is not None and value <= best[0]:
                break
            best = value, mix, leading[:k]
        _, mix, chosen = best
        order = np.argsort(-mix, kind="stable")
        return {
            "lang": self.languages[chosen[order[0]]],
            "score": float(min(1.0, mix[order[0]])),
            "languages": [self.languages[chosen[i]] for i in order],
            "proportions": [float(mix[i]) for i in order],
        }

    @staticmethod
    def fit(table: np.ndarray, weight: np.ndarray | None, total: float) -> tuple[np.ndarray, float]:
        """Proportions that maximise the likelihood of the rows of ``table``, and it."""
        k = table.shape[1]
        mix = np.full(k, 1.0 / k, np.float32)
        if k > 1:
            for _ in range(ROUNDS):
                each = 1.0 / (table @ mix)
                if weight is not None:
                    each *= weight
                mix = mix * (each @ table) / np.float32(total)
                mix /= mix.sum()
        log = np.log((table @ mix).astype(np.float64))
        return mix, float((log if weight is None else log * weight).sum())


def learned(docs: DataFrame, text: str = "text", lang: str = "lang") -> Mixture:
    """The model of all ``docs``. Its table, with a row of fixed length for each
    language, is all that comes to the driver."""
    counts: dict[str, np.ndarray] = {}
    frame = counted(docs, text, lang).toPandas()
    for l, part in frame.groupby("lang"):
        counts[l] = np.zeros(BUCKETS, np.int64)
        counts[l][part["bucket"].to_numpy()] = part["n"].to_numpy()
    return Mixture(counts)


def language(docs: DataFrame, model: Mixture, text: str = "text") -> Column:
    """lang, score and the selected set with its proportions, of a text column.

    A null text, or one without letters, is ``und`` with score 0 and an empty set; so
    is every text if nothing was learned. Only the text counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.infer(t) for t in texts]
        return pd.DataFrame({k: pd.Series([f[k] for f in found], dtype=object) for k in FIELDS})

    return run(F.col(text))
