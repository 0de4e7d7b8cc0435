"""SimHash fingerprints, and near-duplicate classes by pivot distance tables.

A fingerprint has 64 bits. Every distinct fingerprint gets a row of a distance
table: its Hamming distances to reference fingerprints (pivots), computed once. By
the triangle inequality two fingerprints within the radius differ by no more than
the radius at every pivot, so a pair with a larger coordinate difference is
discarded before its bits are compared; survivors are verified bit by bit.

Pairs to test come from equality joins, never from all pairs: the bits are cut into
``radius + matched`` blocks, of which a pair within the radius shares at least
``matched`` whole ones, and the fingerprints meet on every choice of so many blocks.
Keys that more than ``hot`` fingerprints share are joined again on a finer cut, in
which a key leaves 16 bits open, so no group can have over 65 536 members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gridtrend.llm.common import keep
from gridtrend.llm.graph import components

SEED = 42
SHINGLE = 3
RADIUS = 3
PIVOTS = 8
MATCHED = 3
FINE_MATCHED = 9
HOT = 1_000
ONES = (1 << 64) - 1


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text: bit i is 1 if it is set in over half of the
    hashes of its word shingles. No word: 0; fewer words than a shingle: one hash."""
    w = text.lower().split()  # on bytes: A-Z only, and the six ASCII white-space characters
    if not w:
        return 0
    grams = zip(*(w[k:] for k in range(shingle))) if len(w) >= shingle else [w]
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(g, SEED) for g in map(b" ".join, grams)), np.uint64)
    octets = h.view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(octets), 1 << 16):
        ones += np.unpackbits(octets[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long; a null text has no word."""

    @F.pandas_udf(LongType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return run(F.coalesce(text, F.lit("")).cast("binary"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: fixed, spread-out bit patterns."""
    return [signed(xxhash.xxh64_intdigest(b"pivot %d" % i, SEED)) for i in range(n)]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def block_masks(blocks: int, matched: int) -> list[int]:
    edge = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(blocks)]
    return [signed(sum(c)) for c in combinations(one, matched)]


def keyed(prints: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each fingerprint and choice of blocks: (table, key, fp, pivots)."""
    table = F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("table", "mask")
    return prints.select("fp", "d", table).select(
        "table", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "d"
    )


def meet(keys: DataFrame, radius: int) -> DataFrame:
    """Pairs (a < b) on a common key that the pivots do not discard, verified."""
    x = keys.select("table", "key", F.col("fp").alias("a"), F.col("d").alias("da"))
    y = keys.select("table", "key", F.col("fp").alias("b"), F.col("d").alias("db"))
    apart = [F.abs(F.col("da")[i] - F.col("db")[i]) for i in range(PIVOTS)]
    kept = (F.col("a") < F.col("b")) & (F.greatest(*apart) <= radius)
    pairs = x.join(y, ["table", "key"]).filter(kept)
    return pairs.filter(distance(F.col("a"), F.col("b")) <= radius).select("a", "b")


def links(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Every pair a < b of distinct fingerprints (column ``fp``) within the radius."""
    to_pivot = [distance(F.col("fp"), F.lit(p)).cast("int") for p in pivots()]
    prints = keep(prints.select("fp", F.array(*to_pivot).alias("d")))
    keys = keyed(prints, block_masks(radius + MATCHED, MATCHED))
    crowded = keep(
        keys.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot)
    )
    if crowded.isEmpty():
        return keep(meet(keys, radius).distinct())
    cold = keys.join(crowded.select("table", "key"), ["table", "key"], "left_anti")
    dense = keep(keys.join(crowded.select("table", "key"), ["table", "key"], "left_semi").select("fp", "d").distinct())
    fine = keyed(dense, block_masks(radius + FINE_MATCHED, FINE_MATCHED))
    return keep(meet(cold, radius).union(meet(fine, radius)).distinct())


def linked_prints(prints: DataFrame, radius: int, hot: int) -> DataFrame:
    """(fp, root, component_id, n_links) of every distinct fingerprint in ``prints``
    (fp, low): root is the smallest fingerprint reachable, component_id the smallest
    ``low`` among those, n_links the number of others within the radius."""
    pairs = links(prints, radius, hot)
    rooted = components(pairs).withColumnRenamed("node", "fp")
    degree = (
        pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    )
    joined = keep(prints.join(rooted, "fp").join(degree, "fp"))
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = joined.join(lows, "root").select("fp", "root", "component_id", "n_links")
    return prints.join(linked, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.coalesce("component_id", "low").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def near_classes(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    shingle: int = SHINGLE, radius: int = RADIUS, hot: int = HOT,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``fp``, ``component_id`` (smallest id
    reachable over links, its own included) and ``n_links`` (other fingerprints
    within the radius).

    Equal texts have equal fingerprints and are linked through it, however many. A
    null text counts as empty; texts without a word have fingerprint 0 and link like
    any other. Repeated rows stay repeated. A null id is never a component id unless
    its whole component has none. An empty table gives an empty result.
    """
    seen = keep(
        docs.select(F.col(id_column).alias("id"), fingerprint(F.col(text_column), shingle).alias("fp"))
    )
    prints = keep(seen.groupBy("fp").agg(F.min("id").alias("low")))
    classes = linked_prints(prints, radius, hot).drop("root")
    return seen.join(classes, "fp").select(F.col("id").alias(id_column), "fp", "component_id", "n_links")


def drop_near_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    shingle: int = SHINGLE, radius: int = RADIUS, hot: int = HOT,
) -> DataFrame:
    """One row of each near-duplicate class stays, whole: the one of the smallest id
    (a null id comes last), then of the smallest text hash, then of the smallest hash
    of all columns. Classes are those of fingerprints, so rows that share an id but
    lie in different classes all find their own place, and rows equal in every column
    count as one. An empty table gives an empty result.
    """
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    marks = {
        "__id": F.col(id_column),
        "__text": F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))),
        "__row": F.xxhash64(*[F.col(c) for c in hashed]),
    }
    order = F.struct(F.col("__id").isNull().alias("last"), *marks)
    seen = docs.select(*[c.alias(n) for n, c in marks.items()], fingerprint(F.col(text_column), shingle).alias("fp"))
    prints = keep(seen.groupBy("fp").agg(F.min(order).alias("low")))
    first = linked_prints(prints, radius, hot).groupBy("root").agg(F.min("component_id").alias("low"))
    stay = first.select(*[F.col(f"low.{n}").alias(f"{n}_") for n in marks])
    same = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in marks]
    one = docs.withColumns(marks).join(stay, same, "left_semi").dropDuplicates(list(marks))
    return one.select(docs.columns)
