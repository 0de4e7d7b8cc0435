"""Mixing sources to target weights over a time-varying curriculum.

A source's target is its share of the demand by weight, held to a multiple of its own
size, the excess shared again. Its documents form a stream in the order of a hash,
repeated pass after pass, and the mix takes the stream up to the target: the last
document is taken up to the word at which the target is met.

Each source has a schedule: its weight over training time 0 to 1, linear between
knots. The integral of the schedule, scaled to the target, is the source's cumulative
demand; its inverse at a document's place in the stream is the document's training
position. Range-sorting by position gives the training order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtrend.llm.common import keep, running_sums, small, uniform_key, words
from gridtrend.operators.keys import row_id

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Knots (time, weight) of the schedules, dealt to the sources in turn like the
#: weights: one falls, one rises, one peaks half way.
SCHEDULES = (((0.0, 1.0), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 0.5)))


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__size``, its words (a null text has none), and ``__key``."""
    return docs.withColumns(
        {"__size": F.size(words(F.col("text"))).cast("long"), "__key": uniform_key("mix", "doc_id")}
    )


def source_targets(
    rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, place, source_size, target) from sized rows.

    Sources are ranked by code point, null last, and weigh ``weights`` in turn.
    Sharing raises one number, the demand per weight, until it stops: every source
    below its limit gets its weight times that number.
    """
    totals = rows.groupBy("source").agg(F.sum("__size").alias("source_size"))
    ranked = row_id(totals, ["source"], "__rank")
    place = ((F.col("__rank") - 1) % len(weights)).cast("int")
    weight = F.array(*[F.lit(float(w)) for w in weights])
    sources = keep(
        ranked.select("source", "source_size", place.alias("place")).withColumn("weight", F.get(weight, "place"))
    )
    limit = F.col("source_size") * F.lit(float(most))
    whole = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    demand = share * (whole["size"] or 0)
    level = demand / whole["weight"] if whole["weight"] else 0.0
    while True:
        full = limit < F.lit(level) * F.col("weight")
        met = sources.agg(
            F.sum(F.when(full, limit).otherwise(0.0)).alias("full"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if not met["free"]:
            break
        following = (demand - met["full"]) / met["free"]
        if following <= level:
            break
        level = following
    return sources.select(
        "source", "place", "source_size", F.least(limit, F.lit(level) * F.col("weight")).alias("target")
    )


def position_at(part: Column, place: Column, schedules: Sequence = SCHEDULES) -> Column:
    """Training time at which the demand of a schedule has met ``part`` (0 to 1) of
    its whole: within a segment the demand is quadratic in time and solved for it."""
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        pieces = list(zip(knots, knots[1:]))
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pieces]
        met = part * F.lit(sum(areas))
        time, done = None, 0.0
        for ((t0, w0), (t1, w1)), area in zip(pieces, areas):
            rest = met - F.lit(done)
            slope = (w1 - w0) / (t1 - t0)
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * rest))
            here = F.lit(t0) + F.lit(2.0) * rest / (F.lit(w0) + root)
            time = here if time is None else F.when(met < F.lit(done), time).otherwise(here)
            done += area
        out = F.when(place == i, time).otherwise(out)
    return out


def takes(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    schedules: Sequence = SCHEDULES,
) -> DataFrame:
    """Every row of ``docs`` with __size, __source_size, __target and ``__takes``: an
    array of (pass, words, position), one for each time the mix takes of it.

    Weights and schedules are dealt to sources in turn and have the same length. A
    null source is a source of its own. Repeated rows are rows like others. Texts
    without words are never taken; with no words at all every target is 0.
    """
    if len(weights) != len(schedules):
        raise ValueError("one schedule for each weight")
    rows = sized(docs)
    targets = keep(source_targets(rows, weights, share, most))
    placed = running_sums(rows, ["source"], "__key", ["doc_id", "__size"], {"__start": "__size"})
    known = targets.select(
        F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")).alias("__of"),
        F.col("place").alias("__place"),
        F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"),
    )
    if small(known, 256):
        known = F.broadcast(known)
    joined = placed.withColumn("__of", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))).join(known, "__of")
    wanted = F.floor("__target")

    def take(turn: Column) -> Column:
        at = F.col("__start") + turn * F.col("__source_size")
        n = F.greatest(F.lit(0), F.least(F.col("__size"), wanted - at)).cast("long")
        part = F.when(wanted > 0, at.cast("double") / wanted).otherwise(0.0)
        return F.struct(
            turn.cast("int").alias("turn"),
            n.alias("words"),
            position_at(part, F.col("__place"), schedules).alias("position"),
        )

    taken = F.filter(F.array(*[take(F.lit(k)) for k in range(int(most))]), lambda x: x["words"] > 0)
    own = [c for c in joined.columns if c not in ("__of", "__place", "__start", "__key")]
    return joined.withColumn("__takes", taken).select(*own, "__takes")


def training_order(docs: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """The mix as rows of documents in training order: a document is a row for each
    time it is taken, whole (the cut at a target is a word count, not a shorter
    text); those that are not taken go."""
    mixed = takes(docs, **options)
    out = mixed.select(*docs.columns, F.explode("__takes").alias("__take"))
    out = out.withColumn("__at", F.col("__take.position")).drop("__take")
    order = ["__at", *(c for c in ("doc_id",) if c in docs.columns)]
    ranged = out.repartitionByRange(partitions, *order) if partitions else out.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order).select(*docs.columns)
