"""Sharding by balanced label propagation.

A shard is a label. Documents with equal texts are linked through their text, as a
hub, so a group of n copies has n links and not n squared. In every round a group's
bytes are summed by shard and its rows elsewhere are offered to the shard that holds
most of it among those with room for a row of it; a shard takes offers, small groups
first, up to its room, row by row. A group larger than a shard's room so fills one shard
after the other. Rounds end when hardly anything moves. Then sizes are made even: shards
over their quota give rows, unlinked and small ones first, to shards under it.

Rows are known by a hash of all their columns and the number of the copy, so neither
the partitioning nor a rerun changes where a row goes.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtrend.llm.common import keep, running_sums, uniform_key

SHARDS = 16
#: A document above 1 / HEAVY of a shard's mean size is placed by itself, largest
#: first; there are at most SHARDS * HEAVY of them.
HEAVY = 64
#: Rounds for each shard at most, and the share of the linked bytes below which a round's
#: moves are no longer worth the next one.
ROUNDS, SETTLED = 3, 0.001
SLACK = 0.5
EVENINGS = 2


def place_heavy(sizes: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], list[int]]:
    """Largest first into the emptiest shard: ({rid: shard}, bytes of each shard)."""
    loads = [(0, s) for s in range(shards)]
    where = {}
    for size, rid in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(loads)
        where[rid] = s
        heapq.heappush(loads, (load + size, s))
    return where, [load for load, _ in sorted(loads, key=lambda x: x[1])]


def quotas(total: int, heavy: list[int]) -> list[float]:
    """Bytes that each shard takes besides its heavy documents so that all stand at
    one level, or above it only by heavy documents."""
    held = sorted(heavy)
    level = 0.0
    for n in range(len(held), 0, -1):  # the n emptiest shards share one level
        level = (total - sum(held[n:])) / n
        if level >= held[n - 1]:
            break
    return [max(0.0, level - h) for h in heavy]


def chosen(index: Column, values: list) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def loads_of(rows: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["load"] for r in rows.groupBy("shard").agg(F.sum("size").alias("load")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def one_round(rows: DataFrame, capacity: list[float], loads: list[int]) -> tuple[DataFrame, int]:
    """Move linked rows towards the shards that hold most of their group, as far as
    the shards have room: the rows, and how many bytes moved. Only groups of two rows or
    more and of two shards or more take part in the joins."""
    room = [max(0.0, c - l) for c, l in zip(capacity, loads)]
    held = keep(rows.groupBy("group", "shard").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("n")))
    offer = F.struct("held", F.xxhash64("group", "shard"), "shard")
    taking = chosen(F.col("shard"), room) >= F.col("held") / F.col("n")  # texts of a group are equal
    whole = held.groupBy("group").agg(
        F.max(F.when(taking, offer)).alias("best"), F.sum("n").alias("all")
    ).filter("best is not null")
    best = whole.select("group", F.col("best.held").alias("most"), F.col("best.shard").alias("to"), "all")
    leave = (
        held.join(best, "group")
        .filter((F.col("shard") != F.col("to")) & (F.col("held") <= F.col("most")))
        .select("group", "shard", "to", "all")
    )
    digit = F.lower(F.hex(F.least(F.lit(15), F.floor(F.log2(F.col("all").cast("double")))).cast("long")))
    offers = keep(
        rows.join(leave, ["group", "shard"]).select("rid", "to", "size", F.concat(digit, "key").alias("order"))
    )
    ranked = running_sums(offers, ["to"], "order", ["rid"], {"before": "size"})
    fits = F.col("before") + F.col("size") <= chosen(F.col("to"), room)
    moved = keep(ranked.filter(fits).select("rid", "to", "size"))
    amount = moved.agg(F.sum("size")).first()[0] or 0
    if not amount:
        return rows, 0
    after = rows.join(moved.drop("size"), "rid", "left").withColumn("shard", F.coalesce("to", "shard"))
    return keep(after.select("rid", "group", "key", "size", "shard")), amount


def even_out(rows: DataFrame, quota: list[float], loads: list[int]) -> DataFrame:
    """Carry the surplus of shards over their quota to those under it.

    The surpluses, end to end, are one line and the free rooms another; a row that
    leaves goes to the shard whose room lies at the row's middle on that line.
    """
    surplus = [max(0.0, l - q) for l, q in zip(loads, quota)]
    free = [max(0.0, q - l) for l, q in zip(loads, quota)]
    line = [sum(surplus[:s]) for s in range(len(surplus))]
    size_class = F.least(F.lit(7), F.greatest(F.lit(0), F.floor(F.log2(F.col("size").cast("double"))) - 5))
    digit = F.lower(F.hex((size_class + F.when(F.col("linked"), 8).otherwise(0)).cast("long")))
    giving = rows.filter(chosen(F.col("shard"), surplus) > 0).withColumn("order", F.concat(digit, "key"))
    ranked = running_sums(giving, ["shard"], "order", ["rid"], {"before": "size"})
    middle = F.col("before") + F.col("size") / 2
    at = chosen(F.col("shard"), line) + middle
    to, end = F.lit(None).cast("int"), 0.0
    for s, f in enumerate(free):
        end += f
        if f > 0:
            to = F.coalesce(to, F.when(at < F.lit(end), F.lit(s)))
    moved = (
        ranked.filter(middle < chosen(F.col("shard"), surplus)).select("rid", to.alias("to")).filter("to is not null")
    )
    return keep(
        rows.join(moved, "rid", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")
    )


def measured(docs: DataFrame, *columns: str) -> DataFrame:
    """rid, size, text_crc32, group and mark (hash of all columns) of every document, and
    the columns asked for."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and f.name != "__rid"]
    return docs.select(
        F.col("__rid").alias("rid"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("group"),
        F.xxhash64(*hashed).alias("mark"),
        *columns,
    )


def assign(measures: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(rid, shard, slot) for a written table of ``measured`` documents.

    The law is ``bytes``: sizes (UTF-8 bytes of the text and one more; a null text has
    none, and the checksum of the empty text) are near equal. Only a document larger
    than a shard's mean size can make a shard larger. Slots are gapless from 0 in
    each shard. Repeated rows are linked like other copies, and numbered, for their keys;
    which of rows that are equal in every column has which number is left open. A null
    doc_id is a value like another. An empty table has no rows.
    """
    marked = measures.select("rid", "size", "group", "mark", uniform_key("copy", "rid").alias("__at")).withColumn("__one", F.lit(1))
    copies = running_sums(marked, ["mark"], "__at", ["rid"], {"copy": "__one"})
    every = keep(copies.select("rid", "size", "group", uniform_key("shard", "group", "mark", "copy").alias("key")))
    total = every.agg(F.sum("size")).first()[0] or 0
    is_heavy = F.col("size") * F.lit(shards * HEAVY) > F.lit(total)
    largest = every.filter(is_heavy).select("size", "key", "rid").collect()
    heavy, held = place_heavy([(r["size"], (r["key"], r["rid"])) for r in largest], shards)
    heavy = {rid: shard for (_, rid), shard in heavy.items()}
    quota = quotas(total, held)
    whole = sum(quota) or 1.0
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    first, done = F.lit(shards - 1), sum(quota)
    for s in range(shards - 1, -1, -1):
        first = F.when(place < F.lit(done / whole), F.lit(s)).otherwise(first)
        done -= quota[s]
    light = every.filter(~is_heavy).select("rid", "group", "key", "size", first.cast("int").alias("shard"))
    groups = light.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group")
    links = keep(groups)
    rows = keep(light.join(links.withColumn("linked", F.lit(True)), "group", "left").withColumn("linked", F.coalesce("linked", F.lit(False))))
    linked = keep(rows.filter("linked").drop("linked"))
    alone = loads_of(rows.filter("not linked"), shards)
    capacity = [q * (1 + SLACK) for q in quota]
    of_linked = sum(loads_of(linked, shards))
    for _ in range(ROUNDS * shards if of_linked and shards > 1 else 0):
        loads = [a + b for a, b in zip(alone, loads_of(linked, shards))]
        linked, moved = one_round(linked, capacity, loads)
        if moved <= SETTLED * of_linked:
            break
    rows = rows.filter("not linked").unionByName(linked.withColumn("linked", F.lit(True)))
    for _ in range(EVENINGS):
        loads = loads_of(rows, shards)
        if max((abs(l - q) for l, q in zip(loads, quota)), default=0) <= 1:
            break
        rows = even_out(rows, quota, loads)
    by_hand = every.filter(is_heavy).select("rid", "key", "size")
    if heavy:
        where = F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair])
        by_hand = by_hand.withColumn("shard", F.element_at(where, F.col("rid")).cast("int"))
    else:
        by_hand = by_hand.withColumn("shard", F.lit(0))
    placed = keep(rows.select("rid", "key", "size", "shard").unionByName(by_hand).withColumn("one", F.lit(1)))
    slots = running_sums(placed, ["shard"], "key", ["rid"], {"slot": "one"})
    return slots.select("rid", "shard", F.col("slot").cast("long").alias("slot"))


def cut_share(measures: DataFrame, placed: DataFrame) -> float | None:
    """Share of the linked rows (those with an equal text elsewhere) that lie outside the
    shard that holds most of their group; null if no row is linked."""
    held = measures.select("rid", "group").join(placed.select("rid", "shard"), "rid").groupBy("group", "shard")
    groups = held.agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    return groups.filter(F.col("all") > 1).agg(F.sum(F.col("all") - F.col("most")) / F.sum("all")).first()[0]


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot``; columns of
    ``docs`` that have these names are replaced. Nulls, ties, repeated rows and an empty
    table: as ``assign`` says."""
    own = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
    rows = keep(docs.select(*own, F.monotonically_increasing_id().alias("__rid")))
    measures = keep(measured(rows))
    found = assign(measures, shards).join(measures.drop("group", "mark"), "rid").withColumnRenamed("rid", "__rid")
    return rows.join(found, "__rid").drop("__rid")
