"""Posterior-draw tables: stacking, summaries, convergence, prediction, residuals."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, IntegerType, LongType, ShortType, StructType

from gridtrend.functions.scalars import hashed_uniform, label_order, log_choose, map_values
from gridtrend.models.counts import simulated_counts
from gridtrend.operators.groups import attach_group_stats
from gridtrend.operators.keys import row_id
from gridtrend.operators.quantiles import exact_quantiles
from gridtrend.operators.reshape import melt, pivot_unique, stack
from gridtrend.session import cut

QUANTILES = {0.025: "q2_5", 0.25: "q25", 0.5: "q50", 0.75: "q75", 0.975: "q97_5"}


def stack_chains(chains: Sequence[DataFrame]) -> DataFrame:
    """Wide per-chain tables (with ``iter``) to long (chain, iter, param, value)."""
    named = [c.withColumn("chain", F.lit(i)) for i, c in enumerate(chains, start=1)]
    return long_draws(stack(*named))


def long_draws(wide: DataFrame) -> DataFrame:
    params = [c for c in wide.columns if c not in ("chain", "iter")]
    return melt(wide, ["chain", "iter"], params, "param", "value")


def thin(draws: DataFrame, burn_in: int, every: int) -> DataFrame:
    after = F.col("iter") - burn_in
    return draws.filter((after > 0) & (after % every == 0))


def posterior_summary(draws: DataFrame) -> DataFrame:
    """Mean, sd, quantiles and share of draws on the mean's side of zero, per parameter."""
    values = draws.filter(F.col("value").isNotNull())
    moments = values.groupBy("param").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("value") >= 0, F.lit(1))).alias("__above"),
    )
    share = F.when(F.col("mean") >= 0, F.col("__above")).otherwise(F.col("n") - F.col("__above"))
    moments = moments.withColumn("same_sign", share / F.col("n")).drop("__above")
    long = exact_quantiles(values, ["param"], "value", list(QUANTILES))
    named = long.withColumn("prob", map_values(F.col("prob").cast("string"),
                                               {str(p): n for p, n in QUANTILES.items()}))
    wide = pivot_unique(named, ["param"], "prob", "quantile", list(QUANTILES.values()))
    return moments.join(wide, "param")


def _psrf(chains: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scale reduction from one row (n, mean, var) per chain.

    ``n`` is the mean chain length, which is the chain length when they agree.
    """
    sums = chains.groupBy(*keys).agg(
        F.avg("n").alias("n"),
        F.avg("var").alias("w"),
        F.var_samp("mean").alias("b_over_n"),
        F.count(F.lit(1)).alias("chains"),
    )
    n, w, b = F.col("n"), F.col("w"), F.col("b_over_n")
    pooled = (n - 1) / n * w + b
    return sums.select(
        *keys,
        "chains",
        w.alias("within"),
        (n * b).alias("between"),
        F.sqrt(pooled / F.nullif(w, F.lit(0.0))).alias("r_hat"),
    )


def scale_reduction(draws: DataFrame) -> DataFrame:
    """Potential scale reduction (Gelman & Rubin 1992) per parameter."""
    chains = draws.groupBy("param", "chain").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var")
    )
    return _psrf(chains, ["param"])


def scale_reduction_running(draws: DataFrame, blocks: int) -> DataFrame:
    """The same over the first 1, 2, ... ``blocks`` equal iteration blocks.

    Draws add up to one row per parameter, chain and block; the running totals
    work on those rows only.
    """
    span = draws.agg(F.struct(F.min("iter").alias("lo"), F.max("iter").alias("hi")).alias("s"))
    placed = draws.withColumn("__span", span.scalar()).withColumn(
        "block",
        F.expr(f"int(floor((iter - __span.lo) * {blocks} / (__span.hi - __span.lo + 1))) + 1"),
    )
    sums = placed.groupBy("param", "chain", "block").agg(
        F.count("value").alias("c"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    upto = (
        Window.partitionBy("param", "chain").orderBy("block")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    running = sums.select(
        "param",
        "chain",
        "block",
        F.sum("c").over(upto).alias("n"),
        F.sum(F.col("c") * F.col("m")).over(upto).alias("s"),
        F.sum(F.col("c") * (F.col("v") + F.col("m") * F.col("m"))).over(upto).alias("ss"),
    ).selectExpr(
        "param", "chain", "block", "n", "s / n AS mean",
        "(ss - s * s / n) / nullif(n - 1, 0) AS var",
    )
    return _psrf(running, ["param", "block"])


# prediction ---------------------------------------------------------------


@dataclass(frozen=True)
class DrawBlocks:
    """Draws packed as arrays, ``size`` draws per block.

    ``table`` has one row per block: (block, draws), the draws sorted by number.
    """

    table: DataFrame
    params: tuple[str, ...]
    size: int
    blocks: int
    fits_memory: bool


@dataclass(frozen=True)
class Effects:
    """Per-draw effects of a grouping level as arrays per block and level.

    Each value carries its draw's number, so a missing one is an error and never
    shifts the others.
    """

    table: DataFrame
    index: str
    value: str
    fits_memory: bool


#: Values of a draw table up to which it is broadcast (8 bytes each).
DRAW_VALUES_LIMIT = 8_000_000


def draw_blocks(
    wide: DataFrame, params: Sequence[str], size: int = 1_024, limit: int = DRAW_VALUES_LIMIT
) -> DrawBlocks:
    """Number the draws by (chain, iter) and pack them."""
    numbered = cut(
        row_id(wide.select("chain", "iter", *params), ["chain", "iter"], "draw")
    )
    n = numbered.count()
    blocks = max(1, -(-n // size))
    packed = numbered.groupBy(F.expr(f"int((draw - 1) div {size}) AS block")).agg(
        F.sort_array(F.collect_list(F.struct("draw", "chain", "iter", *params))).alias("draws")
    )
    return DrawBlocks(packed, tuple(params), size, blocks, n * (len(params) + 3) <= limit)


def effect_blocks(
    effects: DataFrame, index: str, value: str, size: int = 1_024, limit: int = DRAW_VALUES_LIMIT
) -> Effects:
    """Per-draw effects of a grouping level, long (draw, index, value), as arrays per block."""
    effects = cut(effects.select("draw", index, value))
    packed = effects.groupBy(F.expr(f"int((draw - 1) div {size}) AS block"), index).agg(
        F.sort_array(F.collect_list(F.struct("draw", F.col(value).alias("v")))).alias(f"__{value}")
    )
    return Effects(packed, index, value, 2 * effects.count() <= limit)


def _meet(rows: DataFrame, table: DataFrame, keys: list[str], fits_memory: bool) -> DataFrame:
    """Join rows to a table of arrays: broadcast if its counted values allow it, else by
    shuffle, with the rows of a key spread over as many slices as there are shuffle
    partitions."""
    if fits_memory:
        return rows.join(F.broadcast(table), keys)
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("draws", "__slice")]), F.lit(slices))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    copies = table.select("*", every.alias("__slice"))
    return rows.withColumn("__slice", part).join(copies, [*keys, "__slice"]).drop("__slice")


def predict_draws(
    rows: DataFrame, draws: DrawBlocks, predictor: str, effects: Sequence[Effects] = ()
) -> DataFrame:
    """Linear predictor and probability of every draw for every row, as arrays ``eta``
    and ``p`` per row and block.

    ``predictor`` is SQL over the row's columns and the draw's ``d.<param>``. The
    levels' effects meet the rows first, while those are narrow, and the draws last.
    Every block of a row has its draws' numbers beside its values, so what follows
    works on any number of blocks. Rows with a null in the predictor get null values;
    a row whose level has no effect goes.
    """
    # a narrow row grows by all draws, so the rows are dealt out by number, not by bytes
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if draws.blocks == 1:
        paired = rows.withColumn("block", F.lit(0))
    else:
        paired = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(draws.blocks - 1))))
    linear = predictor
    for e in effects:
        paired = _meet(paired, e.table, ["block", e.index], e.fits_memory)
        own = f"__{e.value}[i]"
        linear += (
            f" + IF({own}.draw = d.draw, {own}.v,"
            f" CAST(raise_error('{e.value}: a draw is missing') AS DOUBLE))"
        )
    paired = _meet(paired, draws.table, ["block"], draws.fits_memory)
    eta = F.expr(f"transform(draws, (d, i) -> {linear})")
    return (
        paired.withColumn("eta", eta)
        .withColumn("p", F.expr("transform(eta, e -> 1 / (1 + exp(-e)))"))
        .drop(*[f"__{e.value}" for e in effects])
    )


def long_predictions(predicted: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per (row, draw) from the arrays."""
    zipped = F.explode(F.arrays_zip("draws", *values))
    out = predicted.select(*keys, zipped.alias("z"))
    return out.select(
        *keys, "z.draws.draw", "z.draws.chain", "z.draws.iter", *[f"z.{v}" for v in values]
    )


def predictive_counts(
    predicted: DataFrame, keys: Sequence[str], trials: str, seed: int = 1, name: str = "y_sim"
) -> DataFrame:
    """Binomial counts by inverse CDF on a uniform hashed from (row keys, draw, seed).

    The count is the number of values a < n with CDF(a) <= u. Terms are summed in
    logarithms, and a p above one half is turned round, so no n makes the first term
    vanish for good. Counts never come from the observations, and do not depend on how
    the rows are partitioned or how often a task runs. A p of 0 or 1 gives 0 or n.
    """
    row_part = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    steps = F.expr(
        f"IF({trials} < 1, array(), transform(sequence(1, int({trials})), j -> ln(({trials} - j + 1) / j)))"
    )
    uniforms = predicted.withColumns({"__row": row_part, "__steps": steps}).withColumn(
        "__u",
        F.transform("draws", lambda d: hashed_uniform(F.col("__row"), d.getField("draw"))),
    )
    count = (
        "aggregate(__steps,"
        " named_struct('lp', {n} * log1p(-least(p, 1 - p)), 'cdf', exp({n} * log1p(-least(p, 1 - p))), 'y', 0),"
        " (s, l) -> named_struct("
        "   'lp', s.lp + l + ln(least(p, 1 - p) / greatest(p, 1 - p)),"
        "   'cdf', s.cdf + exp(s.lp + l + ln(least(p, 1 - p) / greatest(p, 1 - p))),"
        "   'y', s.y + IF(IF(p > 0.5D, s.cdf < 1 - u, u >= s.cdf), 1, 0)),"
        " s -> IF(p > 0.5D, int({n}) - s.y, s.y))"
    ).format(n=trials)
    exact = f"CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN int({trials}) ELSE {count} END"
    return uniforms.withColumn(
        name, F.expr(f"IF({trials} < 1, transform(p, x -> 0), zip_with(p, __u, (p, u) -> {exact}))")
    ).drop("__row", "__u", "__steps")


def pack_rows(rows: DataFrame, shared: Sequence[str], size: int = 64) -> DataFrame:
    """The rows that agree in the columns ``shared`` as one row with ``members``, an array
    of their other columns; about ``size`` members at most.

    Where ``shared`` is all that a predictor reads, a prediction is worked out once for all
    members. Rows that agree with no other are members of a row of their own.
    """
    counted = attach_group_stats(rows, list(shared), {"__rows_of": F.count(F.lit(1))})
    place = F.pmod(F.xxhash64(*rows.columns), F.ceil(F.col("__rows_of") / size))
    others = [c for c in rows.columns if c not in shared]
    packed = counted.groupBy(*shared, place.alias("__place")).agg(F.collect_list(F.struct(*others)).alias("members"))
    return packed.drop("__place")


def _narrow(predicted: DataFrame, keys: Sequence[str], trials: str, seed: int, carry: Sequence[str]) -> DataFrame:
    """What a simulation needs: the draws' numbers, ``p``, and the rows they are for."""

    def member(field: Callable[[str], Column], n: Column) -> Column:
        text = F.concat_ws("|", *[field(k).cast("string") for k in keys], F.lit(str(seed)))
        kept = [field(c).alias(c) for c in (*keys, *carry)]
        return F.struct(*kept, text.alias("__row"), n.cast("int").alias("__n"))

    if "members" in predicted.columns:
        members = F.transform("members", lambda m: member(m.getField, m.getField(trials)))
    else:
        members = F.array(member(F.col, F.expr(trials)))
    return predicted.select("block", members.alias("members"), F.col("draws.draw").alias("draw"), "p")


def _simulate(
    narrow: DataFrame, columns: Sequence[str], values: StructType, null_as_zero: bool,
    told: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, list[pa.Array]]],
) -> DataFrame:
    """``told`` makes result rows of (rows, their counts by draw, rows not known): the places
    of their rows, and their values; the rows' ``columns`` and block are put to them.

    A row without a number of trials is not known. A null p counts as 0 or makes all rows of
    its block unknown.
    """
    fields = narrow.select(F.explode("members").alias("m")).select(*[f"m.{c}" for c in columns]).schema.fields
    schema = StructType([*fields, *values.fields]).add("block", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, chance = batch["members"].flatten(), batch["p"].flatten()
            of = np.repeat(np.arange(len(batch)), pc.list_value_length(batch["members"]).to_numpy())
            sizes = pc.list_value_length(batch["p"]).to_numpy()
            trials = members.field("__n")
            unknown = pc.is_null(trials).to_numpy(zero_copy_only=False)
            if not null_as_zero and chance.null_count:
                nulls = np.repeat(np.arange(len(batch)), sizes)[pc.is_null(chance).to_numpy(zero_copy_only=False)]
                unknown = unknown | np.isin(of, nulls)
            p = pc.fill_null(chance, 0.0).to_numpy()
            p = np.where(np.isnan(p), 1.0, p) if null_as_zero else p  # NaN is above 1
            trials = np.where(unknown, 0, pc.fill_null(trials, 0).to_numpy())
            texts, draw = members.field("__row").to_pylist(), batch["draw"].flatten().to_numpy()
            for rows, y in simulated_counts(texts, trials, of, np.cumsum(sizes), draw, p):
                places, arrays = told(rows, y, unknown[rows])
                taken = members.take(pa.array(places, pa.int64()))
                block = batch["block"].take(pa.array(of[places], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(taken.field(c) for c in columns), *arrays, block.cast(pa.int32())], schema.fieldNames()
                )

    return narrow.mapInArrow(run, schema)


def predictive_histograms(
    predicted: DataFrame, keys: Sequence[str], trials: str, seed: int = 1,
    carry: Sequence[str] = (), null_as_zero: bool = False,
) -> DataFrame:
    """(keys, carry, y, c): how many draws give a row the count ``y``; the counts are those
    of ``predictive_counts``. Blocks add up, so no draw leaves its task. A row without trials
    or with a null in its predictor has one row with a null ``y`` and ``c`` 0, or all its
    draws at 0 where its trials are 0. With ``null_as_zero`` a null p counts as 0, as in
    ``predictive_counts``. Rows may be packed (``pack_rows``)."""
    columns = [*keys, *carry]

    def told(rows: np.ndarray, y: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        wide = int(y.max(initial=0)) + 1
        cells = np.arange(len(rows))[:, None] * wide + y
        held = np.bincount(cells.ravel(), minlength=len(rows) * wide).reshape(-1, wide)
        at, value = np.nonzero(held)
        c = np.where(unknown[at] & (not null_as_zero), 0, held[at, value])
        return rows[at], [pa.array(value.astype(np.int32), mask=unknown[at]), pa.array(c.astype(np.int64))]

    values = StructType().add("y", IntegerType()).add("c", LongType())
    found = _simulate(_narrow(predicted, keys, trials, seed, carry), columns, values, null_as_zero, told)
    return found.groupBy(*columns, "y").agg(F.sum("c").alias("c"))


def packed_counts(
    predicted: DataFrame, keys: Sequence[str], trials: str, seed: int = 1,
    carry: Sequence[str] = (), most: int = 2**31 - 1, name: str = "y_sim",
) -> DataFrame:
    """(keys, carry, block, ``name``): the arrays of ``predictive_counts`` for packed rows,
    in the smallest whole numbers that hold ``most`` trials."""
    columns = [*keys, *carry]
    kind, held = next(k for k in (
        (ByteType(), pa.int8()), (ShortType(), pa.int16()), (IntegerType(), pa.int32())
    ) if most < 2 ** (k[1].bit_width - 1))

    def told(rows: np.ndarray, y: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        flat = pa.array(y.ravel(), mask=np.repeat(unknown, y.shape[1])).cast(held)
        return rows, [pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * y.shape[1], flat)]

    values = StructType().add(name, ArrayType(kind))
    return _simulate(_narrow(predicted, keys, trials, seed, carry), columns, values, True, told)


def histogram_median(histograms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, median) of the counts; a row has at most one entry for each count it can
    have, so a group is bounded by its trials."""
    entries = histograms.groupBy(*keys).agg(
        F.sum("c").alias("__all"), F.sort_array(F.collect_list(F.struct("y", "c"))).alias("__h")
    )
    place = (
        "aggregate(filter(__h, x -> x.y IS NOT NULL), named_struct('seen', 0L, 'at', CAST(NULL AS INT)),"
        " (s, x) -> named_struct('seen', s.seen + x.c, 'at',"
        " IF(s.at IS NULL AND s.seen + x.c >= {k}, x.y, s.at)), s -> s.at)"
    )
    low, high = place.format(k="(__all + 1) div 2"), place.format(k="__all div 2 + 1")
    return entries.select(*keys, F.expr(f"({low} + {high}) / 2D").alias("median"))


def gather_blocks(
    predicted: DataFrame, keys: Sequence[str], arrays: Sequence[str], blocks: int | None = None
) -> DataFrame:
    """All draws of a row in one array, when they lie in several blocks.

    A group is one row's draws, bounded by the number of draws. With ``blocks`` known
    to be 1 the rows are whole already and are not shuffled.
    """
    if blocks == 1:
        return predicted.select(*keys, *arrays)
    grouped = predicted.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("block", *arrays))).alias("__b")
    )
    return grouped.select(
        *keys, *[F.flatten(F.col(f"__b.{a}")).alias(a) for a in arrays]
    )


def array_median(name: str) -> Column:
    return F.expr(
        f"aggregate(slice(array_sort({name}), int((size({name}) + 1) div 2),"
        f" IF(size({name}) % 2 = 0, 2, 1)), 0D, (s, v) -> s + v)"
        f" / IF(size({name}) % 2 = 0, 2, 1)"
    )


def predictive_median(
    counts: DataFrame, keys: Sequence[str], name: str = "y_sim", blocks: int | None = None
) -> DataFrame:
    """(keys, median) over all draws of a row, in however many blocks they lie."""
    whole = gather_blocks(counts, keys, [name], blocks)
    return whole.select(*keys, array_median(name).alias("median"))


def residual_bounds(
    counts: DataFrame, keys: Sequence[str], observed: str, name: str = "y_sim"
) -> DataFrame:
    """(keys, observed, lo, hi): share of simulations below, and at or below, the
    observation (Dunn & Smyth 1996). Every block counts its own draws and the counts
    are added by row. ``counts`` are arrays, or histograms that carry the observation."""
    arrays = name in counts.columns

    def count(test: str) -> Column:
        if arrays:
            return F.expr(f"size(filter({name}, v -> v {test} {observed}))")
        return F.expr(f"IF(y {test} {observed}, c, 0L)")

    size = F.size(name) if arrays else F.col("c")
    parts = counts.select(*keys, observed, count("<").alias("__lo"), count("<=").alias("__hi"), size.alias("__n"))
    sums = parts.groupBy(*keys, observed).agg(*[F.sum(c).alias(c) for c in ("__lo", "__hi", "__n")])
    return sums.select(
        *keys, observed, (F.col("__lo") / F.col("__n")).alias("lo"), (F.col("__hi") / F.col("__n")).alias("hi")
    )


def quantile_residuals(
    bounds: DataFrame, keys: Sequence[str], seed: int = 2, name: str = "residual"
) -> DataFrame:
    """Uniform under the model: lo + u (hi - lo) with a hashed u."""
    u = hashed_uniform(*keys, F.lit(seed))
    return bounds.withColumn(name, F.col("lo") + u * (F.col("hi") - F.col("lo")))


def residual_bins(residuals: DataFrame, bins: int = 20, name: str = "residual") -> DataFrame:
    """Counts of residuals per equal bin of [0, 1]."""
    place = F.least(F.floor(F.col(name) * bins), F.lit(bins - 1)) + 1
    return residuals.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def uniformity(residuals: DataFrame, keys: Sequence[str], name: str = "residual") -> DataFrame:
    """Largest gap between the residuals' distribution and the uniform one."""
    ranked = row_id(cut(residuals.select(name, *keys)), [name, *keys], "__rank")
    n = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    gaps = ranked.withColumn("__n", n).select(
        "__n",
        F.greatest(
            F.col("__rank") / F.col("__n") - F.col(name),
            F.col(name) - (F.col("__rank") - 1) / F.col("__n"),
        ).alias("gap"),
    )
    return gaps.agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("max_gap"))


def qq_points(residuals: DataFrame, keys: Sequence[str], name: str = "residual") -> DataFrame:
    """Each residual beside its expected uniform quantile."""
    ranked = row_id(cut(residuals.select(name, *keys)), [name, *keys], "__rank")
    n = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ranked.withColumn("__n", n).select(
        *keys, name, (F.col("__rank") / (F.col("__n") + 1)).alias("expected")
    )


def overdispersion(
    counts: DataFrame, keys: Sequence[str], observed: str, name: str = "y_sim", blocks: int | None = None
) -> DataFrame:
    """Variance of observed residuals over the mean variance of simulated ones.

    Residuals are taken from the mean over all draws of a row. Only the counts of a row
    meet, block by block: all rows of a block have its draws in the same order, so block
    and place tell a draw. The observation goes along as a draw without a number, so one
    pass gives both variances.
    """
    placed = counts.withColumn("__block", F.lit(0) if blocks == 1 else F.col("block").cast("int"))
    whole = placed.groupBy(*keys, observed).agg(F.collect_list(F.struct("__block", F.col(name).alias("y"))).alias("__b"))
    total = "aggregate(__b, 0D, (s, b) -> s + aggregate(b.y, 0D, (r, v) -> r + v))"
    seen = F.array(F.struct(F.lit(None).cast("int").alias("__block"), F.array(F.lit(None).cast(counts.schema[name].dataType.elementType)).alias("y")))
    value = F.when(F.col("__block").isNull(), F.col(observed).cast("double")).otherwise(F.col("y"))
    per_draw = (
        whole.withColumn("__mean", F.expr(f"{total} / aggregate(__b, 0, (s, b) -> s + size(b.y))"))
        .select(observed, "__mean", F.inline(F.concat(seen, "__b")))
        .select(observed, "__mean", "__block", F.posexplode("y").alias("__at", "y"))
        .groupBy("__block", "__at")
        .agg(F.var_samp(value - F.col("__mean")).alias("v"))
    )
    both = per_draw.agg(
        F.max(F.when(F.col("__block").isNull(), F.col("v"))).alias("observed"),
        F.avg(F.when(F.col("__block").isNotNull(), F.col("v"))).alias("simulated"),
    )
    return both.withColumn("ratio", F.col("observed") / F.nullif(F.col("simulated"), F.lit(0.0)))


def draw_deviance(predicted: DataFrame, k: str, n: str) -> DataFrame:
    """-2 log-likelihood of every draw; rows are summed per draw on the map side.

    The terms are on the scale of the linear predictor, ``-log(1 + exp(-+ eta))``, so a
    probability that rounds to 0 or 1 keeps its likelihood; a term with count 0 is 0.
    Collapse equal rows first and give their number as ``m`` where there is one.
    """
    times = F.col("m") if "m" in predicted.columns else F.lit(1)
    long = predicted.select(
        F.col(k).alias("k"),
        F.col(n).alias("n"),
        times.alias("m"),
        log_choose(n, k).alias("choose"),
        F.explode(F.arrays_zip("draws", "eta")).alias("z"),
    )
    tail = "log1p(exp(-abs(z.eta)))"
    ll = F.expr(
        f"m * (choose - IF(k = 0, 0D, k * (greatest(-z.eta, 0D) + {tail}))"
        f" - IF(n = k, 0D, (n - k) * (greatest(z.eta, 0D) + {tail})))"
    )
    return long.groupBy("z.draws.chain", "z.draws.iter").agg((-2 * F.sum(ll)).alias("deviance"))


def draws_by_site(
    draws: DataFrame,
    sites: DataFrame,
    temperature: Mapping[int, str],
    precipitation: Mapping[int, str],
) -> DataFrame:
    """Draws of ``name[i]`` parameters labelled with site i's levels, plot-ready.

    ``sites``: (site_index, site_id, temperature_level, precipitation_level).
    """

    def labelled(column: str, mapping: Mapping[int, str]) -> Column:
        return map_values(F.col(column).cast("string"), {str(k): v for k, v in mapping.items()})

    index = F.regexp_extract("param", r"\[(\d+)\]", 1).try_cast("int")
    out = draws.withColumn("site_index", index).join(sites, "site_index", "left")
    return out.select(
        "chain",
        "iter",
        "param",
        "value",
        "site_id",
        labelled("temperature_level", temperature).alias("temperature_label"),
        labelled("precipitation_level", precipitation).alias("prec_mm"),
    ).withColumns(
        {
            "temperature_order": label_order("temperature_label", list(temperature.values())),
            "prec_order": label_order("prec_mm", list(precipitation.values())),
        }
    )
