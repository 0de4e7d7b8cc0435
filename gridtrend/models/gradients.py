"""Joint solve of mixed-model equations by conjugate gradients on tables.

The random effects' equations are a sparse symmetric table: a block on the diagonal for
every level, and a block for every pair of levels that occur together. They are solved
for all right hand sides at once (one for each fixed column, one for the response, and
some random ones), each step being joins and sums by key; the blocks on the diagonal
precondition. The fixed effects follow from their Schur complement. Nothing of the size
of the random effects leaves the tables; a fit's own row has a few p x p numbers.

The posterior covariances that the variance steps need are traces of an inverse. The
random right hand sides estimate what the diagonal blocks leave out (Hutchinson).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrend.models.sweep import swept
from gridtrend.session import cut

#: Random right hand sides, and the relative size of the residuals at the end.
PROBES, ACCURACY, MOST_STEPS = 16, 1e-8, 500


def solve(keys: list[str], entries: DataFrame, inverse: DataFrame, right: DataFrame) -> DataFrame:
    """(keys, key, c, x) with A x = right for every column ``c``.

    ``entries`` and ``inverse`` are (keys, key, other, a): the symmetric matrix and the
    inverse of its diagonal blocks; ``right`` is (keys, key, c, r).
    """

    def times(matrix: DataFrame, vector: DataFrame, value: str, name: str) -> DataFrame:
        moved = vector.select(*keys, F.col("key").alias("other"), "c", F.col(value).alias("__v"))
        return matrix.join(moved, [*keys, "other"]).groupBy(*keys, "key", "c").agg(F.sum(F.expr("a * __v")).alias(name))

    column, place = [*keys, "c"], [*keys, "key", "c"]
    first = cut(right.join(times(inverse, right, "r", "d"), place))
    rho = cut(first.groupBy(*column).agg(F.sum(F.expr("r * d")).alias("rho")))
    start = rho.withColumnRenamed("rho", "start")
    state = first.withColumn("x", F.lit(0.0))
    for _ in range(MOST_STEPS):
        forward = cut(state.join(times(entries, state, "d", "q"), place))
        alpha = forward.groupBy(*column).agg(F.sum(F.expr("d * q")).alias("dq")).join(rho, column)
        alpha = alpha.select(*column, F.expr("coalesce(rho / nullif(dq, 0D), 0D)").alias("alpha"))
        forward = forward.join(alpha, column).select(*place, F.expr("x + alpha * d").alias("x"),
                                                     F.expr("r - alpha * q").alias("r"), "d")
        forward = cut(forward)
        led = cut(forward.join(times(inverse, forward, "r", "s"), place))
        after = cut(led.groupBy(*column).agg(F.sum(F.expr("r * s")).alias("rho")))
        left = after.join(start, column).agg(F.max(F.expr("rho / nullif(start, 0D)"))).first()[0]
        if left is None or left < ACCURACY**2:
            return forward.select(*place, "x")
        turn = after.withColumnRenamed("rho", "next").join(rho, column)
        turn = turn.select(*column, F.expr("coalesce(next / nullif(rho, 0D), 0D)").alias("turn"))
        state = led.join(turn, column).select(*place, "x", "r", F.expr("s + turn * d").alias("d"))
        rho = after
    raise RuntimeError("the equations of the random effects did not settle")


def _key(h: int, j: str, level: str):
    return F.concat_ws("|", F.lit(str(h)), j, F.col(level).cast("string"))


def _cells(values: list[tuple[int, int, str]]):
    """Entries (i, j, SQL) as rows."""
    return F.explode(F.array(*[
        F.struct(F.lit(str(i)).alias("i"), F.lit(str(j)).alias("j"), F.expr(e).alias("a")) for i, j, e in values
    ])).alias("e")


def equations(problem, sums: DataFrame, fits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entries, inverse, right, blocks) of the random effects' equations."""
    keys, groups, layout = problem.keys, problem.groups, problem.layout
    p, alone = layout.p, []
    for h, g in enumerate(groups):
        only = " AND ".join(f"{o} IS {'NOT' if o == g else ''} NULL" for o in groups)
        alone.append(sums.filter(only).select(*keys, g, "rows", "v"))

    def blocks_of(h: int) -> DataFrame:
        """Diagonal blocks with the effects' precision, and their inverses."""
        z, schema = len(layout.blocks[h]), alone[h].schema

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                v = np.stack(batch["v"].to_numpy()).astype(float) if len(batch) else np.zeros((0, z * p + z * z + z))
                own = v[:, z * p : z * p + z * z].reshape(-1, z, z)
                own = own + np.array([layout.precision(g)[h] for g in batch["g"]]).reshape(-1, z, z)
                out = batch.drop(columns=["g"])
                out["block"] = [b.ravel().tolist() for b in own]
                out["inverse"] = [np.linalg.inv(b).ravel().tolist() for b in own]
                yield out

        named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        told = alone[h].join(fits.select(*keys, "g"), keys)
        return told.mapInPandas(run, f"{named}, block array<double>, inverse array<double>")

    blocks = [cut(blocks_of(h)) for h in range(len(groups))]
    entries = inverse = right = None

    def added(to: DataFrame | None, more: DataFrame) -> DataFrame:
        return more if to is None else to.unionByName(more)

    for h, g in enumerate(groups):
        z = len(layout.blocks[h])
        for name, kind in (("block", "entries"), ("inverse", "inverse")):
            cells = _cells([(i, j, f"{name}[{i * z + j}]") for i in range(z) for j in range(z)])
            rows = blocks[h].select(*keys, g, cells).select(
                *keys, _key(h, "e.i", g).alias("key"), _key(h, "e.j", g).alias("other"), "e.a"
            )
            if kind == "entries":
                entries = added(entries, rows)
            else:
                inverse = added(inverse, rows)
        cells = [(i, c, f"v[{i * p + c}]") for i in range(z) for c in range(p)]
        cells += [(i, p, f"v[{z * p + z * z + i}]") for i in range(z)]
        rows = blocks[h].select(*keys, g, _cells(cells)).select(
            *keys, _key(h, "e.i", g).alias("key"), F.expr("CAST(e.j AS INT)").alias("c"), F.col("e.a").alias("r")
        )
        right = added(right, rows)
    for (h, g), (k, o) in combinations(enumerate(groups), 2):
        y, z = len(layout.blocks[h]), len(layout.blocks[k])
        cells = _cells([(i, j, f"v[{i * z + j}]") for i in range(y) for j in range(z)])
        rows = sums.filter(f"{g} IS NOT NULL AND {o} IS NOT NULL").select(*keys, g, o, cells).select(
            *keys, _key(h, "e.i", g).alias("key"), _key(k, "e.j", o).alias("other"), "e.a"
        )
        entries = entries.unionByName(rows)
        entries = entries.unionByName(rows.select(*keys, F.col("other").alias("key"), F.col("key").alias("other"), "a"))
    drawn = F.explode(F.expr(f"sequence({p + 1}, {p + PROBES})")).alias("c")
    probes = right.filter("c = 0").select(*keys, "key", drawn)
    sign = F.when(F.xxhash64("key", "c").bitwiseAND(F.lit(1)) == 0, 1.0).otherwise(-1.0)
    return cut(entries), cut(inverse), cut(right.unionByName(probes.withColumn("r", sign))), blocks


def solved(problem, sums: DataFrame, fits: DataFrame, tol: float) -> DataFrame:
    """Next state of every fit: joint effects, and one step of each variance."""
    from gridtrend.models.mixed import settled, tau_step, updated

    keys, groups, layout = problem.keys, problem.groups, problem.layout
    p, prior = layout.p, problem.prior
    overdispersed, inflated = problem.overdispersed, problem.inflated
    entries, inverse, right, blocks = equations(problem, sums, fits)
    x = solve(keys, entries, inverse, right)

    # the fixed effects' Schur complement, p x (p + 1) sums for every fit
    crossed = x.filter(f"c <= {p}").join(
        right.filter(f"c < {p}").withColumnRenamed("c", "i"), [*keys, "key"]
    ).groupBy(*keys, "i", "c").agg(F.sum(F.expr("r * x")).alias("s"))
    packed = crossed.groupBy(*keys).agg(F.collect_list(F.struct("i", "c", "s")).alias("crossed"))
    total = sums.filter(" AND ".join(f"{g} IS NULL" for g in groups)).select(*keys, "rows", "v")

    def fixed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            beta, vcov = [], []
            for v, cells in zip(batch["v"], batch["crossed"]):
                v, s = np.asarray(v, float), np.zeros((p, p + 1))
                for cell in cells:
                    s[cell["i"], cell["c"]] = cell["s"]
                schur = v[: p * p].reshape(p, p) + prior * np.eye(p) - (s[:, :p] + s[:, :p].T) / 2
                inverted, used = swept(schur)
                beta.append((inverted @ (v[p * p : p * p + p] - s[:, p])).tolist())
                inverted[~used] = np.nan
                inverted[:, ~used] = np.nan
                vcov.append(inverted.ravel().tolist())
            out = batch.drop(columns=["crossed"])
            out["beta"], out["vcov"] = beta, vcov
            yield out

    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in total.schema)
    known = cut(total.join(packed, keys).mapInPandas(fixed, f"{named}, beta array<double>, vcov array<double>"))

    # effects and covariances level by level
    whole = x.join(right.withColumnRenamed("r", "drawn"), [*keys, "key", "c"], "left")
    levels, moments = None, None
    for h, g in enumerate(groups):
        z = len(layout.blocks[h])
        own = blocks[h].select(
            *keys, g, "rows", "inverse", F.explode(F.sequence(F.lit(0), F.lit(z - 1))).alias("i")
        ).withColumn("key", _key(h, F.col("i").cast("string"), g))
        gathered = own.join(whole, [*keys, "key"]).groupBy(*keys, g).agg(
            F.first("rows").alias("rows"), F.first("inverse").alias("inverse"),
            F.collect_list(F.struct("i", "c", "x", "drawn")).alias("parts"),  # z (p + 1 + PROBES)
        )

        def effects(batches: Iterator[pd.DataFrame], z: int = z) -> Iterator[pd.DataFrame]:
            for batch in batches:
                us, spreads, rest = [], [], []
                for parts, inv, beta, vcov in zip(batch["parts"], batch["inverse"], batch["beta"], batch["vcov"]):
                    y, v = np.zeros((z, p + 1 + PROBES)), np.zeros((z, p + 1 + PROBES))
                    for part in parts:
                        y[part["i"], part["c"]] = part["x"]
                        v[part["i"], part["c"]] = part["drawn"]
                    inv, vcov = np.asarray(inv, float).reshape(z, z), np.nan_to_num(np.asarray(vcov, float)).reshape(p, p)
                    us.append((y[:, p] - y[:, :p] @ np.asarray(beta, float)).tolist())
                    spread = inv + y[:, :p] @ vcov @ y[:, :p].T
                    probe = (y[:, p + 1 :] - inv @ v[:, p + 1 :]) @ v[:, p + 1 :].T / PROBES
                    spreads.append(spread.ravel().tolist())
                    rest.append((spread + (probe + probe.T) / 2).ravel().tolist())
                out = batch.drop(columns=["parts", "inverse", "beta", "vcov"])
                out["u"], out["spread"], out["full"] = us, spreads, rest
                yield out

        told = gathered.join(known.select(*keys, "beta", "vcov"), keys)
        named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in gathered.schema if f.name not in ("parts", "inverse"))
        found = cut(told.mapInPandas(effects, f"{named}, u array<double>, spread array<double>, full array<double>"))
        squares = [f"sum(u[{i}] * u[{j}])" for i in range(z) for j in range(z)]
        spread = [f"sum(full[{i}])" for i in range(z * z)]
        of = found.groupBy(*keys).agg(
            F.expr(f"array({', '.join([*squares, *spread, 'CAST(count(1) AS DOUBLE)'])})").alias("moments")
        ).withColumn("h", F.lit(h))
        moments = of if moments is None else moments.unionByName(of)
        rows = found.drop("full").withColumn("h", F.lit(h))
        levels = rows if levels is None else levels.unionByName(rows, allowMissingColumns=True)

    gathered = moments.groupBy(*keys).agg(F.collect_list(F.struct("h", "moments")).alias("moments"))
    olds = fits.select(*keys, *[F.col(c).alias(f"old_{c}") for c in ("beta", "g", "tau", "pi", "iterations")])

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gs, taus, pis, done = [], [], [], []
            for r in batch.to_dict("records"):
                by_group = {m["h"]: np.asarray(m["moments"], float) for m in r["moments"]}
                g = []
                for t, v in zip(layout.terms, layout.unpacked(r["old_g"])):
                    h = next(k for k, z in enumerate(layout.blocks) if t[0] in z)
                    z = len(layout.blocks[h])
                    own = np.ix_(*[[layout.blocks[h].index(c) for c in t]] * 2)
                    m = by_group[h]
                    squares, spread = m[: z * z].reshape(z, z)[own], m[z * z : 2 * z * z].reshape(z, z)[own]
                    g += updated(v, squares, spread, int(m[-1])).ravel().tolist()
                count, member, tau_1, tau_2, _ = np.asarray(r["v"], float)[p * p + p :]
                tau = tau_step(r["old_tau"], tau_1, tau_2) if overdispersed else r["old_tau"]
                pi = min(max(member / count, 1e-9), 1 - 1e-9) if inflated else r["old_pi"]
                old = {c: r[f"old_{c}"] for c in ("beta", "g", "tau", "pi")}
                gs.append(g)
                taus.append(tau)
                pis.append(pi)
                done.append(settled(old, r["beta"], g, tau, pi, tol))
            out = batch[[*keys, "rows", "beta", "vcov"]].copy()
            out["g"], out["tau"], out["pi"] = gs, taus, pis
            out["iterations"] = (batch["old_iterations"] + 1).astype("int32")
            out["converged"] = done
            yield out

    whole = known.join(gathered, keys).join(olds, keys)
    named = ", ".join(f"{c} {known.schema[c].dataType.simpleString()}" for c in [*keys, "rows", "beta", "vcov"])
    ended = cut(whole.mapInPandas(
        finished, f"{named}, g array<double>, tau double, pi double, iterations int, converged boolean"
    ))
    levels = levels.join(ended.select(*keys, "converged"), keys)
    return ended.withColumn("h", F.lit(-1)).unionByName(levels, allowMissingColumns=True)
