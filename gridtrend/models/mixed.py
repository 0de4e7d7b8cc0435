"""Binomial mixed models by penalised quasi-likelihood, one or many at once.

Breslow & Clayton (1993) working responses, with Schall (1991) variance updates. A random
term is an intercept, a slope, or an intercept and a slope that are correlated, of a
grouping column. Rows may be overdispersed and zero-inflated (see ``response``).
Estimates approximate a Laplace fit; they are not identical to one.

A pass over the data is one aggregation for all fits together: by fit, by fit and level
of each grouping column, and by fit and pair of levels of two grouping columns, the sums
of products that make up the normal equations. Fixed and all random effects are then
solved jointly, so the order of the terms changes nothing:

* fits of up to ``DENSE`` random effects are solved each in a task of its own;
* larger ones by conjugate gradients on the table of sums (``gradients``), where no task
  holds more than a level.

The counts never move between passes; the state is one written table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridtrend.models import gradients
from gridtrend.models.design import Design, factor_levels, treatment_design, variables
from gridtrend.models.grouped import square, upper_sums
from gridtrend.models.response import with_terms
from gridtrend.models.sweep import swept
from gridtrend.operators.groups import attach
from gridtrend.session import cut

#: Random effects of one fit up to which a task solves it, variance steps of a pass, and
#: the least variance (a term cannot come back from 0).
DENSE, INNER, LEAST_VARIANCE = 1_500, 60, 1e-6
#: Products of columns up to which they are summed column by column; beyond, only those of
#: columns that are not 0 in a row, as rows.
WIDE = 300
#: Share of a term's levels that has to be free for its variance to be told.
UNTOLD = 1e-6


@dataclass(frozen=True)
class Random:
    """Random intercept of ``group``, or a random slope of ``slope`` within it; with
    ``intercept`` both, and their correlation."""

    group: str
    slope: str | None = None
    intercept: bool = False

    @property
    def name(self) -> str:
        if self.slope is None:
            return self.group
        return f"1+{self.slope}|{self.group}" if self.intercept else f"{self.slope}|{self.group}"

    @property
    def parts(self) -> tuple[str, ...]:
        """Names of its effects."""
        if self.slope is None:
            return (self.group,)
        slope = f"{self.slope}|{self.group}"
        return (self.group, slope) if self.intercept else (slope,)

    @property
    def multipliers(self) -> tuple[str, ...]:
        slope = f"CAST(`{self.slope}` AS DOUBLE)"
        if self.slope is None:
            return ("1D",)
        return ("1D", slope) if self.intercept else (slope,)


@dataclass
class MixedFit:
    design: Design
    beta: np.ndarray
    vcov: np.ndarray
    variances: dict[str, float]
    effects: dict[str, DataFrame]
    iterations: int
    converged: bool
    correlations: dict[str, float] = field(default_factory=dict)
    overdispersion: float = 0.0
    inclusion: float = 1.0

    @property
    def names(self) -> tuple[str, ...]:
        return self.design.names

    @property
    def std_errors(self) -> np.ndarray:
        return np.sqrt(np.diag(self.vcov))


@dataclass
class Layout:
    """Where effects and parameters lie. ``p`` fixed columns; random column ``z`` of term
    ``terms[t]``; ``blocks[h]`` are the random columns of the h-th grouping column."""

    p: int
    terms: list[list[int]]
    blocks: list[list[int]]

    @property
    def q(self) -> int:
        return sum(map(len, self.blocks))

    def unpacked(self, g: Sequence[float]) -> list[np.ndarray]:
        out, at = [], 0
        for t in self.terms:
            size = len(t)
            out.append(np.array(g[at : at + size * size], float).reshape(size, size))
            at += size * size
        return out

    def precision(self, g: Sequence[float]) -> list[np.ndarray]:
        """Inverse covariance of the effects of a level, for each grouping column."""
        inverse = np.zeros((self.q, self.q))
        for t, v in zip(self.terms, self.unpacked(g)):
            inverse[np.ix_(t, t)] = np.linalg.inv(v)
        return [inverse[np.ix_(z, z)] for z in self.blocks]


def updated(v: np.ndarray, squares: np.ndarray, spread: np.ndarray, levels: int) -> np.ndarray:
    """Next covariance of a term from the sum of its effects' products and of their
    posterior covariances: Schall's step where it gives a covariance, else the EM step.
    Both have the same fixed point. A single variance that the fixed effects leave no
    freedom to tell is the least one."""
    size = len(v)
    free = levels * np.eye(size) - np.linalg.solve(v, spread)
    step = (squares + spread) / levels
    told = np.linalg.eigvals(free).real.min() > UNTOLD * levels
    if not told and size == 1:
        return np.full((1, 1), LEAST_VARIANCE)
    if told:
        schall = np.linalg.solve(free.T, squares)  # squares is symmetric
        schall = (schall + schall.T) / 2
        if np.linalg.eigvalsh(schall).min() > 0:
            step = schall
    values, vectors = np.linalg.eigh((step + step.T) / 2)
    return (vectors * np.maximum(values, LEAST_VARIANCE)) @ vectors.T


def moved(old: np.ndarray, new: np.ndarray, scale: float) -> float:
    return float(np.max(np.abs(new - old) / (np.abs(new) + scale), initial=0.0))


@dataclass
class _Problem:
    """Collapsed counts of all fits in plain columns: ``keys`` tell the fits, ``groups``
    the levels, x and z are the design, k successes of n in m equal rows."""

    data: DataFrame
    keys: list[str]
    groups: list[str]
    layout: Layout
    overdispersed: bool
    inflated: bool
    prior: float
    fits: int = 0
    levels: list[int] = field(default_factory=list)
    largest: int = 0

    def sums(self, state: DataFrame, observed: bool) -> DataFrame:
        """The sums of one pass at the estimates in ``state``, written.

        ``v`` holds, for a fit, the products of the fixed columns, their right hand sides
        and the totals of the row parameters; for a level, the products of its random with
        the fixed columns, with each other, and the right hand sides; for two levels, the
        products of their random columns. With ``observed`` the inclusion probability is
        one fixed column more, and products are those of the observed information.
        """
        keys, p, q = self.keys, self.layout.p, self.layout.q
        fits = state.filter("h = -1").select(*keys, "beta", "tau", "pi", "rows")
        at = attach(self.data, fits, keys, "rows", written=True, size=self.fits)
        at = at.filter("beta IS NOT NULL")
        eta = [f"beta[{i}] * x{i}" for i in range(p)]
        for h, g in enumerate(self.groups):
            of = state.filter(F.col("h") == h).select(*keys, g, F.col("u").alias(f"u{h}"), "rows")
            at = attach(at, of, [*keys, g], "rows", written=True, size=self.levels[h])
            eta += [f"u{h}[{j}] * z{z}" for j, z in enumerate(self.layout.blocks[h])]
        at = with_terms(at.withColumn("eta", F.expr(" + ".join(eta))), self.overdispersed, self.inflated)
        columns = [f"x{i}" for i in range(p)] + [f"z{j}" for j in range(q)]
        weight = "observed" if observed else "curve"
        right = "eta_pi" if observed else "curve * eta + score"
        together = [[*keys], *[[*keys, g] for g in self.groups]]
        together += [[*keys, a, b] for a, b in combinations(self.groups, 2)]
        every = at.select(*keys, *self.groups, *columns, "m", "member", "tau_1", "tau_2", "pi_pi",
                          F.expr(weight).alias("w"), F.expr(right).alias("r"))
        size = p + q
        if size * (size + 1) // 2 <= WIDE:
            summed = every.groupingSets([[F.col(c) for c in s] for s in together], *keys, *self.groups).agg(
                F.expr(upper_sums(columns, "w")).alias("a"),
                F.expr(f"array({', '.join(f'sum({c} * r)' for c in columns)})").alias("b"),
                F.expr("array(sum(m), sum(member), sum(tau_1), sum(tau_2), sum(pi_pi))").alias("totals"),
                F.count(F.lit(1)).alias("rows"),
            )
        else:
            summed = self._sparse(every, columns, together)
        written = cut(summed)

        def picked(places: list[int], of: str = "a"):
            return F.expr(f"transform(array({', '.join(map(str, places))}), i -> {of}[i])")

        def product(i: int, j: int) -> int:
            i, j = min(i, j), max(i, j)
            return i * size - i * (i - 1) // 2 + j - i

        fixed = picked([product(i, j) for i in range(p) for j in range(p)])
        v = F.when(
            F.expr(" AND ".join(f"{g} IS NULL" for g in self.groups)),
            F.concat(fixed, picked(list(range(p)), "b"), "totals"),
        )
        for h, g in enumerate(self.groups):
            z = [p + c for c in self.layout.blocks[h]]
            alone = " AND ".join(f"{o} IS {'NOT' if o == g else ''} NULL" for o in self.groups)
            own = [product(c, i) for c in z for i in range(p)] + [product(c, d) for c in z for d in z]
            v = v.when(F.expr(alone), F.concat(picked(own), picked(z, "b")))
        for (h, g), (k, o) in combinations(enumerate(self.groups), 2):
            both = [product(p + c, p + d) for c in self.layout.blocks[h] for d in self.layout.blocks[k]]
            v = v.when(F.expr(f"{g} IS NOT NULL AND {o} IS NOT NULL"), picked(both))
        return written.select(*keys, *self.groups, "rows", v.alias("v"))


    def _sparse(self, every: DataFrame, columns: list[str], together: list[list[str]]) -> DataFrame:
        """The same sums where most products are 0 (levels of factors): a row becomes one
        entry for each product that is not, and entries add up by their place."""
        size = len(columns)
        pairs, keys = size * (size + 1) // 2, [*self.keys, *self.groups]
        others = ["m", "member", "tau_1", "tau_2", "pi_pi", "1D"]
        entries = F.expr(f"""flatten(array(
            flatten(transform(nz, x -> transform(filter(nz, y -> y.i >= x.i), y -> named_struct(
              'place', x.i * {size} - x.i * (x.i - 1) div 2 + y.i - x.i, 's', w * x.v * y.v)))),
            transform(nz, x -> named_struct('place', CAST({pairs} + x.i AS BIGINT), 's', r * x.v)),
            array({', '.join(f"named_struct('place', {pairs + size + i}L, 's', {o})" for i, o in enumerate(others))})))""")
        held = F.expr(
            f"filter(transform(array({', '.join(columns)}), (v, i) -> named_struct('i', CAST(i AS BIGINT), 'v', v)), x -> x.v <> 0)"
        )
        long = every.withColumn("nz", held).select(*keys, F.explode(entries).alias("e")).select(*keys, "e.place", "e.s")
        by_place = long.groupingSets([[F.col(c) for c in (*s, "place")] for s in together], *keys, "place").agg(
            F.sum("s").alias("s")
        )
        whole = by_place.groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.struct("place", "s"))).alias("of")  # as many as there are products
        )

        def part(first: int, n: int) -> str:
            return f"transform(sequence({first}L, {first + n - 1}L), i -> coalesce(of[i], 0D))"

        return whole.select(
            *keys, F.expr(part(0, pairs)).alias("a"), F.expr(part(pairs, size)).alias("b"),
            F.expr(part(pairs + size, 5)).alias("totals"),
            F.expr(f"CAST(of[{pairs + size + 5}L] AS BIGINT)").alias("rows"),
        )


class _Sums:
    """The sums of one fit, assembled: products and right hand sides."""

    def __init__(self, rows: pd.DataFrame, groups: list[str], layout: Layout, extra: bool):
        p, self.layout = layout.p, layout
        known = rows[groups].notna().to_numpy()
        totals = rows[~known.any(axis=1)].iloc[0]
        v = np.asarray(totals["v"], float)
        self.rows = int(totals["rows"])
        self.xx, self.bx = v[: p * p].reshape(p, p), v[p * p : p * p + p]
        self.count, self.member, self.tau_1, self.tau_2, pi_pi = v[p * p + p :]
        self.tables, self.at, places, size = [], [], [], 0
        for h, g in enumerate(groups):
            one = rows[known[:, h] & (known.sum(axis=1) == 1)]
            self.tables.append(one)
            places.append({level: i for i, level in enumerate(one[g])})
            self.at.append(size + np.arange(len(one) * len(layout.blocks[h])).reshape(len(one), -1))
            size += self.at[-1].size
        self.zz, self.zx, self.bz = np.zeros((size, size)), np.zeros((size, p)), np.zeros(size)
        for h, one in enumerate(self.tables):
            z = len(layout.blocks[h])
            if not len(one):
                continue
            v = np.stack(one["v"].to_numpy()).astype(float)
            self.zx[self.at[h]] = v[:, : z * p].reshape(-1, z, p)
            self.zz[self.at[h][:, :, None], self.at[h][:, None, :]] = v[:, z * p : z * p + z * z].reshape(-1, z, z)
            self.bz[self.at[h]] = v[:, z * p + z * z :]
        for (h, g), (k, o) in combinations(enumerate(groups), 2):
            pair = rows[known[:, h] & known[:, k]]
            if len(pair):
                a = self.at[h][[places[h][x] for x in pair[g]]]
                b = self.at[k][[places[k][x] for x in pair[o]]]
                v = np.stack(pair["v"].to_numpy()).astype(float).reshape(len(pair), a.shape[1], b.shape[1])
                self.zz[a[:, :, None], b[:, None, :]] = v
                self.zz[b[:, :, None], a[:, None, :]] = v.transpose(0, 2, 1)
        if extra:  # the right hand sides are the inclusion probability's products
            self.xx = np.block([[self.xx, self.bx[:, None]], [self.bx[None, :], np.array([[pi_pi]])]])
            self.zx = np.column_stack([self.zx, self.bz])

    def solved(self, g: Sequence[float], prior: float) -> dict:
        """Fixed and random effects at given variances, with their joint covariance."""
        whole = self.zz.copy()
        for at, precision in zip(self.at, self.layout.precision(g)):
            whole[at[:, :, None], at[:, None, :]] += precision
        inner = np.linalg.inv(whole)
        y = inner @ self.zx
        ridge = np.zeros(len(self.xx))
        ridge[: self.layout.p] = prior
        vcov, used = swept(self.xx + np.diag(ridge) - self.zx.T @ y)
        if len(self.xx) == self.layout.p:
            beta = vcov @ (self.bx - y.T @ self.bz)
            u = inner @ self.bz - y @ beta
        else:
            beta = u = None
        return {"beta": beta, "u": u, "vcov": vcov, "used": used, "inner": inner, "y": y}

    def spread(self, s: dict, h: int) -> np.ndarray:
        """Covariance block of every level's effects, fixed effects being unknown."""
        at = self.at[h]
        y = s["y"][at]
        return s["inner"][at[:, :, None], at[:, None, :]] + y @ s["vcov"] @ y.transpose(0, 2, 1)


def _stepped(s: _Sums, prior: float, g: list[float], tol: float) -> tuple[dict, list[float]]:
    """Effects and variances at the weights of one pass, iterated to their fixed point."""
    layout = s.layout
    for _ in range(INNER):
        found = s.solved(g, prior)
        spreads = [s.spread(found, h) for h in range(len(s.at))]
        new = []
        for t, v in zip(layout.terms, layout.unpacked(g)):
            h = next(k for k, z in enumerate(layout.blocks) if t[0] in z)
            own = [layout.blocks[h].index(c) for c in t]
            u = found["u"][s.at[h][:, own]]
            spread = spreads[h][:, own][:, :, own].sum(axis=0)
            new += updated(v, u.T @ u, spread, len(u)).ravel().tolist()
        change = moved(np.array(g), np.array(new), 0.01)
        g = new
        if change < tol / 10:
            break
    found = s.solved(g, prior)
    found["spread"] = [s.spread(found, h) for h in range(len(s.at))]
    return found, g


def tau_step(tau: float, first: float, second: float) -> float:
    """Newton step of the logarithm of the overdispersion, at most a factor e."""
    slope, curve = tau * first, tau * tau * second + tau * first
    step = -slope / curve if curve < 0 else np.sign(slope) * 0.5
    return float(max(tau * np.exp(np.clip(step, -1.0, 1.0)), 1e-4))


def _state_schema(problem: _Problem) -> StructType:
    named = StructType([*problem.data.select(*problem.keys, *problem.groups).schema.fields])
    for name, kind in (
        ("h", "int"), ("rows", "bigint"), ("u", "array<double>"), ("spread", "array<double>"),
        ("beta", "array<double>"), ("vcov", "array<double>"), ("g", "array<double>"), ("tau", "double"),
        ("pi", "double"), ("iterations", "int"), ("converged", "boolean"),
    ):
        named = named.add(name, StructType.fromDDL(f"x {kind}")["x"].dataType)
    return named


def settled(old: dict, beta, g, tau: float, pi: float, tol: float) -> bool:
    """Whether a pass has changed nothing that matters."""
    return (
        moved(np.array(old["beta"], float), np.array(beta, float), 0.1) < tol
        and moved(np.array(old["g"], float), np.array(g, float), 0.01) < 10 * tol
        and abs(tau - old["tau"]) <= 10 * tol * (tau + 0.01)
        and abs(pi - old["pi"]) <= tol
    )


def _dense(problem: _Problem, observed: bool, tol: float) -> Callable:
    """Solver of the fits whose sums a task gets, one after the other."""
    keys, groups, layout = problem.keys, problem.groups, problem.layout
    overdispersed, inflated, prior = problem.overdispersed, problem.inflated, problem.prior
    schema = to_arrow_schema(_state_schema(problem))

    def one(rows: pd.DataFrame) -> pa.RecordBatch:
        old = rows[rows["beta"].notna()].iloc[0].to_dict()
        s = _Sums(rows, groups, layout, observed)
        p, tau, pi = layout.p, float(old["tau"]), float(old["pi"])
        if observed:
            found = s.solved(old["g"], prior)
            found["spread"] = [s.spread(found, h) for h in range(len(groups))]
            beta, g, done = np.array(old["beta"], float), old["g"], bool(old["converged"])
            u = None
        else:
            found, g = _stepped(s, prior, list(old["g"]), tol)
            beta, u = found["beta"], found["u"]
            tau = tau_step(tau, s.tau_1, s.tau_2) if overdispersed else tau
            pi = min(max(s.member / s.count, 1e-9), 1 - 1e-9) if inflated else pi
            done = settled(old, beta, g, tau, pi, tol)
        vcov = found["vcov"][:p, :p].copy()
        vcov[~found["used"][:p]] = np.nan
        vcov[:, ~found["used"][:p]] = np.nan
        state = {
            "h": -1, "rows": s.rows, "beta": beta.tolist(), "vcov": vcov.ravel().tolist(), "g": list(g),
            "tau": tau, "pi": pi, "iterations": int(old["iterations"]) + (not observed), "converged": done,
        }
        out = [state]
        for h, group in enumerate(groups):
            spread = found["spread"][h]
            for i, (level, n) in enumerate(zip(s.tables[h][group], s.tables[h]["rows"])):
                own = None if u is None else u[s.at[h][i]].tolist()
                out.append({group: level, "h": h, "rows": int(n), "u": own, "spread": spread[i].ravel().tolist(), "converged": done})
        told = {k: rows[k].iloc[0] for k in keys}
        return pa.RecordBatch.from_pylist([{**told, **row} for row in out], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            frame = batch.to_pandas(integer_object_nulls=True)
            new = frame[keys].ne(frame[keys].shift()).any(axis=1).to_numpy().nonzero()[0]
            for first, last in zip(new, [*new[1:], len(frame)]):
                piece = frame.iloc[first:last]
                if held and tuple(held[-1][keys].iloc[-1]) != tuple(piece[keys].iloc[0]):
                    yield one(pd.concat(held, ignore_index=True))
                    held = []
                held.append(piece)
        if held:
            yield one(pd.concat(held, ignore_index=True))

    return run


def _solved(problem: _Problem, sums: DataFrame, state: DataFrame, observed: bool, tol: float) -> DataFrame:
    """Next state of every fit in ``sums``."""
    keys = problem.keys
    fits = state.filter("h = -1").select(*keys, "beta", "g", "tau", "pi", "iterations", "converged")
    total = " AND ".join(f"{g} IS NULL" for g in problem.groups)
    if problem.largest > DENSE:
        return gradients.solved(problem, sums, fits, tol)
    told = sums.join(fits, keys).withColumn("beta", F.expr(f"IF({total}, beta, NULL)"))
    dealt = told.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_dense(problem, observed, tol), _state_schema(problem))


def _largest(problem: _Problem) -> int:
    """Most random effects of a fit."""
    parts = [
        problem.data.select(*problem.keys, g).distinct().groupBy(*problem.keys).agg(
            (F.count(F.lit(1)) * len(z)).alias("n")
        )
        for g, z in zip(problem.groups, problem.layout.blocks)
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy(*problem.keys).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0


def _prepared(
    df, by, k, n, terms, random, factors, prior_precision, overdispersed, zero_inflated
) -> tuple[_Problem, Design]:
    groups = list(dict.fromkeys(r.group for r in random))
    slopes = [r.slope for r in random if r.slope]
    columns = list(dict.fromkeys([*by, *variables(terms), *groups, *slopes]))
    frame = df.select(*columns, F.col(k).cast("double").alias("__k"), F.col(n).cast("double").alias("__n"))
    frame = frame.na.drop().filter("__n > 0")
    if overdispersed or zero_inflated:  # what a row tells depends on its own counts
        cells = frame.groupBy(*columns, "__k", "__n").agg(F.count(F.lit(1)).cast("double").alias("__m"))
    else:
        cells = frame.groupBy(*columns).agg(F.sum("__k").alias("__k"), F.sum("__n").alias("__n"))
        cells = cells.withColumn("__m", F.lit(1.0))
    cells = cut(cells)
    design = treatment_design(factor_levels(cells, factors), terms)
    multipliers, places = [], []
    for r in random:
        places.append(list(range(len(multipliers), len(multipliers) + len(r.multipliers))))
        multipliers += r.multipliers
    blocks = [[z for r, t in zip(random, places) if r.group == g for z in t] for g in groups]
    data = cells.select(
        *[F.col(b).alias(f"f{i}") for i, b in enumerate(by)],
        *([] if by else [F.lit(0).alias("f0")]),
        *[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)],
        F.col("__k").alias("k"), F.col("__n").alias("n"), F.col("__m").alias("m"),
        *[F.expr(c).alias(f"x{i}") for i, c in enumerate(design.columns)],
        *[F.expr(c).alias(f"z{i}") for i, c in enumerate(multipliers)],
    )
    keys, names = [f"f{i}" for i in range(max(1, len(by)))], [f"g{i}" for i in range(len(groups))]
    layout = Layout(len(design.columns), places, blocks)
    problem = _Problem(data, keys, names, layout, overdispersed, zero_inflated, prior_precision)
    return problem, design


def _start(problem: _Problem) -> DataFrame:
    """All fits at their overall proportion, without random effects."""
    keys, p = problem.keys, problem.layout.p
    identity = [np.eye(len(t)).ravel() for t in problem.layout.terms]
    g = f"array({', '.join(f'{float(x)!r}D' for x in np.concatenate(identity))})"
    share = "(sum(m * k) + 0.5) / (sum(m * n) + 1)"
    fits = problem.data.groupBy(*keys).agg(F.expr(share).alias("__p"), F.count(F.lit(1)).alias("rows")).selectExpr(
        *keys, *[f"CAST(NULL AS {problem.data.schema[c].dataType.simpleString()}) AS {c}" for c in problem.groups],
        "-1 AS h", "rows", "CAST(NULL AS array<double>) AS u", "CAST(NULL AS array<double>) AS spread",
        f"concat(array(ln(__p / (1 - __p))), array_repeat(0D, {p - 1})) AS beta",
        "CAST(NULL AS array<double>) AS vcov", f"{g} AS g",
        f"{0.5 if problem.overdispersed else 0.0}D AS tau", f"{0.9 if problem.inflated else 1.0}D AS pi",
        "0 AS iterations", "false AS converged",
    )
    state = fits
    for h, c in enumerate(problem.groups):
        level = problem.data.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("rows"))
        level = level.withColumns({
            "h": F.lit(h), "converged": F.lit(False),
            "u": F.expr(f"array_repeat(0D, {len(problem.layout.blocks[h])})"),
        })
        state = state.unionByName(level, allowMissingColumns=True)
    return state


def _iterated(problem: _Problem, max_iter: int, tol: float) -> DataFrame:
    """The state of all fits at their end."""
    state = cut(_start(problem))
    counts = {r["h"]: r["n"] for r in state.groupBy("h").agg(F.count(F.lit(1)).alias("n")).collect()}
    problem.fits = counts.get(-1, 0)
    problem.levels = [counts.get(h, 0) for h in range(len(problem.groups))]
    problem.largest = _largest(problem)
    for _ in range(max_iter if problem.fits else 0):
        open_ = state.filter("NOT converged")
        after = _solved(problem, problem.sums(open_, False), open_, False, tol)
        state = cut(after.unionByName(state.filter("converged")))
        if not state.filter("h = -1 AND NOT converged").take(1):
            break
    if problem.inflated and problem.fits and problem.largest <= DENSE:
        # errors from the observed information, inclusion probability and effects together
        known = state.select(*problem.keys, *problem.groups, "h", "u").withColumnRenamed("u", "__u")
        after = _solved(problem, problem.sums(state, True), state, True, tol)
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*problem.keys, *problem.groups, "h")]
        joined = after.alias("a").join(known.alias("b"), same)
        state = cut(joined.select(*[F.col("b.__u").alias("u") if c == "u" else F.col(f"a.{c}") for c in state.columns]))
    return state


def _effects(state: DataFrame, problem: _Problem, by: Sequence[str], random: Sequence[Random]) -> dict[str, DataFrame]:
    """By term: the fit's columns, the level, and effect and standard error of each part."""
    groups, out = list(dict.fromkeys(r.group for r in random)), {}
    for r, places in zip(random, problem.layout.terms):
        h = groups.index(r.group)
        block = problem.layout.blocks[h]
        columns = []
        for part, z in zip(r.parts, places):
            j = block.index(z)
            suffix = "" if len(places) == 1 else ("_intercept" if part == r.group else "_slope")
            columns += [
                F.expr(f"u[{j}]").alias(f"effect{suffix}"),
                F.expr(f"sqrt(spread[{j * len(block) + j}])").alias(f"std_error{suffix}"),
            ]
        out[r.name] = state.filter(F.col("h") == h).select(
            *[F.col(f"f{i}").alias(b) for i, b in enumerate(by)], F.col(f"g{h}").alias(r.group), *columns
        )
    return out


def fit_mixed(
    df: DataFrame,
    k: str,
    n: str,
    terms: Sequence[str],
    random: Sequence[Random],
    factors: Sequence[str] = (),
    prior_precision: float = 0.0,
    overdispersed: bool = False,
    zero_inflated: bool = False,
    max_iter: int = 100,
    tol: float = 1e-3,
) -> MixedFit:
    """``cbind(k, n - k) ~ terms + random``.

    ``prior_precision`` is a normal prior on every fixed effect (ridge): 0.001 gives the
    posterior mode under a variance-1000 prior. ``overdispersed`` adds a normal effect of
    every row, ``zero_inflated`` rows that are 0 whatever their predictor. Rows with a
    null in a column of the model, or without trials, take no part. A column that those
    before it determine has coefficient 0 and no standard error.
    """
    problem, design = _prepared(
        df, [], k, n, terms, random, factors, prior_precision, overdispersed, zero_inflated
    )
    state = _iterated(problem, max_iter, tol)
    fit = state.filter("h = -1").first()
    if fit is None:
        raise ValueError("no row has trials and all columns of the model")
    covariances = problem.layout.unpacked(fit["g"])
    variances, correlations = {}, {}
    for r, v in zip(random, covariances):
        variances |= {part: float(v[i, i]) for i, part in enumerate(r.parts)}
        if len(v) == 2:
            correlations[r.name] = float(v[0, 1] / np.sqrt(v[0, 0] * v[1, 1]))
    return MixedFit(
        design, np.array(fit["beta"]), np.array(fit["vcov"], float).reshape(problem.layout.p, -1), variances,
        _effects(state, problem, [], random), fit["iterations"], fit["converged"], correlations,
        fit["tau"], fit["pi"],
    )


@dataclass
class MixedFits:
    """Fits of many groups: ``coefficients`` (by, term, estimate, std_error, converged,
    iterations), ``variances`` (by, part, variance; correlations as ``name`` cor) and the
    random effects of each term."""

    design: Design
    coefficients: DataFrame
    variances: DataFrame
    effects: dict[str, DataFrame]


def fit_mixed_by(
    df: DataFrame,
    by: Sequence[str],
    k: str,
    n: str,
    terms: Sequence[str],
    random: Sequence[Random],
    factors: Sequence[str] = (),
    prior_precision: float = 0.0,
    overdispersed: bool = False,
    zero_inflated: bool = False,
    max_iter: int = 100,
    tol: float = 1e-3,
) -> MixedFits:
    """The same model in every group of ``by``, all in the same passes; a group that has
    converged takes no part in later ones. Columns that a group cannot tell apart are
    left out of its fit in order: their estimate and error are null."""
    by = list(by)
    problem, design = _prepared(
        df, by, k, n, terms, random, factors, prior_precision, overdispersed, zero_inflated
    )
    state = _iterated(problem, max_iter, tol)
    fits = state.filter("h = -1").select(*[F.col(f"f{i}").alias(b) for i, b in enumerate(by)],
                                         "beta", "vcov", "g", "tau", "pi", "iterations", "converged")
    p = problem.layout.p
    term = F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("term"),
            F.expr(f"IF(isnan(vcov[{i * p + i}]), NULL, beta[{i}])").alias("estimate"),
            F.expr(f"IF(isnan(vcov[{i * p + i}]), NULL, sqrt(vcov[{i * p + i}]))").alias("std_error"),
        )
        for i, name in enumerate(design.names)
    ])).alias("t")
    parts, at = [], 0
    for r in random:
        size = len(r.parts)
        for i, part in enumerate(r.parts):
            parts.append((part, f"g[{at + i * size + i}]"))
        if size == 2:
            parts.append((f"cor({r.name})", f"g[{at + 1}] / sqrt(g[{at}] * g[{at + 3}])"))
        at += size * size
    if overdispersed:
        parts.append(("row", "tau * tau"))
    if zero_inflated:
        parts.append(("inclusion", "pi"))
    value = F.explode(F.array(*[F.struct(F.lit(a).alias("part"), F.expr(e).alias("value")) for a, e in parts]))
    return MixedFits(
        design,
        fits.select(*by, "iterations", "converged", term).select(*by, "t.*", "iterations", "converged"),
        fits.select(*by, value.alias("v")).select(*by, "v.*"),
        _effects(state, problem, by, random),
    )
