"""SQL of iterative fits, for the oracles: Newton's method for binomial models and
penalised quasi-likelihood with random intercepts and slopes, by recursive CTEs."""

from __future__ import annotations


def sweep(matrix: str, size: str, pivots: str) -> str:
    """The flat ``size`` x ``size`` list ``matrix`` swept on its first ``pivots`` columns.

    The inverse is then minus the upper left part, the solution is in the last column. A
    column that those before it determine is passed over: its row and column are 0.
    """
    at = f"((k[1] * {size} + k[1] + 1)::BIGINT)"
    here = "(e // {0}) = k[1] AND (e % {0}) = k[1]".format(size)
    edge = "(e // {0}) = k[1] OR (e % {0}) = k[1]".format(size)
    row = f"acc[((e // {size}) * {size} + k[1] + 1)::BIGINT]"
    column = f"acc[(k[1] * {size} + (e % {size}) + 1)::BIGINT]"
    return f"""list_reduce(
      list_transform(range({pivots}), lambda k: [k::DOUBLE]),
      lambda acc, k: CASE WHEN acc[{at}] > 1e-11 * greatest(({matrix})[{at}], 1e-300) THEN
        list_transform(range({size} * {size}), lambda e:
          CASE WHEN {here} THEN -1 / acc[{at}] WHEN {edge} THEN acc[e + 1] / acc[{at}]
               ELSE acc[e + 1] - {row} * {column} / acc[{at}] END)
        ELSE list_transform(acc, lambda x, e: CASE WHEN ((e - 1) // {size}) = k[1] OR ((e - 1) % {size}) = k[1] THEN 0 ELSE x END) END,
      {matrix})"""


def newton(cells: str, name: str = "fit", tol: float = 1e-8, most: int = 25) -> str:
    """CTE ``name`` (grp, beta, used, sw, dev, pearson, n, p): a binomial model per ``grp``.

    ``cells`` has grp, xs (design row), w, wy, wyy, saturated and n_rows. ``sw`` is the
    swept (p + 1) x (p + 1) matrix; ``dev`` and ``pearson`` are those before the last step.
    """
    size = "(p + 1)"
    return f"""{name} AS (
  WITH RECURSIVE it AS (
    SELECT grp, 0 AS step, list_concat([ln((sum(wy) + 0.5) / (sum(w) - sum(wy) + 0.5))],
             list_transform(range(any_value(len(xs)) - 1), lambda x: 0.0::DOUBLE)) AS beta,
           NULL::BOOLEAN[] AS used, 'inf'::DOUBLE AS dev, 'nan'::DOUBLE AS pearson, false AS done,
           NULL::DOUBLE[] AS sw, any_value(len(xs)) AS p, sum(n_rows)::BIGINT AS n
    FROM {cells} GROUP BY grp
    UNION ALL
    SELECT grp, step + 1,
           list_transform(range(p), lambda j: beta[j + 1]
             + CASE WHEN coalesce(used[j + 1], sw[j * {size} + j + 1] < 0) THEN sw[j * {size} + p + 1] ELSE 0 END),
           coalesce(used, list_transform(range(p), lambda j: sw[j * {size} + j + 1] < 0)),
           m[{size} * {size} + 1], m[{size} * {size} + 2],
           abs(m[{size} * {size} + 1] - dev) <= {tol} * (abs(m[{size} * {size} + 1]) + 0.1), sw, p, n
    FROM (SELECT * EXCLUDE (sw), {sweep('m', size, 'p')} AS sw FROM it JOIN (
      SELECT grp, list(s ORDER BY e) AS m FROM (
        SELECT grp, e, sum(s) AS s FROM (
          SELECT grp, unnest(part) AS s, generate_subscripts(part, 1) AS e FROM (
            SELECT grp, list_concat(
              list_transform(range({size} * {size}), lambda e: CASE
                WHEN used IS NOT NULL AND (coalesce(NOT used[e // {size} + 1], false)
                  OR coalesce(NOT used[e % {size} + 1], false)) THEN 0
                WHEN e = {size} * {size} - 1 THEN 0
                WHEN e % {size} = p THEN (wy - w * mu) * xs[e // {size} + 1]
                WHEN e // {size} = p THEN (wy - w * mu) * xs[e % {size} + 1]
                ELSE w * mu * (1 - mu) * xs[e // {size} + 1] * xs[e % {size} + 1] END),
              [2 * (saturated + wy * ln(1 + exp(-eta)) + (w - wy) * ln(1 + exp(eta))),
               (wyy - 2 * mu * wy + mu * mu * w) / (mu * (1 - mu))]) AS part
            FROM (SELECT *, 1 / (1 + exp(-eta)) AS mu FROM (
              SELECT it.*, xs, w, wy, wyy, saturated,
                     greatest(least(list_dot_product(xs, beta), 30), -30) AS eta
              FROM it JOIN {cells} c USING (grp) WHERE NOT done AND step < {most}))))
        GROUP BY grp, e) GROUP BY grp) USING (grp) WHERE NOT done AND step < {most}))
  SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY grp ORDER BY step DESC) = 1)"""


def collapsed(name: str, source: str, grp: str, xs: str, y: str, w: str) -> str:
    """CTE of the sums that ``newton`` needs, from rows of a proportion and its weight."""
    return f"""{name} AS (
  SELECT grp, xs, sum(w) AS w, sum(w * y) AS wy, sum(w * y * y) AS wyy,
         sum(w * (CASE WHEN y > 0 THEN y * ln(y) ELSE 0 END + CASE WHEN y < 1 THEN (1 - y) * ln(1 - y) ELSE 0 END))
           AS saturated, count(*) AS n_rows
  FROM (SELECT {grp} AS grp, {xs} AS xs, ({y})::DOUBLE AS y, ({w})::DOUBLE AS w FROM {source}) WHERE w > 0
  GROUP BY ALL)"""


def dummies(column: str, levels: str) -> str:
    """Treatment columns of a factor whose sorted levels are the list ``levels``."""
    return f"list_transform({levels}[2:], lambda l: ({column} = l)::INTEGER::DOUBLE)"


def crossed(*parts: str) -> str:
    """All products of the columns of two or three lists, the last running fastest."""
    out = parts[0]
    for p in parts[1:]:
        out = f"list_transform(range(len({out}) * len({p})), lambda z: ({out})[z // len({p}) + 1] * ({p})[z % len({p}) + 1])"
    return out


def variance(xs: str, sw: str = "sw", p: str = "p") -> str:
    """x'Vx for the design row ``xs`` from the swept matrix."""
    size = f"({p} + 1)"
    return (
        f"list_sum(list_transform(range({p} * {p}), lambda e: -least({sw}[(e // {p}) * {size} + (e // {p}) + 1], 0)"
        f" / nullif({sw}[(e // {p}) * {size} + (e // {p}) + 1], 0) * {sw}[(e // {p}) * {size} + e % {p} + 1]"
        f" * ({xs})[e // {p} + 1] * ({xs})[e % {p} + 1]))"
    )


def chi_square_tail(x: str, df: str) -> str:
    """Upper tail by Simpson's rule over the square root, where the density is smooth."""
    points = 2000
    rule = f"CASE WHEN i = 0 OR i = {points} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    y = f"(i * sqrt({x}) / {points})"
    area = (
        f"list_sum(list_transform(range(0, {points + 1}), lambda i: {rule}"
        f" * CASE WHEN i = 0 AND {df} = 1 THEN 1 WHEN i = 0 THEN 0 ELSE exp(({df} - 1) * ln({y}) - {y} * {y} / 2) END))"
    )
    return f"(1 - {area} * sqrt({x}) / {3 * points} * exp((1 - {df} / 2.0) * ln(2) - lgamma({df} / 2.0)))"


def f_tail(x: str, df1: str, df2: str) -> str:
    """Upper tail of the F distribution, likewise."""
    points = 2000
    rule = f"CASE WHEN i = 0 OR i = {points} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    y = f"(i * sqrt({x}) / {points})"
    density = f"exp(({df1} - 1) * ln({y}) - ({df1} + {df2}) / 2.0 * ln(1 + {df1} * {y} * {y} / {df2}))"
    area = (
        f"list_sum(list_transform(range(0, {points + 1}), lambda i: {rule}"
        f" * CASE WHEN i = 0 AND {df1} = 1 THEN 1 WHEN i = 0 THEN 0 ELSE {density} END))"
    )
    front = f"lgamma(({df1} + {df2}) / 2.0) - lgamma({df1} / 2.0) - lgamma({df2} / 2.0) + {df1} / 2.0 * ln({df1} / {df2}::DOUBLE)"
    return f"(1 - 2 * {area} * sqrt({x}) / {3 * points} * exp({front}))"


def mixed(rows: str, terms: int, prior: float = 0.0, name: str = "pql", steps: int = 30, start: float = 0.02) -> str:
    """CTE ``name`` (beta, u, g, sw, p, levels, term_of, n): a mixed model with
    independent terms by penalised quasi-likelihood.

    ``rows`` has xs, lev (a level name for each term), zs (its multiplier), k and n. Every
    step solves fixed and random effects jointly; variances take Schall's step, and each
    third time the limit that the last two steps point to.
    """
    size = "n"
    at = [f"(lv[{t}] - p + 1)" for t in range(1, terms + 1)]
    eta = " + ".join(["list_dot_product(xs, beta)", *[f"zs[{t}] * u[{a}]" for t, a in enumerate(at, 1)]])
    joins = " ".join(f"JOIN {name}_levels l{t} ON l{t}.t = {t} AND l{t}.level = r.lev[{t}]" for t in range(1, terms + 1))
    lv = ", ".join(f"l{t}.place + len(xs)" for t in range(1, terms + 1))
    last = f"(p + {terms})"
    whole = f"(p + {terms + 1})"
    free = """list_sum(list_transform(range(n - 1 - p), lambda j: CASE WHEN term_of[j + 1] = t + 1
          THEN 1 + sw[(p + j) * n + p + j + 1] / g[t + 1] ELSE 0 END))"""
    squares = """list_sum(list_transform(range(n - 1 - p), lambda j: CASE WHEN term_of[j + 1] = t + 1
          THEN sw[(p + j) * n + n] * sw[(p + j) * n + n] ELSE 0 END))"""
    size_of = "len(list_filter(term_of, lambda x: x = t + 1))"
    new = f"""list_transform(range({terms}), lambda t: CASE WHEN {free} > 1e-6 * {size_of}
        THEN greatest(1e-6, {squares} / {free}) ELSE 1e-6 END)"""
    ratio = "((ln(g0[t + 1]) - ln(g[t + 1])) / nullif(ln(g[t + 1]) - ln(before[t + 1]), 0))"
    limit = f"""CASE WHEN step % 3 = 2 AND step < {steps - 5} AND {ratio} > 0 AND {ratio} < 1.5 THEN
        greatest(1e-6, exp(ln(g0[t + 1]) + greatest(-3, least(3, (ln(g0[t + 1]) - ln(g[t + 1]))
          * CASE WHEN {ratio} < 0.999 THEN {ratio} / (1 - {ratio}) ELSE 1000 END)))) ELSE g0[t + 1] END"""
    return f"""{name}_levels AS MATERIALIZED (
  SELECT t, level, row_number() OVER (ORDER BY t, level) - 1 AS place FROM (
    SELECT DISTINCT generate_subscripts(lev, 1) AS t, unnest(lev) AS level FROM {rows})),
{name}_rows AS MATERIALIZED (
  SELECT xs, [{lv}]::BIGINT[] AS lv, zs, sum(k) AS k, sum(n) AS trials FROM {rows} r {joins} GROUP BY ALL),
{name} AS (
  WITH RECURSIVE it AS (
    SELECT 0 AS step, list_concat([ln((sum(k) + 0.5) / (sum(trials) - sum(k) + 0.5))],
             list_transform(range(any_value(len(xs)) - 1), lambda x: 0.0::DOUBLE)) AS beta,
           (SELECT list(0.0::DOUBLE) FROM {name}_levels) AS u,
           list_transform(range({terms}), lambda t: {start}::DOUBLE) AS g,
           list_transform(range({terms}), lambda t: {start}::DOUBLE) AS before, NULL::DOUBLE[] AS sw,
           any_value(len(xs)) AS p, any_value(len(xs)) + 1 + (SELECT count(*) FROM {name}_levels) AS n,
           (SELECT list(t ORDER BY place) FROM {name}_levels) AS term_of
    FROM {name}_rows
    UNION ALL
    SELECT step + 1, list_transform(range(p), lambda j: CASE WHEN sw[j * n + j + 1] < 0 THEN sw[j * n + n] ELSE 0 END),
           list_transform(range(n - 1 - p), lambda j: sw[(p + j) * n + n]),
           list_transform(range({terms}), lambda t: {limit}), g, sw, p, n, term_of
    FROM (SELECT *, {new} AS g0 FROM (
      SELECT step, p, n, term_of, g, before, {sweep('m', size, '(n - 1)')} AS sw FROM it, (
        SELECT list(s ORDER BY e) AS m FROM (
          SELECT e, sum(s) AS s FROM (
            SELECT unnest(parts).e AS e, unnest(parts).s AS s FROM (
              SELECT list_transform(range({whole} * {whole}), lambda q: {{
                  'e': spot[q // {whole} + 1] * n + spot[q % {whole} + 1],
                  's': CASE WHEN q = {whole} * {whole} - 1 THEN 0::DOUBLE
                       WHEN q // {whole} = {last} THEN r * vs[q % {whole} + 1]
                       WHEN q % {whole} = {last} THEN r * vs[q // {whole} + 1]
                       ELSE w * vs[q // {whole} + 1] * vs[q % {whole} + 1] END}}) AS parts
              FROM (SELECT *, list_concat(range(p), lv, [n - 1]) AS spot, list_concat(xs, zs, [0.0::DOUBLE]) AS vs,
                           trials * mu * (1 - mu) AS w, trials * mu * (1 - mu) * eta + k - trials * mu AS r
                    FROM (SELECT *, 1 / (1 + exp(-eta)) AS mu FROM (
                      SELECT it.*, xs, lv, zs, k, trials, {eta} AS eta FROM it, {name}_rows WHERE step < {steps})))
              UNION ALL
              SELECT list_transform(range(n * n), lambda e: {{'e': e, 's': CASE
                  WHEN e // n <> e % n OR e = n * n - 1 THEN 0::DOUBLE WHEN e // n < p THEN {prior}::DOUBLE
                  ELSE 1 / g[term_of[e // n - p + 1]] END}}) AS parts
              FROM it WHERE step < {steps}))
          GROUP BY e)) WHERE step < {steps})))
  SELECT * FROM it QUALIFY step = max(step) OVER ())"""
