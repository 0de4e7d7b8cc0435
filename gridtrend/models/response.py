"""What a row of counts says about its linear predictor.

A row has ``k`` successes of ``n``, stands for ``m`` equal rows, and has a linear
predictor ``eta``. Its log-likelihood may have two more parts: a normal effect of the row
itself (overdispersion, standard deviation ``tau``), which is integrated out over fixed
nodes inside the row, and a probability ``1 - pi`` that the row is 0 whatever its
predictor (zero inflation). No part needs a table of row effects.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes of the Gauss-Hermite rule, and where a predictor is cut off.
NODES = 21
ETA_LIMIT = 30.0


def nodes(n: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights that integrate against the standard normal density."""
    z, w = np.polynomial.hermite_e.hermegauss(n)
    return z, w / w.sum()


def _array(values) -> str:
    return f"array({', '.join(f'{float(v)!r}D' for v in values)})"


def _sum(parts: str) -> str:
    """SQL sum over the nodes of an expression in the node's number ``i``."""
    return f"aggregate(transform(sequence(0, size(__z) - 1), i -> {parts}), 0D, (a, b) -> a + b)"


def with_terms(at: DataFrame, overdispersed: bool, inflated: bool) -> DataFrame:
    """Add ``score`` and ``curve`` (first and minus second derivative by eta), ``member``
    (probability that the row is not an always-zero), and what the other parameters need:
    ``tau_1`` and ``tau_2`` (derivatives by tau), ``observed``, ``eta_pi`` and ``pi_pi``
    (second derivatives with the membership summed out). All are times ``m``.

    ``curve`` takes the membership as known, so it is never negative; ``observed`` is the
    curvature of the likelihood itself.
    """
    none = {c: F.lit(0.0) for c in ("tau_1", "tau_2", "eta_pi", "pi_pi")}
    bounded = at.withColumn("eta", F.expr(f"greatest(least(eta, {ETA_LIMIT}D), -{ETA_LIMIT}D)"))
    if not overdispersed and not inflated:
        out = bounded.withColumn("mu", F.expr("1 / (1 + exp(-eta))")).withColumns(
            {"score": F.expr("m * (k - n * mu)"), "curve": F.expr("m * n * mu * (1 - mu)"), "member": F.col("m")}
        )
        return out.withColumns({"observed": F.col("curve"), **none}).drop("mu")
    z, w = nodes() if overdispersed else (np.zeros(1), np.ones(1))
    sd = "tau" if overdispersed else "0D"
    inside = "k > 0" if inflated else "true"
    return (
        bounded.withColumns({"__z": F.expr(_array(z)), "__w": F.expr(_array(np.log(w)))})
        .withColumn("__e", F.expr(f"transform(__z, z -> greatest(least(eta + {sd} * z, 700D), -700D))"))
        .withColumn("__p", F.expr("transform(__e, e -> 1 / (1 + exp(-e)))"))
        .withColumn(
            "__l",
            F.expr(
                "transform(__e, (e, i) -> __w[i] - k * (greatest(-e, 0D) + log1p(exp(-abs(e))))"
                " - (n - k) * (greatest(e, 0D) + log1p(exp(-abs(e)))))"
            ),
        )
        .withColumn("__top", F.expr("array_max(__l)"))
        .withColumn("__f", F.expr("transform(__l, l -> exp(l - __top))"))
        .withColumn("__all", F.expr("aggregate(__f, 0D, (a, b) -> a + b)"))
        .withColumn("__like", F.expr("exp(__top) * __all"))
        .withColumn("__any", F.expr(f"IF({inside}, 1D, 1 - pi + pi * __like)"))
        .withColumn("__in", F.expr(f"IF({inside}, 1D, pi * __like / __any)"))
        .withColumn("__s", F.expr("transform(__p, p -> k - n * p)"))
        .withColumn("__s1", F.expr(_sum("__f[i] * __s[i]") + " / __all"))
        .withColumn("__s2", F.expr(_sum("__f[i] * __s[i] * __s[i]") + " / __all"))
        .withColumn("__c", F.expr(_sum("__f[i] * n * __p[i] * (1 - __p[i])") + " / __all"))
        .withColumn("__t1", F.expr(_sum("__f[i] * __z[i] * __s[i]") + " / __all"))
        .withColumn(
            "__t2",
            F.expr(
                _sum("__f[i] * __z[i] * __z[i] * (__s[i] * __s[i] - n * __p[i] * (1 - __p[i]))") + " / __all"
            ),
        )
        .withColumns(
            {
                "score": F.expr("m * __in * __s1"),
                "curve": F.expr("m * __in * greatest(__c - __s2 + __s1 * __s1, 0D)"),
                "member": F.expr("m * __in"),
                "tau_1": F.expr("m * __in * __t1"),
                "tau_2": F.expr("m * __in * (__t2 - __t1 * __t1)"),
                "observed": F.expr("m * (__in * (__c - __s2) + __in * __in * __s1 * __s1)"),
                "eta_pi": F.expr(f"IF({inside}, 0D, -m * __in * __s1 / (pi * __any))"),
                "pi_pi": F.expr(f"m * IF({inside}, 1 / (pi * pi), pow((__like - 1) / __any, 2))"),
            }
        )
        .drop(*[f"__{c}" for c in ("z", "w", "e", "p", "l", "top", "f", "all", "like", "any", "in", "s", "s1", "s2", "c", "t1", "t2")])
    )
