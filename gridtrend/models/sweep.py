"""Small symmetric systems by the sweep operator."""

from __future__ import annotations

import numpy as np

#: A column is a combination of those before it if less of its square is left.
ALIASED = 1e-11


def swept(matrix: np.ndarray, columns: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Generalised inverse of a symmetric matrix and which columns it could use.

    Columns enter in order; one that those before it determine stays out, and its row
    and column of the result are 0. Only the first ``columns`` may enter.
    """
    a = np.array(matrix, dtype=float)
    size = len(a)
    first = np.diag(a).copy()
    used = np.zeros(size, bool)
    for j in range(size if columns is None else columns):
        pivot = a[j, j]
        if not pivot > ALIASED * max(first[j], 1e-300):
            continue
        used[j] = True
        row = a[j].copy() / pivot
        a -= np.outer(a[:, j], row)
        a[j], a[:, j] = row, row
        a[j, j] = -1.0 / pivot
    inverse = np.zeros((size, size))
    inverse[np.ix_(used, used)] = -a[np.ix_(used, used)]
    return inverse, used
