"""Hashed uniforms and binomial counts of many rows and draws at once, in numpy.

The numbers are those of ``hashed_uniform``: an MD5 over the row's text and the draw.
Here a step of the hash runs over thousands of them, which costs a tenth of one call each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_TURNS = np.tile(np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]])[:, None], (1, 4, 1)).ravel()
_SHIFTS, _BACK = _TURNS.astype(np.uint32), (32 - _TURNS).astype(np.uint32)
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_WORDS = np.concatenate([(m * np.arange(16) + c) % 16 for m, c in ((1, 0), (5, 1), (3, 5), (7, 0))])
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
#: Values per numpy step, so that the arrays of a step stay in the cache.
TILE = 16_384
#: Values of a batch that are worked on together.
VALUES = 262_144


def _md5_block(state: Sequence[np.ndarray], words: Sequence[np.ndarray], shape: tuple[int, int]) -> list[np.ndarray]:
    """The four state arrays after one block of 64 bytes. States and words have the given
    shape, or one column where all draws of a row share them."""
    a, b, c, d = (np.broadcast_to(x, shape).copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, words[_WORDS[i]] + _SINES[i], out=f)
        np.left_shift(f, _SHIFTS[i], out=t)
        np.right_shift(f, _BACK[i], out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        # the oldest of the four arrays takes the next value
        a, d, c, b, f = d, c, b, f, a
    return [x + y for x, y in zip(state, (a, b, c, d))]


def hashed_uniforms(texts: Sequence[str], draws: np.ndarray) -> np.ndarray:
    """(rows, draws) of ``hashed_uniform(text, draw)``.

    A text's whole blocks are hashed once; the block in which it ends is shared by its
    draws but for the words that hold the draw's digits.
    """
    heads = [(t + "|").encode() for t in texts]
    size = np.array([len(h) for h in heads])
    order = np.argsort(size % 64, kind="stable")
    size, whole = size[order], size[order] // 64
    heads = [heads[i] for i in order]
    states = np.repeat(_START[:, None], len(heads), axis=1)[:, :, None]
    for at in range(int(whole.max(initial=0))):
        on = np.flatnonzero(whole > at)
        block = np.frombuffer(b"".join(heads[i][64 * at : 64 * at + 64] for i in on), "<u4").reshape(-1, 16)
        states[:, on] = _md5_block(states[:, on], block.T[:, :, None], (len(on), 1))
    tails = b"".join(h[64 * w :].ljust(64, b"\0") for h, w in zip(heads, whole))
    words = np.frombuffer(tails, "<u4").reshape(-1, 16).T[:, :, None]

    found = np.empty((len(texts), len(draws)))
    written = [str(x).encode() for x in draws.tolist()]
    digits, left = np.array([len(x) for x in written]), size % 64
    for q in np.unique(digits).tolist():
        columns = np.flatnonzero(digits == q)
        ends = {}  # the words of the digits and of the bit that ends a text, by its place
        for place in np.unique(left).tolist():
            text = b"".join((b"\0" * (place % 4) + written[i] + b"\x80").ljust(24, b"\0") for i in columns)
            ends[place] = np.frombuffer(text, "<u4").reshape(-1, 6).T
        one = int(np.searchsorted(left, 64 - 9 - q, "right"))  # the rows whose draw ends in one block
        for first, last, blocks in ((0, one, 1), (one, len(left), 2)):
            step = max(1, TILE // len(columns))
            for start in range(first, last, step):
                rows = slice(start, min(start + step, last))
                shape = (rows.stop - rows.start, len(columns))
                held = [*words[:, rows], *[np.zeros((shape[0], 1), np.uint32) for _ in range(8 + 16 * (blocks - 1))]]
                held[16 * blocks - 2] = (size[rows, None] + q).astype(np.uint32) * np.uint32(8)
                own = set()
                for place in np.unique(left[rows]).tolist():
                    at = slice(*np.searchsorted(left[rows], [place, place + 1]))
                    for k, end in enumerate(ends[place][: (place % 4 + q + 4) // 4], place // 4):
                        if k not in own:
                            held[k] = np.broadcast_to(held[k], shape).copy()
                            own.add(k)
                        held[k][at] |= end
                state = list(states[:, rows])
                for k in range(blocks):
                    state = _md5_block(state, held[16 * k : 16 * k + 16], shape)
                high, low = (x.byteswap().astype(np.uint64) for x in state[:2])
                found[np.ix_(order[rows], columns)] = ((high << np.uint64(20)) | (low >> np.uint64(12))) / 2.0**52
    return found


def binomial_counts(p: np.ndarray, of: np.ndarray, u: np.ndarray, n: int) -> np.ndarray:
    """(rows, draws) counts of ``n`` trials by inverse CDF: the number of values below n
    whose CDF is at most u. Row i has the probabilities ``p[of[i]]``, whose terms are worked
    out once for all their rows. Terms are summed in logarithms, and a p above one half is
    turned round. The steps end where every CDF has passed its u."""
    turned = p > 0.5
    small, large = np.where(turned, 1 - p, p), np.where(turned, p, 1 - p)
    passed = np.zeros(u.shape, np.int32)
    w = np.where(turned[of], 1 - u, u)
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log(small / large)
        log_term = n * np.log1p(-small)
        cdf = np.exp(log_term)
        for j in range(1, n + 1):
            # a turned CDF has to be below w, any other at most w
            below = np.where(turned, np.nextafter(cdf, np.inf), cdf)[of] <= w
            if not below.any():
                break
            passed += below
            log_term += np.log((n - j + 1) / j) + odds
            cdf += np.exp(log_term)
    counts = np.where(turned[of], n - passed, passed)
    return np.where((p <= 0)[of], 0, np.where((p >= 1)[of], n, counts))


def simulated_counts(
    texts: Sequence[str], trials: np.ndarray, of: np.ndarray, ends: np.ndarray, draw: np.ndarray, p: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of rows, their counts by draw) until every row has had its turn.

    Row i belongs to record ``of[i]``, whose draws and probabilities lie before
    ``ends[of[i]]``. A row without trials counts 0.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    same: dict[bytes, int] = {}  # records with the same draws
    kind = np.array([same.setdefault(draw[a:b].tobytes(), len(same)) for a, b in zip(starts, ends)], np.int64)[of]
    order = np.lexsort((of, trials, kind))
    for key, first, last in zip(same, *(np.searchsorted(kind[order], range(len(same)), side) for side in ("left", "right"))):
        draws = np.frombuffer(key, draw.dtype)
        step = max(1, VALUES // max(1, len(draws)))
        for at in range(first, last, step):
            rows = order[at : min(at + step, last)]
            y = np.zeros((len(rows), len(draws)), np.int32)
            busy = np.flatnonzero(trials[rows] > 0)
            u = hashed_uniforms([texts[i] for i in rows[busy]], draws)
            tile = max(1, TILE // max(1, len(draws)))
            for n in np.unique(trials[rows[busy]]).tolist():
                low, high = np.searchsorted(trials[rows[busy]], [n, n + 1])
                for i in range(low, high, tile):
                    some = slice(i, min(i + tile, high))
                    records, shared = np.unique(of[rows[busy[some]]], return_inverse=True)
                    chance = p[starts[records][:, None] + np.arange(len(draws))]
                    y[busy[some]] = binomial_counts(chance, shared, u[some], n)
            yield rows, y
