"""Anchors, suffix sorting and packing: numpy parts of the suffix-array dedup.

Everything here works on the bytes of one bounded block of text.
"""

from __future__ import annotations

import numpy as np

#: Bytes of an anchor's gram, and most windows that an anchor can own.
GRAM = 20
MOST_WINDOWS = 63
PLACE_BITS = 20
HASH_BITS = 64 - PLACE_BITS
#: Places hashed at a time: few enough for the arrays of a step to stay in the cache.
TILE = 1 << 16
PAD = 64
#: Bytes up to which suffixes are sorted word by word; longer ones by hashes of pieces.
SPELT = 1024
PRIME, BASE = (1 << 31) - 1, 911_382_323


def mixed(x: np.ndarray) -> np.ndarray:
    y = x >> np.uint64(31)
    y ^= x
    y *= np.uint64(0x9E3779B97F4A7C15)
    t = y >> np.uint64(29)
    y ^= t
    y *= np.uint64(0xD6E8FEB86659FD93)
    np.right_shift(y, np.uint64(32), out=t)
    y ^= t
    return y


def words8(text: np.ndarray) -> np.ndarray:
    """The big-endian 8-byte word that starts at every byte but the last seven."""
    y = text[:-1].astype(np.uint16)
    y <<= np.uint16(8)
    y |= text[1:]
    x = y[:-2].astype(np.uint32)
    x <<= np.uint32(16)
    x |= y[2:]
    w = x[:-4].astype(np.uint64)
    w <<= np.uint64(32)
    w |= x[4:]
    return w


def word_offsets(length: int) -> tuple[list[int], int]:
    """Where words lie that cover ``length`` bytes, and bits to drop from a short one."""
    if length < 8:
        return [0], 8 * (8 - length)
    return [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])], 0


def hashed(words: np.ndarray, length: int, n: int) -> np.ndarray:
    """Hash of the ``length`` bytes at each of the first ``n`` places."""
    offsets, drop = word_offsets(length)
    words = mixed(words >> np.uint64(drop) if drop else words)
    factor = 0xFF51AFD7ED558CCD
    h = words[:n] * np.uint64(factor)
    part = np.empty_like(h)
    for o in offsets[1:]:
        factor = factor * 0xC4CEB9FE1A85EC53 % (1 << 64)
        h += np.multiply(words[o : o + n], np.uint64(factor), out=part)
    return h


def gram_of(length: int) -> int:
    return max(min(GRAM, length), length - MOST_WINDOWS + 1)


def runs(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Windows of ``length`` bytes by their anchor: (first window, windows, anchor, hash).

    ``text`` is the rows' bytes end to end, then padding; ``ends`` is where each row
    ends. A window's anchor is the first of its grams with the smallest hash. That
    depends on the window's bytes only, so equal windows have the same anchor in the
    same place. Consecutive windows of a row with one anchor are one run. No window
    crosses a row's end.
    """
    gram = gram_of(length)
    grams = length - gram + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    long = ends - starts >= length
    total = int(ends[-1]) if len(ends) else 0
    open_ = np.zeros(total + 1, np.int8)
    open_[starts[long]] += 1
    open_[ends[long] - length + 1] -= 1
    inside = np.cumsum(open_, dtype=np.int8).view(bool)
    place_mask = np.uint64((1 << PLACE_BITS) - 1)
    numbers = np.arange(min(TILE, total) + grams, dtype=np.uint64)
    out = []
    for at in range(0, total, TILE):
        n = min(TILE, total - at)
        valid = inside[at : at + n]
        if not valid.any():
            continue
        places = n + grams - 1
        low = hashed(words8(text[at : at + places + gram + 8]), gram, places)
        low &= ~place_mask
        low |= numbers[:places]
        span, other = 1, np.empty_like(low)
        while span < grams:
            step = min(span, grams - span)
            size = len(low) - step
            low, other = np.minimum(low[:-step], low[step:], out=other[:size]), low
            span += step
        change = low[1:] != low[:-1]
        first = valid.copy()
        first[1:] &= change | ~valid[:-1]
        last = valid.copy()
        last[:-1] &= change | ~valid[1:]
        f, l = np.flatnonzero(first), np.flatnonzero(last)
        chosen = low[f]
        anchor = (chosen & place_mask).astype(np.int64)
        out.append((f + at, l - f + 1, anchor + at, chosen >> np.uint64(PLACE_BITS)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


# Packing: sorted numbers as differences, byte planes apart, so that a shuffle's
# compression finds the empty ones.


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(b: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(b, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(flat.T).reshape(-1).view(kind)


def pack(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=np.uint64(0)))


def unpack(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, np.uint64), dtype=np.uint64)


# Suffix sort


class Pieces:
    """Hashes of all substrings whose length is a power of two, by doubling: a
    polynomial modulo a prime. Two suffixes are compared piece by piece, the longest
    first, with two look-ups for each length."""

    def __init__(self, text: np.ndarray, length: int):
        self.text, self.length = text, length
        self.levels = [text.astype(np.uint32) % np.uint32(PRIME)]
        power = BASE % PRIME
        for k in range(length.bit_length() - 1):
            low = self.levels[-1]
            high = low.astype(np.uint64)
            high *= np.uint64(power)
            high[: len(text) - (1 << k)] += low[1 << k :]
            high -= high // np.uint64(PRIME) * np.uint64(PRIME)  # faster than a remainder
            self.levels.append(high.astype(np.uint32))
            power = power * power % PRIME

    def compare(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Sign of suffix s against suffix t over ``length`` bytes: the common
        extension is found by binary search over hashes, and the next byte decides."""
        common = np.zeros(len(s), np.int64)
        for k in reversed(range(len(self.levels))):
            level, step = self.levels[k], 1 << k
            equal = level.take(s + common) == level.take(t + common)
            equal &= common <= self.length - step
            common += equal * np.int64(step)
        sign = np.sign(self.text.take(s + common).astype(np.int16) - self.text.take(t + common).astype(np.int16))
        return np.where(common < self.length, sign, 0).astype(np.int8)


def adjacent(words: np.ndarray, s: np.ndarray, t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(equal, in order) of pairs of suffixes s before t, by their bytes."""
    offsets, drop = word_offsets(length)
    equal, ordered = np.ones(len(s), bool), np.ones(len(s), bool)
    for o in offsets:
        a, b = words[s + o] >> np.uint64(drop), words[t + o] >> np.uint64(drop)
        ordered &= ~equal | (a <= b)
        equal &= a == b
    return equal, ordered


def suffix_sort(text: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes, within their groups, by their first ``length`` bytes.

    Returns the order, and whether each sorted suffix is equal to the one before and
    of its group. ``text`` has PAD bytes behind the last suffix.
    """
    bits = np.uint64(len(group).bit_length())
    if len(group) and int(group.max()) >> (64 - int(bits)) == 0:  # faster than sorting the places
        keys = np.sort((group << bits) | np.arange(len(group), dtype=np.uint64))
        order, g = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), keys >> bits
    else:
        order = np.argsort(group, kind="stable")
        g = group[order]
    same = np.zeros(len(order), bool)
    same[1:] = g[1:] == g[:-1]
    return (sorted_by_words if length <= SPELT else sorted_by_pieces)(text, at, order, same, length)


def sorted_by_words(text, at, order, same, length):
    """All groups at once, a word of eight bytes at a time: only suffixes equal so far
    to a neighbour are looked at, and only groups found out of order are moved."""
    words = words8(text)
    offsets, drop = word_offsets(length)
    tied = same.copy()
    tied[:-1] |= same[1:]
    act = np.flatnonzero(tied)
    pick, inner = order[act], same[act]
    place = at[pick]
    for o in offsets:
        if not len(act):
            break
        w = words[place + o]
        if drop:
            w >>= np.uint64(drop)
        behind = inner[1:] & (w[1:] < w[:-1])
        if behind.any():
            part = np.cumsum(~inner)
            moved = np.zeros(part[-1] + 1, bool)
            moved[part[1:][behind]] = True
            i = np.flatnonzero(moved[part])
            j = i[np.lexsort((w[i], part[i]))]
            w[i], pick[i], place[i] = w[j], pick[j], place[j]
            order[act[i]] = pick[i]
        split = inner[1:] & (w[1:] != w[:-1])
        if split.any():
            inner[1:] &= ~split
            same[act] = inner
            tied = inner.copy()
            tied[:-1] |= inner[1:]
            act, pick, place, inner = act[tied], pick[tied], place[tied], inner[tied]
    return order, same


def sorted_by_pieces(text, at, order, same, length):
    """A merge sort, bottom up, of all groups at once: in each pass a suffix finds its
    place in the sibling run by binary search with hashed comparisons. At the end every
    neighbouring pair is compared by its bytes; a group that a hash collision has left
    out of order, or with two suffixes at one place, is sorted by its bytes."""
    if not len(order):
        return order, same
    heads = np.flatnonzero(~same)
    sizes = np.diff(np.append(heads, len(order)))
    first, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    local = np.arange(len(order)) - first
    hashes, width, members = Pieces(text, length), 1, order
    while True:
        act = np.flatnonzero(size > width)
        if not len(act):
            break
        q, base, whole = local[act], first[act], size[act]
        block = q // (2 * width) * (2 * width)
        left = q - block < width
        middle = np.minimum(block + width, whole)
        low = np.where(left, middle, block)
        high = np.where(left, np.minimum(block + 2 * width, whole), middle)
        a, b, own = low.copy(), high.copy(), at[order[act]]
        while True:
            go = np.flatnonzero(a < b)
            if not len(go):
                break
            m = (a[go] + b[go]) // 2
            sign = hashes.compare(own[go], at[order[base[go] + m]])
            up = (sign > 0) | ((sign == 0) & ~left[go])
            a[go], b[go] = np.where(up, m + 1, a[go]), np.where(up, b[go], m)
        place = base + block + np.where(left, q - block, q - block - width) + a - low
        following = order.copy()
        following[place] = order[act]
        order, width = following, width * 2
    words = words8(text)
    inner = np.flatnonzero(local > 0)
    equal, ordered = adjacent(words, at[order[inner - 1]], at[order[inner]], length)
    twice = np.bincount(order, minlength=len(order))[order] > 1
    wrong = np.unique(np.concatenate([first[inner[~ordered]], first[twice]]))
    for head in wrong:
        part = members[head : head + size[head]]
        part = part[sorted(range(len(part)), key=lambda i: text[at[part[i]] : at[part[i]] + length].tobytes())]
        order[head : head + size[head]] = part
    if len(wrong):
        equal, _ = adjacent(words, at[order[inner - 1]], at[order[inner]], length)
    same = np.zeros(len(order), bool)
    same[inner] = equal
    return order, same
