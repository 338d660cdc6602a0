"""Bit-parallel edit distances over Python integers."""

from __future__ import annotations


def within(a: str, b: str, limit: int) -> int | None:
    """The edit distance of ``a`` and ``b`` if it is at most ``limit``, else None.

    Common ends are cut off; the rest is a banded bit-parallel computation (Hyyro 2003): a word holds the vertical
    differences of the 2 * limit + 1 cells around the diagonal, and moves down one row with each character.
    """
    if abs(len(a) - len(b)) > limit:
        return None
    if a == b:
        return 0
    n = min(len(a), len(b))
    s = _common(n, lambda k, j: a[k:j] == b[k:j])
    e = _common(n - s, lambda k, j: a[len(a) - j : len(a) - k] == b[len(b) - j : len(b) - k])
    a, b = a[s : len(a) - e], b[s : len(b) - e]
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if not m:
        return n
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    width = 2 * limit + 1
    mask, high = (1 << width) - 1, 1 << (width - 1)
    # before column j, bit k stands for row j + k - limit of the column before; column 0 counts up from row 1
    up, down, score = mask ^ ((1 << limit) - 1), 0, limit
    for j in range(1, n + 1):
        shift = j - limit - 1
        match = places.get(b[j - 1], 0)
        match = (match >> shift if shift >= 0 else match << -shift) & mask
        diagonal = ((((match & up) + up) ^ up) | match | down) & mask
        h_up = down | (mask & ~(diagonal | up))
        h_down = diagonal & up
        if not diagonal & high:
            score += 1
            if score > 3 * limit + 1:  # the walk up at the end takes off as much as the band is high, at most
                return None
        across = diagonal >> 1
        up = (h_down | (mask & ~(across | h_up))) & mask
        down = across & h_up
    # the score is that of row n + limit of the last column; walk up to row m
    for row in range(n + limit, m, -1):
        bit = 1 << (row - n - 1 + limit)
        score -= bool(up & bit) - bool(down & bit)
    return score if score <= limit else None


def _common(n: int, equal) -> int:
    """How many of ``n`` places agree from the start on, found by halving; ``equal`` compares places from one to another."""
    low, high = 0, n + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if equal(low, mid) else (low, mid)
    return low


def nearest(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end): the least edit distance of ``pattern`` to any substring of ``text``, and where the first such ends.

    Myers (1999), the pattern's column as one integer.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = mask, 0, m, m, 0
    get = places.get
    for j, c in enumerate(text, 1):
        match = get(c, 0)
        vertical = match | down
        diagonal = ((((match & up) + up) ^ up) | match) & mask
        h_up, h_down = down | (mask & ~(diagonal | up)), up & diagonal
        if h_up & high:
            score += 1
        elif h_down & high:
            score -= 1
        if score < best:
            best, end = score, j
        h_up, h_down = h_up << 1 & mask, h_down << 1 & mask
        up, down = h_down | (mask & ~(vertical | h_up)), h_up & vertical
    return best, end
