"""Plain versions of operators that several tests compare with."""

import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def shingles(t):
    w = words((t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} if w else set()


def kept_by_brute_force(rows):
    """Ids of the first (id, text) of each group linked by a similarity of 0.8."""
    found = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for j, y in enumerate(found):
        for i, x in enumerate(found[:j]):
            if x == y or (x and y and len(x & y) / len(x | y) >= 0.8):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {rows[i][0] for i in range(len(rows)) if top(i) == i}
