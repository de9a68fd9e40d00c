"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib


def shingle_set(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def near(rows: list[tuple], k: int = 4, percent: int = 80) -> dict:
    """doc_id -> (n_shingles, component_id, kept); ids are distinct and not null."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders: dict = {}
    for i in ids:
        shared: dict = {}
        for s in sets[i]:
            for j in holders.setdefault(s, []):
                shared[j] = shared.get(j, 0) + 1
            holders[s].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
