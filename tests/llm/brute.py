"""Plain sequential versions of the corpus operators, for small fixtures."""

from __future__ import annotations

import math
import re

import xxhash


def groups(n: int, links) -> list[int]:
    """The smallest index that each index can reach."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(rows: list[tuple[int, str | None]], bits: int = 4) -> dict[int, tuple[str, int]]:
    fps = [simhash(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits]
    found = groups(len(rows), near)
    least = {}
    for (key, _), g in zip(rows, found):
        least[g] = min(key, least.get(g, key))
    return {key: (f"{fp:016x}", least[g]) for (key, _), fp, g in zip(rows, fps, found)}


def cosine(a, b) -> float:
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
