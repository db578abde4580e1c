"""Plain versions of what the operators compute, for small inputs."""
from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def repeats(docs: list[tuple[int | None, str | None]], window: int = 50) -> dict[tuple, tuple[int, int, str]]:
    first: dict[tuple, int] = {}
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in words:
        for i in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = {}
    for (d, w), (_, t) in zip(words, docs, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d, t] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingle_set(text: str | None, k: int = 5) -> set[tuple[str, ...]]:
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def jaccard_components(docs: list[tuple[int, str | None]], percent: int = 80) -> dict[int, tuple[int, int]]:
    sets = {d: shingle_set(t) for d, t in docs}
    comp = {d: d for d in sets}

    def top(x: int) -> int:
        while comp[x] != x:
            x = comp[x]
        return x

    have: dict[tuple, list[int]] = {}
    for d, s in sets.items():
        for g in s:
            have.setdefault(g, []).append(d)
    seen = set()
    for ds in have.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    n = len(sets[a] & sets[b])
                    if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                        x, y = sorted((top(a), top(b)))
                        comp[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


BASE = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]


def base_licenses(text: str | None) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = [(i, label) for label, phrase in BASE for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))
