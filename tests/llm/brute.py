"""The contracts in plain Python, for small tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


VOWELS = ["a", "e", "io", "ou"]


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice(VOWELS) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words).capitalize()


def words(text):
    return WORD.findall(text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _passes(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def spans(text) -> list[tuple[int, int, str]]:
    order = list(KINDS)
    found = [
        (m.start(), order.index(k), m.end())
        for k, p in KINDS.items()
        for m in re.finditer(p, text or "")
        if _passes(k, m.group())
    ]
    return [(a, e, order[k]) for a, k, e in sorted(found)]


def shingles(text) -> frozenset:
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(w) < 5:
        return frozenset({tuple(w)}) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def link_components(rows) -> list[tuple]:
    """(doc_id, set size, component) of rows (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)].append(doc)
    return [(d, len(s), min(low[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def without_repeats(rows, length=20) -> list[tuple]:
    """(doc_id, words, removed, hash of the rest) of rows (doc_id, text); ids must differ."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w, gone = words(text), set()
        for i in range(len(w) - length + 1):
            window = tuple(w[i : i + length])
            if window in seen:
                gone.update(range(i, i + length))
            seen.add(window)
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def rule_counts(text) -> tuple[int, int, int, int, int]:
    w, seen, repeated = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            inside.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(inside)


def shares(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Target of each source; ``None`` is last."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            open_.discard(s)
        left = float(sum(sizes.values())) - sum(out.values())
    return out
