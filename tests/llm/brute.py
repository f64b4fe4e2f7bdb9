"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ne", "tu") for b in ("ra", "si", "po", "vel", "") for c in ("n", "th", "ra", "d", "st")]


def sentence(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) for _ in range(n))


def components(ids: list, links: list[tuple]) -> dict:
    """The smallest id reachable from each."""
    head = {i: i for i in ids}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def similar(a: set, b: set, percent: int) -> bool:
    common = len(a & b)
    return common > 0 and 100 * common >= percent * len(a | b)


def word_shingles(text: str | None, width: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) >= width:
        return frozenset(tuple(words[k:k + width]) for k in range(len(words) - width + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def pairs(items: list) -> list[tuple]:
    return [(a, b) for i, a in enumerate(items) for b in items[:i]]


def overlaps(texts: dict, items: dict, size: int = 13) -> dict:
    """Words, hit words and items found of each text."""
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    windows = {}
    for item, text in items.items():
        own = words(text)
        n = min(size, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            windows.setdefault(tuple(own[k:k + n]), set()).add(item)
    out = {}
    for doc, text in texts.items():
        own, hit, found = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                if tuple(own[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(own[k:k + n])]
        out[doc] = len(own), len(hit), found
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def personal_data(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out
