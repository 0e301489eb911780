"""Plain re-statements of what the operators return, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def substring(docs: list[tuple], window: int = 35) -> list[tuple]:
    words = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), sha(kept.encode())))
    return out


def suffix(docs: list[tuple], window: int = 50) -> list[tuple]:
    data = [(d, (t or "").encode()) for d, t in docs]
    big = float("inf")
    least: dict[bytes, float] = {}
    for d, b in data:
        for i in range(len(b) - window + 1):
            s = b[i : i + window]
            least[s] = min(least.get(s, big), big if d is None else d)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if least[b[i : i + window]] < (big if d is None else d):
                gone[i : i + window] = b"\1" * window
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def find(links: list[tuple], nodes) -> dict:
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def simhash(docs: list[tuple], radius: int = 2) -> list[tuple]:
    import xxhash

    prints = []
    for _, t in docs:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    near = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    roots = find(near, range(len(docs)))
    least = defaultdict(list)
    for i, r in roots.items():
        least[r].append(docs[i][0])
    first = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return [(d, f"{p:016x}", first[roots[i]]) for i, ((d, _), p) in enumerate(zip(docs, prints, strict=True))]


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def spans(text: str | None) -> list[tuple[int, int, str, int]]:
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def pii(docs: list[tuple]) -> list[tuple]:
    out = []
    for d, t in docs:
        s = spans(t)
        kinds = Counter(x[2] for x in s)
        out.append((d, *[kinds[k] for k, _ in PATTERNS], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in s).encode())))
    return out


def rules(docs: list[tuple]) -> list[tuple]:
    out = []
    for d, t in docs:
        text = t or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(wins)
        gone = [False] * len(w)
        for i, x in enumerate(wins):
            if n[x] > 1:
                gone[i : i + 8] = [True] * 8
        failed = len(w) < 20 or 100 * sum(gone) > 30 * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(gone), failed))
    return out


def vectors(rows: list[tuple], cosine: float = 0.95) -> list[tuple]:
    import math

    import numpy as np

    unit = []
    for _, v in rows:
        ok = v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
        a = np.array(v, np.float64) if ok else None
        unit.append(a / np.sqrt((a * a).sum()) if ok else None)
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine
    ]
    degree = Counter(x for p in links for x in p)
    roots = find(links, range(len(rows)))
    first: dict = {}
    for i, r in roots.items():
        d = rows[i][0]
        first[r] = d if first.get(r) is None else min(first[r], d) if d is not None else first[r]
    return [(d, degree[i], first[roots[i]]) for i, (d, _) in enumerate(rows)]


def near_texts(texts: list, width: int = 5, tenths: int = 8) -> tuple[list[tuple[int, int]], int]:
    """Pairs of places whose sets of word shingles have a Jaccard similarity of tenths / 10, and how many of unequal sets."""
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    near = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= tenths * len(sets[i] | sets[j]) > 0
    ]
    return near, sum(sets[i] != sets[j] for i, j in near)
