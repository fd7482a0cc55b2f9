"""Plain versions of the operators, for small data."""

from __future__ import annotations

import hashlib
import re

import numpy as np

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def normalised(text):
    return hashlib.sha256(SPACE.sub(" ", text or "").encode()).hexdigest()


def simhash(text, words=3):
    import xxhash

    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = WORD.findall(lowered)
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict, radius=2) -> dict:
    """id -> smallest id reachable, for fingerprints by id."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def removed(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text which bytes go."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]] = seen.get(t[s : s + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = True
        out.append(gone)
    return out


def runs(gone: np.ndarray) -> int:
    return int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())


def url_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"(?s)[^/?#]*", rest)[0]
        path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1] + best[2], best[3] if best else default
