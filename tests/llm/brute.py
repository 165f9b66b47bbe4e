"""The quality rules and the pipeline from their definitions, in plain Python, for small fixtures."""

import math
import re
from collections import Counter

import xxhash

BIN = 0.001
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hash_of(value, seed=42):
    return xxhash.xxh64_intdigest(value if isinstance(value, bytes) else (value & (1 << 64) - 1).to_bytes(8, "little"), seed & (1 << 64) - 1)


def quality(rows, trusted):
    """(score(doc_id, text), threshold) of rows (doc_id, text) with trusted ids."""

    def buckets(text):
        hashed = [hash_of(w.encode()) for w in WORD.findall(text or "")]
        paired = [hash_of(b, hash_of(a)) for a, b in zip(hashed, hashed[1:])] + ([hash_of(hashed[-1])] if hashed else [])
        return [h % half for h in hashed] + [h % half + half for h in paired]

    def fold(doc_id):
        return 42 & 1 if doc_id is None else hash_of(doc_id) & 1

    chars = sum(len(t or "") for _, t in rows)
    half = max(1 << 14, 1 << (math.ceil(4 * math.sqrt(chars)) - 1).bit_length()) // 2
    n, own = Counter(), [Counter(), Counter()]
    for doc_id, text in rows:
        n.update(buckets(text))
        if doc_id in trusted:
            own[1 - fold(doc_id)].update(buckets(text))

    def score(doc_id, text):
        target, found = own[fold(doc_id)], buckets(text)
        total = 0
        for b in found:
            x = 32 * math.log(0.9 * target[b] / n[b] * sum(n.values()) / sum(target.values()) + 0.1)
            total += min(127, math.floor(abs(x) + 0.5) * (1 if x > 0 else -1))
        return total / 32 / len(found) if found else None

    scores = sorted(score(i, t) for i, t in rows if i in trusted and len(WORD.findall(t or "")) >= 50)
    bins = Counter(math.floor(s / BIN) for s in scores)

    def quantile(q):
        seen = 0
        for at in sorted(bins):
            seen += bins[at]
            if seen >= q * len(scores):
                return (at + 0.5) * BIN

    return score, quantile(0.5) - 2 * max(quantile(0.5) - quantile(0.05), BIN)


def base_failed(text):
    words = WORD.findall(text or "")
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k in range(len(words) - 2) for d in range(3) if seen[tuple(words[k : k + 3])] > 1}
    return len(words) < 50 or 100 * len(covered) > 50 * len(words)


def fingerprint(text):
    words = [w.encode() for w in WORD.findall(text or "")]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def keep_one(rows):
    """Of rows (doc_id, text), the one with the least id of each set linked by 3 or fewer differing bits."""
    prints, of = [fingerprint(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((root(i), root(j)), key=lambda x: rows[x][0])
                of[b] = a
    return [r for i, r in enumerate(rows) if root(i) == i]


def without_passages(rows):
    """rows (doc_id, text), by id, less each run of 50 words or more that an earlier text has as it is; texts without words left go."""
    seen, out = [], []
    for doc_id, text in sorted(rows):
        words = [w.lower() for w in WORD.findall(text or "")]
        gone = set()
        for other in seen:
            known = {}
            for j in range(len(other) - 49):
                known.setdefault(tuple(other[j : j + 50]), j)
            for i in range(len(words) - 49):
                if tuple(words[i : i + 50]) in known:
                    gone.update(range(i, i + 50))
        seen.append(words)
        pieces = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
        kept = re.match(r"[\x20\x09-\x0D]*", text).group() + "".join(p for k, p in enumerate(pieces) if k not in gone)
        if WORD.search(kept) or not gone:
            out.append((doc_id, kept))
    return out
