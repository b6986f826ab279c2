"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORD3 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    chars = "".join(words)
    return len(words), len(chars), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def contamination(text, items):
    words = re.findall(WORD3, lower(text))
    hit, found = set(), set()
    for item_id, item in items:
        own = re.findall(WORD3, lower(item))
        if not own or item_id is None:
            continue
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item_id))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def repeats(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha256 of what is kept) of each row of (doc_id, text), in order of id (null first) and hash of the text."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xxhash64(r[1] or ""))):
        raw = (text or "").encode()
        mark = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                mark[i : i + length] = True
            seen.add(window)
        kept = bytes(b for b, m in zip(raw, mark, strict=False) if not m)
        spans = int((mark[:-1] & ~np.r_[False, mark[:-2]]).sum()) if len(raw) else 0
        out.append((doc_id, len(raw), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def xxhash64(text):
    """As the engine's function of this name."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def simhash(text):
    words = lower(text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    """Smallest row reachable from each row."""
    fps = np.array(prints, np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]
