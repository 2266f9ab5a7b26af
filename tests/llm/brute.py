"""Slow, plain versions of the operators."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash


def groups(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(rows):
    """rows: (doc_id, text) -> (fingerprint, component_id) of each."""
    fps = [fingerprint(t) for _, t in rows]
    root = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return [(f"{f:016x}", least[r]) for f, r in zip(fps, root)]


def without_repeats(rows, length=50):
    """rows: (doc_id, text) -> (n_bytes, n_removed, n_spans, sha256) of each."""
    first = {}
    raw = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, float("inf")), i)
    out = []
    for i, b in raw:
        mask = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                mask[k : k + length] = True
        mask = mask[:-1]
        spans = int((mask & ~np.concatenate([[False], mask[:-1]])).sum()) if len(b) else 0
        out.append((len(b), int(mask.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest()))
    return out


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def cosine_links(rows, least=0.9):
    """rows: (vec_id, vector) -> (n_links, component_id) of each."""
    ok = [usable(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if o else None for o, (_, v) in zip(ok, rows)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and unit[i] @ unit[j] >= least]
    n = np.bincount([i for l in links for i in l], minlength=len(rows))
    root = groups(len(rows), links)
    ids = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return [(int(k), ids[r]) for k, r in zip(n, root)]


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def rule_of(host, path, rules):
    found = None
    for r, v in rules:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (found is None or len(r) > len(found[0])):
            found = (r, v)
    return found or (None, None)


def unigram_tokens(word, scores, byte_score):
    """Pieces of the best segmentation, fewer of equals, over all segmentations by recursion on prefixes."""
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        size = len(word[i - 1].encode())
        options = [(best[i - 1][0] + size * byte_score, best[i - 1][1] + size)] if word[i - 1] not in scores else []
        options += [(best[j][0] + scores[word[j:i]], best[j][1] + 1) for j in range(i) if word[j:i] in scores]
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]
