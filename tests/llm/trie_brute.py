"""A plain Python trie of rebuilt conversations, to test the Spark one against."""

import hashlib, re, zlib
from collections import defaultdict
W = re.compile(r"[^\x20\x09-\x0D]+")

def brute(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is None: continue
        convs[c].append((t, r or "", x or ""))
    for c in convs:
        convs[c].sort(key=lambda z: (z[0] is not None, z[0] if z[0] is not None else 0, z[1], z[2]))
        convs[c] = [(r, x) for _, r, x in convs[c]]
    rb = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        b = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rb[c] = tuple(convs.get(b, [])[:h] + ts[h:])
    nodes = defaultdict(list)
    for c, seq in rb.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    kids = defaultdict(int)
    for p in nodes:
        if p: kids[p[:-1]] += 1
    out = []
    for p, mem in nodes.items():
        sub = [q for q in nodes if q[: len(p)] == p]
        leaves = sum(1 for q in sub if kids[q] == 0)
        saved = sum((len(nodes[q]) - 1) * (len(W.findall(q[-1][1])) if q else 0) for q in sub)
        ends = sorted(c for c in mem if len(rb[c]) == len(p))
        out.append((min(mem), len(p), min(nodes[p[:-1]]) if p else None, len(mem), kids[p], leaves, saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))
