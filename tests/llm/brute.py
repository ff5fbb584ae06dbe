"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import itertools
import re
import math
import zlib
from collections import Counter

import numpy as np
import xxhash

HEX, ACCESS = re.compile(r"[0-9a-f]+"), re.compile(r"AKIA[A-Z0-9]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(docs):
    prints = {}
    for i, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    ids = sorted(prints)
    fp = np.array([prints[i] for i in ids], np.uint64)
    near = np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    roots = components(ids, [(ids[a], ids[b]) for a, b in near if a < b])
    return {i: (f"{prints[i]:016x}", roots[i]) for i in ids}


def similar(docs, least=0.8):
    sets = {}
    for i, text in docs:
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    return components(sorted(sets), [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])])


def signature(words):
    """Two min-hashes of the three-word shingles, by hashes of our own."""
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    return tuple(min(zlib.crc32(x, seed) for x in shingles) for seed in (1, 2))


def importance_weights(docs, good, shrink, dead_zone, deviations):
    """{id: log importance weight} over distinct words and pairs of words; large groups of one signature count once."""
    grams, signs = {}, {}
    for i, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w, _ in _words(low)]
        grams[i] = (set(words), set(zip(words, words[1:])))
        signs.setdefault(signature(words), []).append(i)
    counted = set()
    for mine in signs.values():
        large = len(mine) >= max(2.0, 2 * len(docs) / len(good))
        counted |= {min(mine, key=lambda i: (i not in good, i))} if large else set(mine)
    out = dict.fromkeys(grams, 0.0)
    for kind in (0, 1):
        raw, target = Counter(), Counter()
        for i in counted:
            raw.update(grams[i][kind])
            target.update(grams[i][kind] if i in good else ())
        share = sum(target.values()) / sum(raw.values())
        ratio = {}
        for g, n in raw.items():
            r, expected = np.log((target[g] + shrink) / (n * share + shrink)), n * share
            if abs(r) > dead_zone and abs(expected - target[g]) > deviations * np.sqrt(expected + 1):
                ratio[g] = r
        for i, x in grams.items():
            out[i] += sum(ratio.get(g, 0.0) for g in x[kind])
    return out


def _words(text):
    """(word, kind) of runs of one kind: letters, digits and other scripts; other signs."""
    data = text.encode()
    kind = lambda c: 0 if chr(c) in " \t\n\r\x0b\x0c" else 1 if c >= 128 or chr(c).isalnum() else 2
    return [(bytes(x), k) for k, x in itertools.groupby(data, kind) if k]


def secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
    return [sum(x[1] == k for x in found) for k in range(3)], hashlib.sha256(joined.encode()).hexdigest()


def repeats(docs, length=100):
    """{id: (n_bytes, n_removed, n_spans, sha256)}."""
    seen, out = {}, {}
    for i, text in sorted((i, (t or "").encode()) for i, t in docs):
        gone = np.zeros(len(text) + 1, np.int64)
        for p in range(len(text) - length + 1):
            s = text[p : p + length]
            if seen.setdefault(s, (i, p)) != (i, p):
                gone[p] += 1
                gone[p + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(text, np.uint8)[~mask])
        out[i] = (len(text), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def patience(a, b):
    """Indices in ``a`` aligned with ``b``."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [0, *(i + 1 for i in patience(a[1:], b[1:]))]
    if a[-1] == b[-1]:
        return [*patience(a[:-1], b[:-1]), len(a) - 1]
    anchors = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    picked = [anchors[k] for k in line_dedup_runs([j for _, j in anchors])]
    out, i, j = [], 0, 0
    for x, y in picked:
        out += [i + k for k in patience(a[i:x], b[j:y])] + [x]
        i, j = x + 1, y + 1
    return out + ([i + k for k in patience(a[i:], b[j:])] if picked else [])


def line_dedup_runs(values):
    from quillgraph.llm.line_dedup import longest_increasing

    return longest_increasing(values)


def line_dedup(docs):
    """{id: lines kept} over all pairs, for lines of five words or more; documents left without any are not there."""
    out = {}
    for i, mine in docs:
        gone = set()
        for j, other in docs:
            if j < i:
                at = [k for k, x in enumerate(mine) if x in other]
                gone |= {at[k] for k in patience([mine[k] for k in at], [x for x in other if x in mine])}
        out[i] = [x for k, x in enumerate(mine) if k not in gone]
    return {i: x for i, x in out.items() if x}


def line_deletions(docs, least_words=5):
    """{id: numbers of the lines to delete} over all pairs of documents."""
    lines = {i: [(k, x.strip()) for k, x in enumerate((t or "").split("\n")) if x.strip()] for i, t in docs}
    sets = {i: {x for _, x in mine} for i, mine in lines.items()}
    out = {}
    for i, mine in lines.items():
        gone = set()
        for j in lines:
            if j < i and (both := sets[i] & sets[j]):
                at = [k for k, (_, x) in enumerate(mine) if x in both]
                gone |= {at[k] for k in patience([mine[k][1] for k in at], [x for _, x in lines[j] if x in both])}
        out[i] = set()
        for _, block in itertools.groupby(enumerate(sorted(gone)), lambda p: p[1] - p[0]):
            block = [p for _, p in block]
            if sum(len(mine[p][1].split()) for p in block) >= least_words:
                out[i] |= set(range(mine[block[0]][0], mine[block[-1]][0] + 1))
    return out


def tiles(item, doc, least):
    """Greedy tiling by trying every pair of places again after each tile."""
    in_item, in_doc, out = [False] * len(item), [w is None for w in doc], []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and not in_item[i + n] and not in_doc[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        i, j, n = best
        if n < least:
            return out
        in_item[i : i + n] = in_doc[j : j + n] = [True] * n
        out.append(best)


def embeddings(rows, threshold=0.93):
    """{id: (n_links, component)} for distinct ids."""
    ok = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    edges = []
    for label in {l for _, _, l in ok}:
        mine = [(i, v) for i, v, l in ok if l == label]
        m = np.stack([v / np.linalg.norm(v) for _, v in mine])
        edges += [(mine[a][0], mine[b][0]) for a, b in np.argwhere(m @ m.T >= threshold) if a < b]
    links = {i: 0 for i, _, _ in rows}
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    roots = components([i for i, _, _ in rows], edges)
    return {i: (links[i], roots[i]) for i, _, _ in rows}


def importance_sample(docs, labels, shrink, dead_zone, deviations, power, seed):
    """({id: log weight}, {id: key}, ids of the sample): Gumbel top-k of as many documents as reach the cut that separates the labelled ones best."""
    judged = {}
    for i, quality, toxic in labels:
        if quality is not None and toxic is not None:
            judged[i] = judged.get(i, True) and quality == 1 and toxic == 0
    good = {i for i, ok in judged.items() if ok}
    w = importance_weights(docs, good, shrink, dead_zone, deviations)
    keys = {}
    for i in w:
        first = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), seed=42)
        u = (xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed=first) % (1 << 52) + 0.5) / (1 << 52)
        keys[i] = w[i] - math.log(-math.log(u)) / power
    known = sorted({w[i] for i in judged if i in w})
    share = lambda cut, ok: sum(w[i] >= cut for i, g in judged.items() if g == ok and i in w) / max(1, sum(g == ok for i, g in judged.items() if i in w))
    cut = max(known, key=lambda c: (share(c, True) - share(c, False), c))
    k = sum(x >= cut for x in w.values())
    return w, keys, set(sorted(keys, key=lambda i: -keys[i])[:k])


def token_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(pieces, ids_of, most=4096):
    """pieces: rows with doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; the share of padding."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(ids_of)
    for d, ps in by_doc.items():
        at, ids = 0, ids_of[d]
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == crc(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    pad = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= most
        pad += 0 if at & (at - 1) == 0 else most - at
    return pad / (pad + sum(p["length"] for p in pieces))
