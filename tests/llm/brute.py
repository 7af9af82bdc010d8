"""Plain versions of the contracts, for small tables."""

import hashlib
import math
import re
import zlib

import numpy as np

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def jaccard(docs):
    """doc_id -> (n_shingles, component_id)"""
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[a:a + 5]) for a in range(len(w) - 4)])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def exact(docs):
    """doc_id -> (keep_id, group_size, kept, text_sha256), for distinct ids"""
    groups = {}
    for i, text in docs:
        groups.setdefault(_SPACE.sub(" ", text or ""), []).append(i)
    return {i: (min(v), len(v), i == min(v), sha(k)) for k, v in groups.items() for i in v}


_SECRETS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def secrets(text):
    spans, n = [], []
    for place, (kind, pattern, ok) in enumerate(_SECRETS):
        found = [m for m in pattern.finditer(text or "") if ok(m)]
        n.append(len(found))
        spans += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in found]
    return (*n, ",".join(x[2] for x in sorted(spans)))


def contamination(docs, items):
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)"""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in items:
        w = word.findall((text or "").translate(_LOW))
        size = min(13, len(w))
        for a in range(len(w) - size + 1 if w else 0):
            windows.setdefault(size, {}).setdefault(tuple(w[a:a + size]), set()).add(item)
    out = {}
    for i, text in docs:
        w, hit, found = word.findall((text or "").translate(_LOW)), set(), set()
        for size, known in windows.items():
            for a in range(len(w) - size + 1):
                ids = known.get(tuple(w[a:a + size]))
                if ids:
                    found |= ids
                    hit.update(range(a, a + size))
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def repeats(docs, length=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), for distinct ids"""
    seen, out = set(), {}
    for i, text in sorted(docs):
        b = (text or "").encode()
        mark = bytearray(len(b))
        own = set()
        for a in range(len(b) - length + 1):
            w = b[a:a + length]
            if w in seen:
                mark[a:a + length] = b"\1" * length
            own.add(w)
        seen |= own
        runs = sum(1 for a, m in enumerate(mark) if m and (a == 0 or not mark[a - 1]))
        out[i] = (len(b), sum(mark), runs, sha(bytes(x for x, m in zip(b, mark) if not m)))
    return out


def _luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s):
    return re.sub("[^0-9]", "", s)


_PERSONAL = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 16 <= len(_digits(m[0])) <= 19 and _luhn(_digits(m[0]))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(_digits(m[0])) <= 15)]


def personal(text):
    spans, n = [], []
    for kind, pattern, ok in _PERSONAL:
        found = [m for m in pattern.finditer(text or "") if ok(m)]
        n.append(len(found))
        spans += [f"{kind}:{m.start()}:{m.end()}" for m in found]
    return (*n, ",".join(spans))


def manifest(rows):
    """rows of (doc_id, source, lang, n_chars, text) -> sorted list of
    (doc_id, leaf, subroot, root, proof, folded, verified)"""
    def leaf(*values):
        parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
        return sha("".join(parts))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    def path(tree, at):
        found = []
        for level in tree[:-1]:
            low = at - at % 16
            found.append((level[low:at], level[at + 1:low + 16]))
            at //= 16
        return found
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda x: x[:3])
        trees[s] = levels([x[2] for x in sources[s]])
    top = levels([trees[s][-1][0] for s in order])
    result = []
    for k, s in enumerate(order):
        for at, (_, _, own, r) in enumerate(sources[s]):
            steps = path(trees[s], at) + path(top, k)
            proof = sha("".join(d for a, b in steps for d in a + b))
            cur = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                cur = leaf(*r[:4], None if r[4] is None else r[4].translate(_LOW))
            for a, b in steps:
                cur = sha("".join(a) + cur + "".join(b))
            result.append((r[0], own, trees[s][-1][0], top[-1][0], proof, cur, cur == top[-1][0]))
    return sorted(result, key=str)


def collocations(rows, least=100, first=2000):
    """rows of (lang, text) -> list of (lang, rank, phrase, a, l, r, n, score)"""
    counts, total = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, {})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] = total.get(lang, 0) + len(w)
            for k in range(1, 6):
                for a in range(len(w) - k + 1):
                    p = tuple(w[a:a + k])
                    f[p] = f.get(p, 0) + 1
    out = []
    for lang, f in counts.items():
        n, covered, found = total.get(lang, 0), {}, []
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i:i + k]] = max(covered.get(p[i:i + k], 0), a)
        for p, a in cand.items():
            if 100 * covered.get(p, 0) >= 100 * a:
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def neighbours(rows, least=0.95):
    """rows of (vec_id, vector) -> vec_id -> (n_links, component_id, kept)"""
    def good(v):
        return v is not None and None not in v and all(math.isfinite(x) for x in v) and any(v)
    ids = [i for i, v in rows if good(v)]
    unit = np.array([v for _, v in rows if good(v)], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None] if len(unit) else 1
    root, links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    close = unit @ unit.T >= least if len(unit) else np.zeros((0, 0), bool)
    for a, b in zip(*np.nonzero(np.triu(close, 1))):
        links[ids[a]] += 1
        links[ids[b]] += 1
        x, y = find(ids[a]), find(ids[b])
        root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i, _ in rows}
