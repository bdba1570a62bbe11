"""Plain Python versions of what the training-data operators compute."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(t):
    return WORD.findall(t or "")


def quality(t):
    t = t or ""
    w, seen, dup = words(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(cover)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(t):
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    kind = ("assign", "access", "hex")
    spans = ",".join(f"{kind[k]}:{a}:{b}" for a, k, b in sorted(found))
    return [sum(x[1] == k for x in found) for k in range(3)], hashlib.sha256(spans.encode()).hexdigest(), spans


def repeats(docs, window=50):
    """{(doc_id, text): (n_words, n_removed, sha256 of the rest)}."""
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            if d is not None and d < first.get(k, 1 << 62):
                first[k] = d
    out = {}
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        out[d, t] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def kmers(t, k=5):
    w = words((t or "").translate(LOWER))
    k = min(k, len(w))
    return [tuple(w[i:i + k]) for i in range(len(w) - k + 1)] if w else []


def classes(docs):
    """{doc_id: least doc_id of its near-duplicate class}; unique ids."""
    g = {d: kmers(t) for d, t in docs}
    count = {d: collections.Counter(x) for d, x in g.items()}
    up = {d: d for d in g}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(g)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            n = len(g[a]) + len(g[b])
            if not g[a] or not g[b] or 9 * min(len(g[a]), len(g[b])) < 4 * n:
                continue
            if 9 * sum((count[a] & count[b]).values()) >= 4 * n and (g[a] == g[b] or 9 * lcs(g[a], g[b]) >= 4 * n):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


ALNUM = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


def leaks(docs, items):
    """{(doc_id, item_id)}: a window of the item's size with weighted shingle similarity >= 0.8."""
    def shingles(w):
        return collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))

    out = set()
    size = {j: ALNUM.findall((t or "").translate(LOWER)) for j, t in items}
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        own = set(shingles(w))
        for j, it in size.items():
            b = shingles(it)
            if not own & set(b):
                continue
            n = min(len(it), len(w))
            for s in range(len(w) - n + 1):
                a = shingles(w[s:s + n])
                both = sum((a & b).values())
                if both >= 0.8 * (a.total() + b.total() - both):
                    out.add((d, j))
                    break
    return out


def alignment(text, a, b, a_bytes, b_bytes):
    """(n_a, n_b, n_groups, n_links, groups digest, links) by comparing byte ranges."""
    none = (0, 0, 0, 0, "", [])
    if not text:
        return none
    want = (" " + text).encode()
    a = a.encode(" " + text, add_special_tokens=False).ids
    b = b.encode(text, return_type=int)
    sides = []
    for ids, own in ((a, a_bytes), (b, b_bytes)):
        if b"".join(own[i] for i in ids) != want:
            return none
        at, spans = 0, []
        for i in ids:
            spans.append((at, at + len(own[i])))
            at += len(own[i])
        sides.append(spans)
    x, y = sides
    cuts, before, groups = sorted({e for _, e in x} & {e for _, e in y}), 0, []
    for c in cuts:
        groups.append("|".join(",".join(str(i) for i, (_, e) in zip(ids, s) if before < e <= c) for ids, s in ((a, x), (b, y))))
        before = c
    links = [(i, j) for i, (s, e) in zip(a, x) for j, (u, v) in zip(b, y) if s < v and u < e]
    return len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def merkle(rows, tampered):
    """Manifest rows of (doc_id, text, lang, source, n_chars), recursively."""
    def H(s):
        return hashlib.sha256(s.encode()).hexdigest()

    def leaf(r, text):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i: i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def path(tree, i):
        for nodes in tree[:-1]:
            a = i // 8 * 8
            yield "".join(nodes[a:i]), "".join(nodes[i + 1: a + 8])
            i //= 8

    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for group in by.values():
        group.sort(key=lambda x: x[:3])
    trees = [levels([x[2] for x in by[lang]]) for lang in langs]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, lang in enumerate(langs):
        for i, (_, _, h, r) in enumerate(by[lang]):
            sides = [*path(trees[k], i), *path(top, k)]
            node = leaf(r, r[1].translate(LOWER) if r[1] is not None and tampered(r[0]) else r[1])
            for left, right in sides:
                node = H(left + node + right)
            out.append((r[0], h, trees[k][-1][0], top[-1][0], H("".join(a + b for a, b in sides)), node, node == top[-1][0]))
    return out


def mixing_targets(size):
    """Target of every source by sharing and resharing, weights 5, 2, 1."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        left, w = sum(size.values()) - sum(fixed.values()), sum(weight[s] for s in order if s not in fixed)
        share = {s: left * weight[s] / w for s in order if s not in fixed}
        over = [s for s in share if share[s] > 3 * size[s]]
        if not over:
            return share | fixed
        fixed |= {s: 3 * size[s] for s in over}
