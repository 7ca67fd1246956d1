"""Plain versions of the corpus operators, row by row, over lists of (doc_id, text)."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
INF = float("inf")


def words(text):
    return WORD.findall(text or "")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n if doc_id is not None else 0


def measures(rows):
    out = []
    for d, t in rows:
        t = t or ""
        w = words(t)
        at = collections.defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i:i + 5])].append(i)
        cover = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = len(w)
        out.append((d, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)),
                    len(lines) - len(set(lines)), len(cover), n < 10 or 100 * len(cover) > 20 * n))
    return out


def substrings(rows):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            k = tuple(w[i:i + 13])
            first[k] = min(first.get(k, INF), INF if d is None else d)
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - 12):
            if first[tuple(w[i:i + 13])] < (INF if d is None else d):
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def decontamination(rows, items):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    phrases = {}
    for i, t in items:
        w = terms(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            phrases.setdefault(tuple(w[k:k + 10]), set()).add(i)
    sizes, out = {len(p) for p in phrases}, []
    for d, t in rows:
        w, hit, found = terms(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (ids := phrases.get(tuple(w[k:k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= ids
        found.discard(None)
        ids = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def classes(rows, threshold=0.8):
    """(doc_id, class_id, copy_id, n_links) of each row."""
    sets = []
    for _d, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    ids = [INF if d is None else d for d, _ in rows]
    kinds = {}
    for d, s in zip(ids, sets):
        if s is not None:
            kinds[s] = min(kinds.get(s, INF), d)
    keys = list(kinds)
    parent, links = {k: k for k in keys}, collections.Counter()

    def root(k):
        while parent[k] is not k:
            k = parent[k]
        return k

    holds = collections.defaultdict(list)
    for k, s in enumerate(keys):
        shared = collections.Counter(x for g in s for x in holds[g])
        for x, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(keys[x]) - n):
                links[s] += 1
                links[keys[x]] += 1
                a, b = root(s), root(keys[x])
                if a is not b:
                    parent[a] = b
        for g in s:
            holds[g].append(k)
    least = {}
    for k in keys:
        r = root(k)
        least[r] = min(least.get(r, INF), kinds[k])
    back = lambda v: None if v == INF else v
    return [(d, d, d, 0) if s is None else (d, back(least[root(s)]), back(kinds[s]), links[s])
            for (d, _), s in zip(rows, sets)]


def luhn(digits):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, digits[::-1]))) % 10 == 0


def personal(rows):
    """Base spans by the plain expressions."""
    out = []
    for d, t in rows:
        t = t or ""
        spans = [("email", *m.span()) for m in
                 re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
                  if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            x = re.sub(r"[^0-9]", "", m[0])
            if 13 <= len(x) <= 19 and luhn(x):
                spans.append(("card", *m.span()))
        spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
                  if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
        n = collections.Counter(k for k, _, _ in spans)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        out.append((d, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(text.encode()).hexdigest()))
    return out


def language_model(rows, train):
    """Per row: tokens, known tokens, base score and the bigram model's score; and N."""
    tokens = lambda t: words((t or "").translate(LOWER)) + [None]
    one, two = collections.Counter(), collections.Counter()
    for _d, t in train:
        w = tokens(t)
        one.update(w)
        two.update(zip(["<s>", *w[:-1]], w))
    total, kinds = sum(one.values()), len(one)

    def discounts(counts):
        n = collections.Counter(min(c, 5) for c in counts)
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        raw = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3])
        return [0, *(min(max(x, 0.01 * (k + 1)), k + 0.99) for k, x in enumerate(raw))]

    upper, before = discounts(two.values()), collections.Counter(w for _, w in two)
    lower, follow = discounts(before.values()), collections.defaultdict(collections.Counter)
    context = collections.Counter()
    for (u, _w), c in two.items():
        context[u] += c
        follow[u][min(c, 3)] += 1
    mass = sum(before.values())
    free = sum(lower[min(c, 3)] for c in before.values()) / mass if mass else 1.0
    q = lambda w: (before[w] - lower[min(before[w], 3)]) / max(mass, 1) + free / (kinds + 1)
    out = []
    for d, t in rows:
        w, base, score = tokens(t), 0.0, 0.0
        for u, x in zip(["<s>", *w[:-1]], w):
            base += math.log10((one[x] + 0.1) / (total + 0.1 * (kinds + 1)))
            c, p = two[u, x], q(x)
            if context[u]:
                p = (c - upper[min(c, 3)]) / context[u] + p * sum(
                    upper[k] * n for k, n in follow[u].items()) / context[u]
            score += math.log10(p)
        out.append((d, len(w), sum(one[x] > 0 for x in w), base, score))
    return out, total
