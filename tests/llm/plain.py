"""Brute-force versions of the corpus operators, row by row in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    mark = set()
    for i in range(len(w) - 7):
        if count[tuple(w[i : i + 8])] > 1:
            mark.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(mark)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, n, len(w) < 20 or 100 * n > 30 * len(w)


def shares(text):
    """Top n-gram, duplicate n-gram and line shares, character by character."""
    text = text or ""
    w = WORD.findall(text)
    total = max(1, sum(map(len, w)))
    out = []
    for k in (2, 3, 4):
        at = defaultdict(list)
        for i in range(len(w) - k + 1):
            at[tuple(w[i : i + k])].append(i)
        best = 0
        for places in at.values():
            if len(places) > 1:
                best = max(best, sum(len(w[j]) for j in {i + d for i in places for d in range(k)}))
        out.append(best / total)
    for k in range(5, 11):
        count = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        mark = {i + d for i in range(len(w) - k + 1) if count[tuple(w[i : i + k])] > 1 for d in range(k)}
        out.append(sum(len(w[j]) for j in mark) / total)
    return out


def contamination(docs, bench):
    wins = defaultdict(set)
    for item, text in bench:
        w = ALNUM.findall(lower(text or ""))
        for i in range(max(1, len(w) - 12) if w else 0):
            wins[tuple(w[i : i + 13])].add(str(item))
    sizes = {len(k) for k in wins}
    for text in docs:
        w = ALNUM.findall(lower(text or ""))
        mark, items = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if found := wins.get(tuple(w[i : i + k])):
                    items |= found
                    mark.update(range(i, i + k))
        yield len(w), len(mark), len(items), sha(",".join(sorted(items))), bool(mark) and 20 * len(mark) >= len(w)


PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def pii(text):
    out = []
    for kind, p in PII.items():
        for m in p.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PII).index(s[0])))


def phrases(text):
    w, places, labels = ALNUM.findall(lower(text or "")), [], set()
    for phrase, label in {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)]) if w else frozenset()


def near_duplicates(rows):
    sets, parent = [(i, shingles(t)) for i, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 10 * min(len(x), len(y)) >= 9 * max(len(x), len(y)):
                k = len(x & y)
                if 100 * k >= 90 * (len(x) + len(y) - k):
                    parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(s), least[root(k)] if s else i) for k, (i, s) in enumerate(sets)]


def substrings(rows):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w, mark = WORD.findall(t or ""), set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                mark.update(range(j, j + 13))
        out.append((i, len(w), len(mark), sha(" ".join(x for j, x in enumerate(w) if j not in mark))))
    return out


def language_model(rows):
    tokens = lambda t: WORD.findall(lower(t or "")) + ["\n"]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c, pairs = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            k = tokens(t)
            c.update(k)
            pairs.update(zip([None, *k[:-1]], k, strict=True))
    n, v = sum(c.values()), len(c)

    def discount(counts):
        m = [sum(x == k for x in counts) for k in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1])
        return [0, 1 - 2 * y * m[1] / m[0], 2 - 3 * y * m[2] / m[1], 3 - 4 * y * m[3] / m[2]]

    cont = Counter(b for _, b in pairs)
    hi, lo, total = discount(pairs.values()), discount(cont.values()), len(pairs)
    stats = defaultdict(lambda: [0, 0, 0, 0])
    for (u, _), k in pairs.items():
        stats[u][0] += k
        stats[u][min(k, 3)] += 1
    rest = sum(lo[min(x, 3)] for x in cont.values()) / total
    for i, t in rows:
        k, s = tokens(t), 0.0
        for u, w in zip([None, *k[:-1]], k, strict=True):
            p = max(cont.get(w, 0) - lo[min(cont.get(w, 0), 3)], 0) / total + rest / (v + 1)
            if u in stats:
                z, x = stats[u], pairs.get((u, w), 0)
                p = max(x - hi[min(x, 3)], 0) / z[0] + sum(hi[j] * z[j] for j in (1, 2, 3)) / z[0] * p
            s += math.log10(p)
        yield i, held(i), len(k), sum(x in c for x in k), n, sum(math.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in k), s
