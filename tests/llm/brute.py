"""Plain versions of the operators for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def sha(data):
    return hashlib.sha256(data).hexdigest()


def substring(docs, k=50):
    words = {i: WORD.findall(x or "") for i, x in docs}
    first = {}
    for i in sorted(words):
        for a in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][a : a + k]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for a in range(len(w) - k + 1):
            if first[tuple(w[a : a + k])] < i:
                gone.update(range(a, a + k))
        out[i] = (len(w), len(gone), " ".join(x for a, x in enumerate(w) if a not in gone))
    return out


def byte_repeats(docs, k=200):
    data = {i: (x or "").encode() for i, x in docs}
    n = Counter(d[a : a + k] for d in data.values() for a in range(len(d) - k + 1))
    out = {}
    for i, d in data.items():
        gone = [False] * (len(d) + 1)
        for a in range(len(d) - k + 1):
            if n[d[a : a + k]] > 1:
                gone[a : a + k] = [True] * k
        spans = sum(gone[a] and not (a and gone[a - 1]) for a in range(len(d)))
        kept = bytes(c for a, c in enumerate(d) if not gone[a])
        out[i] = (len(d), len(d) - len(kept), spans, sha(kept))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if w else frozenset()


def near(docs, percent):
    sets = {i: shingles(x) for i, x in docs}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    n = Counter(tuple(w[a : a + 8]) for a in range(len(w) - 7))
    rep = {b for a in range(len(w) - 7) if n[tuple(w[a : a + 8])] > 1 for b in range(a, a + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep)


def lm_base(docs):
    toks = {i: [*WORD.findall((x or "").translate(LOWER)), None] for i, x in docs}
    c = Counter(t for i, w in toks.items() if fold(i, 7) != 2 for t in w)
    total = sum(c.values())
    z = total + len(c) + 1
    return {i: (len(w), sum(c[t] > 0 for t in w), total, sum(math.log10((c[t] + 1) / z) for t in w)) for i, w in toks.items()}


def leaks(docs, items, least=0.8):
    words = lambda x: re.findall(r"[^\W_]+", (x or "").lower())
    grams = lambda w: Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4))
    known = [(i, len(words(x)), grams(words(x))) for i, x in items]
    where = defaultdict(set)
    for i, _, g in known:
        for s in g:
            where[s].add(i)
    by_id = {i: (n, g) for i, n, g in known}
    out = set()
    for d, x in docs:
        w = words(x)
        for i in {i for s in grams(w) for i in where.get(s, ())}:
            n, g = by_id[i]
            for a in range(max(1, len(w) - n + 1)):
                h = grams(w[a : a + n])
                both = sum((g & h).values())
                if both >= least * (sum(g.values()) + sum(h.values()) - both):
                    out.add((d, i))
                    break
    return out


def url(u, rules):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0].translate(LOWER)
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    fits = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict
