"""Plain versions of the operators, for small tables."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def grams(t, k):
    w = WORD.findall(low(t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near(rows, k, num, den):
    """rows (id, text) -> sorted (id, set size, smallest id of the component)."""
    sets = [grams(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and both * den >= len(a | sets[j]) * num:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (x, _) in enumerate(rows):
        if x is not None:
            least[find(i)].append(x)
    return sorted(((x, len(sets[i]), min(least[find(i)], default=None)) for i, (x, _) in enumerate(rows)), key=str)


def windows(docs, items, size=8):
    """docs (id, text), items (id, text) -> (id, words, words hit, item ids)."""
    win = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t or ""))
        for a in range(max(1, len(w) - size + 1) if w else 0):
            win[tuple(w[a : a + size])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w = ALNUM.findall(low(t or ""))
        hit, ids = set(), set()
        for n in {len(x) for x in win}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in win:
                    hit.update(range(a, a + n))
                    ids |= win[tuple(w[a : a + n])]
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def boilerplate(rows, ratio, least):
    """rows (host, text) -> texts without the lines that too many texts of the host hold."""
    trim = lambda x: x.strip(" \t\n\x0b\x0c\r")
    pages = defaultdict(set)
    for h, t in rows:
        if h is not None and t:
            pages[h].add(t)
    bad = set()
    for h, texts in pages.items():
        c = Counter(x for t in texts for x in {trim(x) for x in t.split("\n")} if x)
        bad |= {(h, x) for x, n in c.items() if n >= least and n > ratio * len(texts)}
    return [t if t is None else "\n".join(x for x in t.split("\n") if (h, trim(x)) not in bad) for h, t in rows]


def depleted(rows, limit, least_left):
    """rows (host, text) -> (words outside lines that more than `limit` distinct texts of the host hold, kept)."""
    norm = lambda x: " ".join(WORD.findall(re.sub("[0-9]+", "0", low(x))))
    held = defaultdict(set)
    for h, t in rows:
        for x in (t or "").split("\n"):
            held[h, norm(x)].add(t)
    out = []
    for h, t in rows:
        f = figures(t)
        left = f[0] - sum(len(WORD.findall(x)) for x in (t or "").split("\n") if len(held[h, norm(x)]) > limit)
        out.append((left, f[0] >= 10 and 100 * f[4] <= 20 * f[0] and left >= least_left * f[0]))
    return out


def figures(t):
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)
