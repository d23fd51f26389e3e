"""Plain versions of the operators, written from their definitions."""

import math
import re
from collections import Counter, defaultdict


def norm_words(text):
    return [w for w in (re.sub(r"[^\w]|_", "", t.lower()) for t in (text or "").split()) if w]


def tiles(item, doc, least):
    ma, mb, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best[2]:
                    best = (i, j, k)
        if best[2] < least:
            return out
        out.append(best)
        for x in range(best[2]):
            ma[best[0] + x] = mb[best[1] + x] = True


def dedup_lines(rows):
    """rows: (key, text) in order; returns text by position, None where a document goes."""
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    gone = defaultdict(set)
    for i in order:
        lines = [(n, t.strip(" ")) for n, t in enumerate((rows[i][1] or "").split("\n")) if t.strip(" ")]
        for a in range(max(len(lines) - 2, min(1, len(lines)))):
            w = tuple(t for _, t in lines[a : a + 3])
            if w in seen and seen[w] != (rows[i][0], lines[a][0]):
                gone[i] |= set(range(lines[a][0], lines[min(a + 2, len(lines) - 1)][0] + 1))
            else:
                seen[w] = (rows[i][0], lines[a][0])
    for i, (_, text) in enumerate(rows):
        if i not in gone:
            out.append(text)
            continue
        kept = [t for n, t in enumerate(text.split("\n")) if n not in gone[i]]
        out.append("\n".join(kept) if any(t.strip(" ") for t in kept) else None)
    return out


class KneserNey:
    """Modified Kneser-Ney over bytes, with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.levels = order, {order: Counter()}
        for t in texts:
            b = bytes(order - 1) + t
            for i in range(order - 1, len(b)):
                self.levels[order][b[i - order + 1 : i + 1]] += 1
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.cut, self.total, self.cuts = {}, {}, {}
        for k, grams in self.levels.items():
            n = [0] + [sum(c == i for c in grams.values()) for i in (1, 2, 3, 4)]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
            d = [0] + [max(0.0, i - (i + 1) * y * n[i + 1] / n[i]) if n[i] else 0.0 for i in (1, 2, 3)]
            self.cut[k] = d
            for g, c in grams.items():
                self.total[k, g[:-1]] = self.total.get((k, g[:-1]), 0) + c
                self.cuts[k, g[:-1]] = self.cuts.get((k, g[:-1]), 0) + d[min(c, 3)]

    def p(self, gram):
        if not gram:
            return 1 / 256
        k = len(gram)
        low = self.p(gram[1:])
        total = self.total.get((k, gram[:-1]), 0)
        if not total:
            return low
        c = self.levels[k].get(gram, 0)
        return (c - self.cut[k][min(c, 3)] if c else 0) / total + self.cuts[k, gram[:-1]] / total * low

    def score(self, text):
        b = bytes(self.order - 1) + text
        return -sum(math.log(self.p(b[i - self.order + 1 : i + 1])) for i in range(self.order - 1, len(b))) / len(text)

    def held(self, text):
        """The score where the text's own occurrences are taken out."""
        b = bytes(self.order - 1) + text
        each = [b[i - self.order + 1 : i + 1] for i in range(self.order - 1, len(b))]
        own, used = {self.order: Counter(each)}, {}
        for k in range(self.order, 0, -1):
            used[k] = Counter()
            for g, n in own[k].items():
                used[k][g[:-1]] += n
            own[k - 1] = Counter(g[1:] for g, n in own[k].items() if self.levels[k][g] == n)
        total = 0.0
        for g in each:
            while g and self.levels[len(g)][g] == own[len(g)][g]:
                key = len(g), g[:-1]
                if self.total[key] > used[len(g)][g[:-1]]:
                    total += math.log(self.cuts[key] / self.total[key]) if self.cuts[key] else -99.0
                g = g[1:]
            total += math.log(self.p(g))
        return -total / len(text)


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]
