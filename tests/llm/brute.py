"""Plain versions of the operators, for small inputs."""

import math
import re
from collections import Counter, defaultdict

SPACES = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, size):
    w = words((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def near_dup(docs, size=2, percent=80):
    """docs: [(doc_id, text)] with distinct ids. doc_id -> (n_shingles, component_id)."""
    sets = {i: shingles(t, size) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    of = components(sets, links)
    return {i: (len(sets[i]), of[i]) for i in sets}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def good_turing(n, k=5):
    d = [1.0] + [1 - 0.5 / r for r in range(1, k + 1)]
    if n[1]:
        cut = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            if n[r] and cut != 1:
                ratio = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
                if 0 < ratio < 1:
                    d[r] = ratio
    return d


class Katz:
    """Katz backoff over bigrams, straight from its definition."""

    def __init__(self, texts, k=5):
        self.k = k
        self.uni, self.bi = Counter(), defaultdict(Counter)
        for text in texts:
            h = "<s>"
            for w in [*words(text.translate(LOWER)), "</s>"]:
                self.uni[w] += 1
                self.bi[h][w] += 1
                h = w
        self.total = sum(self.uni.values())
        self.d1 = good_turing([0] + [sum(c == r for c in self.uni.values()) for r in range(1, k + 2)])
        self.d2 = good_turing([0] + [sum(c == r for x in self.bi.values() for c in x.values()) for r in range(1, k + 2)])
        self.size = float(self.total)
        self.left = sum((1 - self.d1[c]) * c for c in self.uni.values() if c <= k)
        if self.left <= 0:
            self.left, self.size = 1.0, self.total + 1.0

    def p1(self, w):
        c = self.uni[w]
        return (self.left if not c else c * (self.d1[c] if c <= self.k else 1)) / self.size

    def p2(self, w, h):
        seen = self.bi.get(h)
        if not seen:
            return self.p1(w)
        n = sum(seen.values())
        if all(c > self.k for c in seen.values()):
            n += 1

        def kept(c):
            return c * (self.d2[c] if c <= self.k else 1) / n

        if w in seen:
            return kept(seen[w])
        return (1 - sum(map(kept, seen.values()))) / (1 - sum(map(self.p1, seen))) * self.p1(w)

    def score(self, text):
        tokens = [*words(text.translate(LOWER)), "</s>"]
        return sum(math.log10(self.p2(w, h)) for h, w in zip(["<s>", *tokens], tokens))

    def base(self, text):
        tokens = [*words(text.translate(LOWER)), "</s>"]
        return sum(math.log10((self.uni[w] + 0.1) / (self.total + 0.1 * (len(self.uni) + 1))) for w in tokens)
