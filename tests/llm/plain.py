"""Plain forms of the corpus operators, which share nothing with them but fixed numbers."""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from itertools import combinations

PACKETS = 64


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def groups(texts, size, percent=80, joined=()):
    """The group of every text, by all pairs; ``joined`` are pairs of places that belong together."""
    sets = [shingles(t, size) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    for a, b in joined:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(len(texts))], sets


def queue(rows, cut=True):
    """Rows are (source, doc_id, size, turn); returns the words taken per row."""
    sizes = defaultdict(int)
    for source, _, size, _ in rows:
        sizes[source] += size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, targets, free = sum(sizes.values()), {}, set(order)
    while True:  # share what is left by weight; fix sources that would get too much
        rest = budget - sum(targets.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        targets |= {s: 3 * sizes[s] for s in over}
        free -= over
    targets |= share
    heap = []
    for s in order:
        own = sorted((r[3], r[1] is not None, r[1] or 0, i) for i, r in enumerate(rows) if r[0] == s)
        served = 0
        for turn_of in range(3):
            for turn, _, _, i in own:
                size = rows[i][2]
                if not size:
                    continue
                parts = min(size, PACKETS) if served < targets[s] < served + size else 1
                for k in range(parts):
                    a, b = size * k // parts, size * (k + 1) // parts
                    heapq.heappush(heap, ((served + b) / targets[s], order.index(s), turn_of, i, b - a))
                served += size
    taken, total = Counter(), 0
    while heap and (total < budget or not cut):
        *_, i, words = heapq.heappop(heap)
        words = min(words, budget - total) if cut else words
        taken[i] += words
        total += words
    return [taken[i] for i in range(len(rows))], targets
