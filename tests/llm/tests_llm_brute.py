"""Plain versions of the operators on pairs and lines."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np


def shingles(text, size):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = defaultdict(int)
    for a in range(len(rows)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
                links[a] += 1
                links[b] += 1
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    return sorted((str(i), len(s), str(least.get(root(a)) if i is not None else None), links[a]) for a, (i, s) in enumerate(sets))


def brute_lines(rows, min_words):
    docs = sorted({(i if i is not None else -(2**63), t) for i, t in rows if t is not None}, key=lambda r: (r[0],))
    assert len({i for i, _ in docs}) == len(docs), "ids of the fixture are distinct but for repeated rows"
    texts = {i: [(k, x) for k, x in enumerate(t.split("\n")) if x.split()] for i, t in docs}
    gone, places = defaultdict(set), defaultdict(list)
    for i, lines in texts.items():
        for s, (_, x) in enumerate(lines):
            # the longest run from here on that an earlier place has too
            best = 0
            for j, q in places[x]:
                n = 0
                while s + n < len(lines) and q + n < len(texts[j]) and lines[s + n][1] == texts[j][q + n][1]:
                    n += 1
                best = max(best, n)
            if sum(len(y.split()) for _, y in lines[s : s + best]) >= min_words:
                gone[i] |= {k for k, _ in lines[s : s + best]}
            places[x].append((i, s))
    out = []
    for i, t in rows:
        if t is None:
            out.append((str(i), "None", 0, 0))
        else:
            lost = gone[i if i is not None else -(2**63)]
            all_lines = t.split("\n")
            out.append((str(i), "\n".join(x for k, x in enumerate(all_lines) if k not in lost), len(all_lines), len(lost)))
    return sorted(out)


def brute_distance(item, text):
    """Least edit distance of the item to any passage, by the whole table of distances."""
    row = np.zeros(len(text) + 1, int)
    for c in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        for j, d in enumerate(text):
            new[j + 1] = min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1)
        row = new
    return int(row.min())


def brute_licenses(text, templates, gap, share):
    """(labels, score) of a text, by holding every place against every template position."""
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    labels, score = set(), 0.0
    for t in templates:
        words = t.text.split()
        k = 2 if t.base else min(4, len(words))
        n = len(words) - k + 1
        votes = defaultdict(set)
        for place in range(len(w) - k + 1):
            for at in range(n):
                if w[place : place + k] == words[at : at + k]:
                    votes[place - at].add(at)
        spans, before = [], None
        for d in sorted(votes):
            if t.base or before is None or d - before > gap:
                spans.append(set())
            spans[-1] |= votes[d]
            before = d
        best = max((len(s) / n for s in spans), default=0)
        if best >= (1 if t.base else share):
            labels.add(t.label)
            score = max(score, best)
    return ",".join(sorted(labels)), score
