"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
import tracemalloc


def words(text):
    folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", folded)


def shingles(text, width=5):
    own = words(text)
    if len(own) < width:
        return frozenset([tuple(own)]) if own else frozenset()
    return frozenset(tuple(own[i : i + width]) for i in range(len(own) - width + 1))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components(n, links):
    """Component number (smallest index) of each of n nodes."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def jaccard_rows(rows, percent=75):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    labels = components(len(rows), links)
    least = {}
    for label, (doc_id, _) in zip(labels, rows, strict=True):
        if doc_id is not None:
            least[label] = min(doc_id, least.get(label, doc_id))
    return [
        (doc_id, len(s), least.get(label, doc_id))
        for (doc_id, _), s, label in zip(rows, sets, labels, strict=True)
    ]


def peak_of(work) -> int:
    """Bytes that ``work`` allocates at most, numpy's arrays included."""
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak
