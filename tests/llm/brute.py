"""Brute-force statements of what the operators return."""

from __future__ import annotations


def groups(ids, linked):
    """Smallest id reachable, for each id."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def near(docs, width, percent=80):
    sets = {i: shingles(t, width) for i, t in docs}
    ids = [i for i in sets if sets[i]]
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            p, q = sets[a], sets[b]
            if 5 * min(len(p), len(q)) >= 4 * max(len(p), len(q)):
                met = len(p & q)
                if 100 * met >= percent * (len(p) + len(q) - met):
                    links.append((a, b))
    comp = groups(sets, links)
    return sorted((i, len(sets[i]), comp[i], comp[i] == i) for i in sets)
