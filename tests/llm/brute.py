"""Plain versions of the operators, for small rows."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width, lower=True):
    words = WORD.findall(lower_ascii(text or "") if lower else text or "")
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def joined(rows, width, num, den):
    """{row number: (size, component, links)} of (key, text) rows."""
    sets = [shingles(t, width) for _, t in rows]
    n = len(rows)
    linked = [[i != j and bool(sets[i]) and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, waiting = {i}, [i]
        while waiting:
            v = waiting.pop()
            for w in range(n):
                if linked[v][w] and w not in seen:
                    seen.add(w)
                    waiting.append(w)
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((len(sets[i]), min(keys) if keys else None, sum(linked[i])))
    return out


def covered(sequences, size):
    """Covered positions of each sequence of (key, symbols): windows of ``size`` that start under a smaller key, too."""
    first = {}
    for key, s in sequences:
        if key is not None:
            for i in range(len(s) - size + 1):
                w = s[i : i + size]
                first[w] = min(first.get(w, key), key)
    out = []
    for key, s in sequences:
        gone = set()
        for i in range(len(s) - size + 1):
            if key is not None and first[s[i : i + size]] < key:
                gone |= set(range(i, i + size))
        out.append(gone)
    return out


def runs(positions):
    return sum(p - 1 not in positions for p in positions)


def best_fit_bins(sizes, capacity):
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= s
        else:
            free.append(capacity - s)
    return len(free)


def tokens(text):
    text = lower_ascii(text or "")
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", text)


def contaminated(text, items, window=13, wrong=2, least=5):
    """Ids of (id, text) items that share a window with at most ``wrong`` substitutions."""
    own, out = tokens(text), set()
    for name, item in items:
        if name is None or item is None:
            continue
        theirs = tokens(item)
        size = min(window, len(theirs))
        if size < least:
            continue
        allowed = wrong if size == window else 0
        for i in range(len(own) - size + 1):
            if any(sum(a != b for a, b in zip(own[i : i + size], theirs[j : j + size])) <= allowed for j in range(len(theirs) - size + 1)):
                out.add(name)
                break
    return sorted(out)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def groups(pairs, n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = defaultdict(list)
    for i in range(n):
        out[find(i)].append(i)
    return list(out.values())
