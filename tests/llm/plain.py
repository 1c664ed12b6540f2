"""Slow, plain versions of the operators for comparison."""

import re
from collections import Counter, defaultdict
from math import ceil


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def similar_sets(sets: dict, percent: int):
    """All pairs with 100 * intersection >= percent * union, by exact prefix filtering."""
    df = Counter(x for s in sets.values() for x in s)
    index, out = defaultdict(list), []
    for i, s in sets.items():
        order = sorted(s, key=lambda x: (df[x], x))
        seen = set()
        for x in order[: len(s) - ceil(percent * len(s) / 100) + 1]:
            for j in index[x]:
                if j not in seen:
                    seen.add(j)
                    both = len(s & sets[j])
                    if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                        out.append((i, j))
            index[x].append(i)
    return out


def near_duplicates(docs: dict, size: int, percent: int):
    sets = {i: shingles(t, size) for i, t in docs.items()}
    links = similar_sets({i: s for i, s in sets.items() if s}, percent)
    return {i: len(s) for i, s in sets.items()}, components(docs, links)


def word_list(text, pattern):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(pattern, lowered)


def _distance(a, b, most):
    """Edit distance, or anything over `most` where it is larger."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    far = most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [far] * (len(b) + 1)
        new[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        if min(new) > most:
            return far
        row = new
    return row[-1]


def _pair_counts(line):
    """Counts of the pairs of letters, in 512 classes: an edit moves four at most."""
    import numpy as np

    codes = np.array([ord(c) for c in line])
    return np.bincount((codes[:-1] * 31 + codes[1:]) % 512, minlength=512)


def repeated_lines(docs: dict, similarity=0.9, min_words=3):
    """{(doc_id, line_no): keeper} of all lines that go, by the edit distances of all pairs of lines."""
    import numpy as np

    first, places = {}, defaultdict(list)
    for i in sorted(docs):
        for no, line in enumerate((docs[i] or "").split("\n") if docs[i] is not None else []):
            norm = re.sub("[.,!?;:]+| (?=[.,!?;: ]* )", "", line.lower()).strip(" ")
            if len([w for w in norm.split(" ") if w]) >= min_words:
                places[norm].append((i, no))
                first.setdefault(norm, (i, no))
    norms = list(places)
    fuzzy = sorted(
        (k for k, norm in enumerate(norms) if len([w for w in norm.split(" ") if w]) >= 5),
        key=lambda k: len(norms[k]),
    )
    sizes = np.array([len(norms[k]) for k in fuzzy])
    counts = np.array([_pair_counts(norms[k]) for k in fuzzy]).reshape(len(fuzzy), -1)
    links = []
    for at, k in enumerate(fuzzy):
        most = int((1 - similarity) * sizes[at] + 1e-9)
        near = np.arange(np.searchsorted(sizes, sizes[at] - most), at)
        near = near[np.abs(counts[near] - counts[at]).sum(1) <= 4 * most]
        links += [(k, fuzzy[j]) for j in near if _distance(norms[k], norms[fuzzy[j]], most) <= most]
    label = components(range(len(norms)), links)
    keeper = {}
    for k, norm in enumerate(norms):
        keeper[label[k]] = min(keeper.get(label[k], (10**9, 0)), first[norm])
    return {
        place: keeper[label[k]]
        for k, norm in enumerate(norms)
        for place in places[norm]
        if place != keeper[label[k]]
    }


def without_lines(docs: dict, gone: dict):
    out = {}
    for i, text in docs.items():
        drop = {no for d, no in gone if d == i}
        if drop:
            text = "\n".join(x for no, x in enumerate(text.split("\n")) if no not in drop)
            if not text.strip():
                continue
        out[i] = text
    return out


def contains(docs: dict, items: dict):
    """(doc_id, item_id) where an item's words stand in the text one after the other."""
    pattern = r"[0-9a-z\x80-\U0010ffff]+"
    texts = {i: f" {' '.join(word_list(t, pattern))} " for i, t in docs.items()}
    wanted = {i: f" {' '.join(word_list(t, pattern))} " for i, t in items.items()}
    return {(d, i) for d, t in texts.items() for i, w in wanted.items() if w in t}
