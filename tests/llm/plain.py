"""Near copies in plain Python, by comparing all pairs."""

from itertools import combinations


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(sets):
    """The group of each text: links of Jaccard similarity 0.8 or more, by comparing all pairs."""
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in sets}
