"""Plain Python versions of what the operators define."""

import re
from collections import defaultdict

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, size, lower=True):
    text = (text or "").translate(ASCII_LOWER) if lower else text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def components(docs, size, percent):
    """doc_id -> smallest doc_id reachable; ``docs``: list of (doc_id, text)."""
    sets = {d: shingles(t, size) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for d in sorted(sets):
        shared = defaultdict(int)
        for s in sets[d]:
            for e in inverted[s]:
                shared[e] += 1
            inverted[s].append(d)
        for e, both in shared.items():
            if 100 * both >= percent * (len(sets[d]) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return sets, {d: find(d) for d in sets}


def cut_lines(docs, run_lines=3, run_words=50):
    """doc_id -> places of the lines to delete; ``docs``: list of (doc_id, text)."""
    first, windows = {}, []
    for d, text in sorted(docs):
        lines = [(i, x) for i, x in enumerate((text or "").split("\n")) if x.strip(" ")]
        for k in range(len(lines)):
            total = 0
            for n in range(1, run_lines + 1):
                part = lines[k : k + n]
                if len(part) < n:
                    break
                before, total = total, sum(len(x.strip(" ").split(" ")) for _, x in part)
                if n == run_lines or (total >= run_words and before < run_words):
                    key = tuple(x for _, x in part)
                    windows.append((d, part, key))
                    first.setdefault(key, (d, part[0][0]))
    cuts = defaultdict(set)
    for d, part, key in windows:
        if first[key] != (d, part[0][0]):
            cuts[d].update(range(part[0][0], part[-1][0] + 1))
    return cuts


def without_lines(text, cut):
    left = [x for i, x in enumerate(text.split("\n")) if i not in cut]
    return "\n".join(left) if any(x.strip(" ") for x in left) else ""
