"""Plain versions of what the operators compute, and awkward documents."""

from __future__ import annotations

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, size=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def components(texts: dict):
    """Smallest reachable id of every document, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


LONG = " ".join(f"w{i % 7919}x{i % 13}" for i in range(40_000))
BASE = [f"term{i}" for i in range(60)]


def awkward():
    """Nulls, empty and blank texts, one word, copies, near copies, case, wide characters, a very long text."""
    near = [*BASE[:30], "other", *BASE[31:]]
    texts = [
        None, "", " \t\n", "word", "WORD", " ".join(BASE), " ".join(BASE).upper(), " ".join(near), " ".join(BASE[:50]), "one two three four",
        "Ünïcode ſtraße 漢字 😀 ÉCOLE", "ünïcode ſtraße 漢字 😀 École", LONG, LONG + " tail", "a" * 5000, "x y z", "<|endoftext|> it's  1234 <|endoftext|>",
        "É" * 3, "é" * 3,
    ]
    rows = [(i, t, "en", ("b", "a", None)[i % 3], 0) for i, t in enumerate(texts)]
    rows.append((5, " ".join(BASE), "en", "c", 0))  # id and text repeated
    rows.append((None, "no id at all here", None, None, None))
    return rows
