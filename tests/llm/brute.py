"""Plain versions of the operators over Python lists, written from the contracts alone."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(ids, links):
    top = {i: i for i in ids}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    return {i: root(i) for i in ids}


def near(docs):
    """doc_id -> (n_shingles, component) of rows with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    holders = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            holders[g].add(i)
    links = set()
    for i, s in sets.items():
        for j in set().union(*(holders[g] for g in s)) if s else ():
            if i < j:
                both = len(s & sets[j])
                if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                    links.add((i, j))
    found = components(sets, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def contamination(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = BENCH.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = BENCH.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def repeats(docs, window=50):
    """Rows (doc_id, n_words, n_removed, sha) where ids are distinct."""
    words = {i: SPACED.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = []
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out
