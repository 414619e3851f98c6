"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter

LOWER = {**{c: c + 32 for c in range(65, 91)}}
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def alnum_words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def spaced_words(text, fold=False):
    text = text or ""
    return SPACED.findall(text.translate(LOWER) if fold else text)


def contamination(texts, items, size=10):
    windows = {}
    for item, text in items:
        w = alnum_words(text)
        k = min(size, len(w))
        for s in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[s:s + k]), set()).add("null" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, found = alnum_words(text), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                own = windows.get(tuple(w[s:s + k]))
                if own:
                    hit |= set(range(s, s + k))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


def shingles(text, k=5):
    w = spaced_words(text, fold=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def groups(docs, percent=75):
    """(number of shingles, smallest reachable id) of each (id, text)."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(len(sets[i]), least.get(find(i))) for i in range(len(docs))]


def substrings(texts, size=35):
    words = [spaced_words(t) for t in texts]
    count = Counter(tuple(w[s:s + size]) for w in words for s in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = set()
        for s in range(len(w) - size + 1):
            if count[tuple(w[s:s + size])] > 1:
                gone |= set(range(s, s + size))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def measures(text):
    text = text or ""
    w = spaced_words(text)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), len(lines) - len(set(lines)), len(again))


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


def shard_prefixes(docs, limit, bits):
    """The shortest prefix of each document's bits whose documents fit or are one."""
    out = {}
    for i, (_, n) in enumerate(docs):
        for d in range(len(bits[i]) + 1):
            same = [j for j in range(len(docs)) if bits[j][:d] == bits[i][:d]]
            if sum(docs[j][1] for j in same) <= limit or len(same) == 1:
                out[i] = bits[i][:d]
                break
    return out
