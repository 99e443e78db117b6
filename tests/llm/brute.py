"""Plain versions of the text operators, by definition, for small inputs."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {k for own in at.values() if len(own) > 1 for i in own for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def line_dedup(rows, least):
    """rows: (doc_id, text) -> for each, the numbers of the lines that go. By longest previous run."""
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    lines = [[(i, x) for i, x in enumerate((t or "").split("\n")) if WORD.search(x)] for _, t in rows]
    gone = [set() for _ in rows]
    every = [(d, k) for d in range(len(rows)) for k in range(len(lines[d]))]
    for d, k in every:
        for e, q in every:
            if (e, q) >= (d, k):
                break
            n = words = 0
            while k + n < len(lines[d]) and q + n < len(lines[e]) and lines[d][k + n][1] == lines[e][q + n][1]:
                words += len(WORD.findall(lines[d][k + n][1]))
                n += 1
            if words >= least:
                gone[d] |= {lines[d][k + x][0] for x in range(n)}
    return {r: g for r, g in zip(rows, gone, strict=True)}


def shingles(text, n=5):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near(rows, threshold=0.8):
    """rows: (doc_id, text) -> for each row, the first row of its group and its number of links."""
    sets = [shingles(t) for _, t in rows]
    root, links = [*range(len(rows))], [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))], links


def tiled(item, text, least):
    """How many words of the item greedy string tiling covers."""
    free_i, free_t, covered = [x > 0 for x in item], [x > 0 for x in text], 0
    while True:
        best, size = [], least
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                    n += 1
                if n > size:
                    best, size = [(i, t)], n
                elif n == size:
                    best.append((i, t))
        if not best:
            return covered
        for i, t in best:
            if all(free_i[i : i + size]) and all(free_t[t : t + size]):
                free_i[i : i + size] = free_t[t : t + size] = [False] * size
                covered += size


def leak(text, item, least=5, coverage=0.6):
    words = lambda x: re.findall(r"\w+", (x or "").lower())
    own = {w: k + 1 for k, w in enumerate(dict.fromkeys(words(item)))}
    a = [own[w] for w in words(item)]
    return len(a) >= least and tiled(a, [own.get(w, 0) for w in words(text)], least) >= coverage * len(a)
