"""Plain Python versions that the operators of docloom.llm are held against."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k):
    w = words((text or "").translate(_LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def jaccard_components(docs, k, share):
    sets = {i: shingles(t, k) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and share[1] * len(sets[a] & sets[b]) >= share[0] * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def quality(text):
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def substrings(docs, length):
    raw = {i: (t or "").encode() for i, t in docs}
    n = Counter(r[k : k + length] for r in raw.values() for k in range(len(r) - length + 1))
    out = {}
    for i, r in raw.items():
        gone = [False] * len(r)
        for k in range(len(r) - length + 1):
            if n[r[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(r), sum(gone), runs, sha(bytes(b for b, g in zip(r, gone) if not g)))
    return out


def lines(docs):
    key = lambda x: x.strip(SPACE).translate(_LOWER)
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(i)
    out = {}
    for i, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not (len(held.get(key(x), ())) > 1 and min(held[key(x)]) != i)]
        out[i] = (len(all_), len(all_) - len(kept), sha("\n".join(kept)))
    return out


def contained(docs, items):
    out = {}
    for i, t in docs:
        for j, b in items:
            k = min(5, len(words(b)))
            want = shingles(b, k) if k else set()
            w = words((t or "").translate(_LOWER))
            have = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if k else set()
            if want and 5 * len(want & have) >= 4 * len(want):
                out[i, j] = (len(want), len(want & have))
    return out
