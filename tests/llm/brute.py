"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def contamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[s : s + k])].add(str(i))
    out = {}
    for d, t in docs.items():
        w, found, hit = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if own := windows.get(tuple(w[s : s + k])):
                    found |= own
                    hit |= set(range(s, s + k))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


SHAPES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def personal(docs):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        twice = [2 * int(c) if i % 2 else int(c) for i, c in enumerate(reversed(d))]
        return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0

    holds = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)),
        "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    out = {}
    for d, t in docs.items():
        found = sorted((m.start(), k, m.end()) for k, (kind, shape) in enumerate(SHAPES) for m in re.finditer(shape, t or "") if holds[kind](m[0]))
        text = ",".join(f"{SHAPES[k][0]}:{a}:{b}" for a, k, b in found)
        out[d] = (*(sum(k == i for _, k, _ in found) for i in range(4)), hashlib.sha256(text.encode()).hexdigest())
    return out


def repeats(docs, window=20):
    seen, out = set(), {}
    for d, t in sorted(docs.items()):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone |= set(range(s, s + window))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def near(docs, k, percent=80):
    sets = {}
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    least = {d: d for d in docs}
    changed = True
    linked = [(a, b) for a in docs for b in docs if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return {d: (len(sets[d]), least[d], least[d] == d) for d in docs}
