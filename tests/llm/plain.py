"""The contracts in plain Python, to compare with."""

import re
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def near_components(texts, size, percent=80):
    """texts: {id: text} -> {id: smallest id reachable}."""
    sets = {d: shingle_set(t, size) for d, t in texts.items()}
    top = {d: d for d in sets}

    def find(a):
        while top[a] != a:
            top[a] = top[top[a]]
            a = top[a]
        return a

    often = Counter(s for v in sets.values() for s in v)
    by = defaultdict(list)
    for d, s in sets.items():
        for q in sorted(s, key=lambda x: (often[x], x))[: len(s) + (-percent * len(s) // 100) + 1]:
            by[q].append(d)
    for members in by.values():
        for i, a in enumerate(members):
            for b in members[:i]:
                if find(a) != find(b):
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((find(a), find(b)))
                        top[y] = x
    return {d: find(d) for d in sets}, sets


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contamination(text, items):
    """(n_words, n_hit, item ids with windows in it)."""
    w = words(text)
    hit, ids = set(), set()
    at = defaultdict(list)
    for n in {len(x) for _, x in items}:
        for i in range(len(w) - n + 1):
            at[tuple(w[i : i + n])].append(i)
    for item, win in items:
        for i in at.get(win, ()):
            hit.update(range(i, i + len(win)))
            ids.add(item)
    return len(w), len(hit), ids


def item_windows(items):
    out = set()
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        out |= {(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n}
    return out


def secrets(text):
    text = text or ""
    out = []
    keyword = r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for rank, (kind, pattern, group, least) in enumerate((("assign", keyword, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(out)


def personal(text):
    text = text or ""
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(map(int, m.group().split("."))) <= 255:
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def digest(spans):
    import hashlib

    return hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, k, e in spans).encode()).hexdigest()
