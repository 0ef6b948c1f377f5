"""Plain versions of the pipeline's stages, on lists of (doc_id, text, source)."""

import hashlib
import re
from collections import Counter, defaultdict

BLANK = r"[^\x20\x09-\x0D]"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def measures(t):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines"""
    words = re.findall(BLANK + "+", t)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    hit = {k + d for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for d in range(5)}
    lines = [x for x in t.split("\n") if re.search(BLANK, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(lines)


def quality(rows):
    found = [(m[0] < 10 or 100 * m[4] > 20 * m[0], (5 * m[2] > m[0], 10 * m[3] > 3 * m[5], m[1] < 2 * m[0] or m[1] > 20 * m[0]), s or "") for m, s in ((measures(t or ""), s) for _, t, s in rows)]
    hosts = defaultdict(list)
    for _, fails, s in found:
        hosts[s].append(fails)
    rate = {}
    for r in range(3):
        mean = sum(f[r] for _, f, _ in found) / max(1, len(found))
        unit, inverse = mean * (1 - mean), sum(1 / len(h) for h in hosts.values()) / max(1, len(hosts))
        apart = sum((sum(f[r] for f in h) / len(h) - mean) ** 2 for h in hosts.values()) / max(1, len(hosts))
        strength = max(unit / max(apart - unit * inverse, 1e-6) - 1, 1)
        for s, h in hosts.items():
            rate[s, r] = (sum(f[r] for f in h) + mean * strength) / (len(h) + strength)
    good = {r[0] for r, (bad, fails, s) in zip(rows, found, strict=True) if not (bad or sum(fails) > 1 or any(f and rate[s, k] >= 0.5 for k, f in enumerate(fails)))}
    return [r for r in rows if r[0] in good]


def digest(t):
    return 0 if t is None else int(hashlib.md5(t.encode()).hexdigest()[:15], 16)


def lines(rows, min_copy=1, min_chars=20):
    """(doc_id, text, source, n_lines, n_removed)"""
    strip = lambda x: x.strip(" \t\r")
    first = {}
    for i, t, _ in rows:
        for p, x in enumerate((t or "").split("\n") if i is not None else []):
            if len(strip(x)) >= min_copy:
                at = (i, digest(t), p)
                first[strip(x)] = min(first.get(strip(x), at), at)
    long = {x: at for x, at in first.items() if len(x) >= min_chars}
    near = lambda x, y: abs(len(x) - len(y)) <= 1 and (x[: len(x) // 2 - 1] == y[: len(x) // 2 - 1] or x[-(len(x) // 2 - 1) :] == y[-(len(x) // 2 - 1) :]) and levenshtein(x, y) <= 1
    earliest = {x: min([at, *(b for y, b in long.items() if x in long and b < at and near(x, y))]) for x, at in first.items()}
    out = []
    for i, t, s in rows:
        every = [] if t is None else t.split("\n")
        kept = [x for p, x in enumerate(every) if i is None or strip(x) not in earliest or earliest[strip(x)] >= (i, digest(t), p)]
        out.append((i, None if t is None else "\n".join(kept), s, len(every), len(every) - len(kept)))
    return out


def shingles(t):
    words = re.findall(BLANK + "+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def reached(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def near_components(rows, percent):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return reached(sets, links), links


def substrings(rows):
    """(doc_id, remaining bytes, n_bytes, spans)"""
    seen, out = defaultdict(lambda: float("inf")), []
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49 if i is not None else 0):
            seen[b[k : k + 50]] = min(seen[b[k : k + 50]], i)
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49 if i is not None else 0):
            if seen[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = tuple((m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone)))
        out.append((i, None if t is None else bytes(c for c, g in zip(b, gone, strict=True) if not g), len(b), spans))
    return out
