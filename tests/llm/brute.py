"""Plain Python versions of the operators, for comparison on small tables."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def simhash(text, size):
    import xxhash

    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, most):
    """Smallest id reachable for each (id, print)."""
    by = defaultdict(list)
    for number, value in prints:
        by[value].append(number)
    parent = {v: v for v in by}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in combinations(by, 2):
        if (a ^ b).bit_count() <= most and root(a) != root(b):
            parent[root(b)] = root(a)
    least = {}
    for value, numbers in by.items():
        least[root(value)] = min([*numbers, *([least[root(value)]] if root(value) in least else [])])
    return {number: least[root(value)] for number, value in prints}


def shingle_set(text, size):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def joined(numbers, links):
    """Smallest number reachable for each number."""
    parent = {v: v for v in numbers}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in parent}


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            inside |= set(range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def base_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


PRIME, BASES = (1 << 31) - 1, (911_382_323, 972_663_749)


def sketch(text, length):
    """The 64 smallest mixed polynomial hashes of the windows of a text, from their definition."""
    length, found = min(length, len(text)), set()
    for i in range(len(text) - length + 1 if length else 0):
        a, b = (sum((ord(c) + 1) * pow(base, j, PRIME) for j, c in enumerate(text[i : i + length])) % PRIME for base in BASES)
        x = (a << 31 | b) * 0x9E3779B97F4A7C15 % (1 << 64)
        found.add(((x ^ x >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)) >> 32)
    return sorted(found)[:64]


def fingerprint(text):
    """(written fingerprint, sketches of 16 and, for texts under 64 characters, of 3 characters)."""
    long, short = sketch(text, 16), sketch(text, 3) if len(text) < 64 else None
    return ".".join("".join(f"{v:08x}" for v in s) for s in (long, short) if s), long, short


def likeness(a, b):
    a, b = (a[2], b[2]) if a[2] is not None and b[2] is not None else (a[1], b[1])
    if not a or not b:
        return float(len(a) == len(b))
    least = sorted({*a, *b})[:64]
    j = len({*a} & {*b} & {*least}) / len(least)
    return 2 * j / (1 + j)


def common_prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def js_distance(p, q):
    """Jensen-Shannon distance, base 2, of two histograms given as dictionaries."""
    from math import log2

    a, b = sum(p.values()), sum(q.values())
    if not a or not b:
        return 0.0
    total = 0.0
    for k in {*p, *q}:
        x, y = p.get(k, 0) / a, q.get(k, 0) / b
        m = (x + y) / 2
        total += (x * log2(x / m) if x else 0) + (y * log2(y / m) if y else 0)
    return max(0.0, total / 2) ** 0.5


def viterbi(start, move, emit):
    """Best path through all states: start[s], move[s][s], emit[t][s] are logarithms. Every path is scored."""
    from itertools import product

    def score(path):
        return start[path[0]] + emit[0][path[0]] + sum(move[a][b] + emit[t + 1][b] for t, (a, b) in enumerate(zip(path, path[1:])))

    return max(product(range(len(start)), repeat=len(emit)), key=score)


def dual_descent(rows, signs, costs, passes, seed):
    """Linear hinge loss by dual coordinate descent, on dense rows with a constant feature."""
    import numpy as np

    w, alpha, order = np.zeros(len(rows[0]) + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            x = np.append(rows[i], 1.0)
            new = min(max(alpha[i] - (signs[i] * (w @ x) - 1) / (x @ x), 0), costs[i])
            w += (new - alpha[i]) * signs[i] * x
            alpha[i] = new
    return w


def canonical_licence(text, spellings):
    """Canonical form of a text for licence digests."""
    text = "".join(c.lower() for c in text or "")
    lines = []
    for line in text.split("\n"):
        if re.match(r"[^\w\n©]*(?:copyright\b(?! ?(?:holder|owner|notice))|\(c\) ?(?:copyright|\d{4})|©|all rights reserved)", line):
            line = ""
        lines.append(line)
    text = "\n".join(lines)
    for old, new in spellings:
        text = text.replace(old, new)
    out = []
    for line in text.split("\n"):
        line = " ".join("".join(c if c.isalnum() else " " for c in line).split())
        if line:
            out.append(line)
    return out
