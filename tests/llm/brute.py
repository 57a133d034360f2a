"""The contracts of the training-data operators by plain loops."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict


import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def passages(rows, n=13):
    """rows: (id, text); each id once."""
    first, out = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        for j in range(len(w) - n + 1):
            first.setdefault(tuple(w[j : j + n]), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < i:
                gone[j : j + n] = [True] * n
        out[i] = (len(w), sum(gone), sha(" ".join(a for a, g in zip(w, gone, strict=True) if not g).encode()))
    return out


def repeated_bytes(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1):
            k = b[j : j + n]
            if k in seen:
                gone[j : j + n] = b"\1" * n
            else:
                seen.add(k)
        out[i] = (len(b), sum(gone), sum(1 for g, _ in itertools.groupby(gone) if g), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def repeated_lines(rows, n=3, long=(25, 50)):
    """A run of lines counts if they stand for n lines at least: a line for one, and one more for each number of words it reaches."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        lines = [x for x in (t or "").split("\n") if x]
        parts = [(k, x, j) for k, x in enumerate(lines) for j in range(1 + sum(len(WORD.findall(x)) >= w for w in long))]
        gone = [False] * len(lines)
        for j in range(len(parts) - n + 1):
            k = tuple(p[1:] for p in parts[j : j + n])
            if k in seen:
                for p in parts[j : j + n]:
                    gone[p[0]] = True
            else:
                seen.add(k)
        out[i] = [x for x, g in zip(lines, gone, strict=True) if not g]
    return out


def fingerprint(t, words=3):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[j : j + words]) for j in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(ids), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal(t):
    def sound(kind, v):
        d = [int(c) for c in v if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        if kind == "card":
            twice = [x if k % 2 == 0 else 2 * x - 9 * (2 * x > 9) for k, x in enumerate(reversed(d))]
            return 13 <= len(d) <= 19 and sum(twice) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if sound(k, m[0])]


SIGN = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]")
TOKEN = regex.compile(r"(?<![0-9A-Za-z_./+-])(?=[A-Za-z_./+-]*[0-9])[0-9A-Za-z_./+-]{7,}[0-9A-Za-z]")


def signs(t):
    return ["0" if regex.match(r"\p{N}", x) else x for x in SIGN.findall(t.lower())]


def contexts(t, spans, at):
    """L and R patterns of the span with this number, from the text between its neighbours of the same kind."""
    left = signs(t[spans[at - 1][1] if at else 0 : spans[at][0]])
    right = signs(t[spans[at][1] : spans[at + 1][0] if at + 1 < len(spans) else len(t)])
    out = ["L " + " ".join(left[-k:]) for k in (1, 2, 3) if len(left) >= k] + ["R " + " ".join(right[:k]) for k in (1, 2, 3) if len(right) >= k]
    return [p for p in out if regex.search(r"\p{L}", p[2:])]


def bootstrapped(rows, base_spans, rounds=3, least_seeds=3, confidence=0.7):
    """Spans that the method adds, for each row (id, text); base_spans: of every kind, for a text, all matches and which are sound."""
    grams, part, seeds = defaultdict(int), defaultdict(lambda: defaultdict(int)), defaultdict(set)
    tokens = []
    for i, t in rows:
        t = t or ""
        s = signs(t)
        for k in (1, 2, 3):
            for j in range(len(s) - k + 1):
                grams[" ".join(s[j : j + k])] += 1
        base = []
        for spans, sound in base_spans(t):
            for at, (a, b) in enumerate(spans):
                if sound[at]:
                    base.append((a, b))
                    for p in contexts(t, spans, at):
                        part[p][t[a:b].lower()] += 1
                        seeds[p].add(t[a:b].lower())
        spans = [m.span() for m in TOKEN.finditer(t)]
        for at, (a, b) in enumerate(spans):
            own = contexts(t, spans, at)
            a += len(t[a:b]) - len(t[a:b].lstrip("_./+-"))
            if any(x < b and a < y for x, y in base):
                continue
            kind = "number" if re.fullmatch(r"[0-9_./+-]+", t[a:b]) else "secret"
            tokens.append((i, kind, a, b, own))
            for p in own:
                part[p][t[a:b].lower()] += 1
                if re.fullmatch("[0-9a-f]{32,}", t[a:b]):
                    seeds[p].add(t[a:b].lower())
    rich = {p: v for p, v in part.items() if len(seeds[p]) >= least_seeds}
    total = {p: max(sum(v.values()), grams[p[2:]]) for p, v in rich.items()}
    fixed = set().union(*[seeds[p] for p in rich]) if rich else set()
    patterns = defaultdict(list)
    for p, v in rich.items():
        for x in v:
            patterns[x].append(p)
    score = {x: float(x in fixed) for x in patterns}
    weigh = lambda: {p: sum(n * score[x] for x, n in v.items()) / total[p] for p, v in rich.items()}
    for _ in range(rounds):
        weight = weigh()
        for x, ps in patterns.items():
            wrong = 1.0
            for p in ps:
                wrong *= 1.0000001 - min(weight[p], 1.0)
            score[x] = 1.0 if x in fixed else min(1.0, 1 - wrong)
    good = {p for p, w in weigh().items() if w >= confidence}
    out = defaultdict(set)
    for i, kind, a, b, own in tokens:
        if good & set(own):
            out[i].add((kind, a, b))
    return out, good


def periodic_runs(w, exponent=4, least=6):
    """(start, length, period) of every run of a list of words."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, exponent * q) and j > i and not any(all(w[x] == w[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_runs(w, runs):
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def trie(rows, rebuild):
    """{(conv, depth): (parent, convs, children, leaves, saved, digest of those that end)} of rows (conv, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [v[2:] for v in sorted(vs)] for c, vs in own.items()}
    said = own
    if rebuild:
        said = {}
        for c, turns in own.items():
            h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
            said[c] = own.get(base, [])[:h] + turns[h:]
    node, kids, out, value = defaultdict(list), defaultdict(list), {}, {}
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            node[tuple(turns[:d])].append(c)
    for p in node:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(node, key=len, reverse=True):
        leaves = sum(value[x][0] for x in kids[p]) or 1
        saved = sum(value[x][1] for x in kids[p]) + ((len(node[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        value[p] = leaves, saved
        ends = sorted(c for c in node[p] if len(said[c]) == len(p))
        out[min(node[p]), len(p)] = (min(node[p[:-1]]) if p else None, len(node[p]), len(kids[p]), leaves, saved, sha(",".join(map(str, ends)).encode()))
    return out


def linked(rows, threshold=0.93):
    """[(id, links, component)] of rows (id, label, vector), as many as rows, in their order."""

    def sound(v):
        return bool(v) and all(x is not None and abs(x) < float("inf") for x in v) and any(v)

    def near(a, b):
        (i, k, v), (j, m, w) = rows[a], rows[b]
        if None in (i, j, k, m) or k != m or not sound(v) or not sound(w) or len(v) != len(w):
            return False
        return sum(x * y for x, y in zip(v, w, strict=True)) / (sum(x * x for x in v) ** 0.5 * sum(x * x for x in w) ** 0.5) >= threshold

    pairs = {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if near(a, b)}
    of = components(range(len(rows)), lambda a, b: (a, b) in pairs)
    least = {}
    for a, r in of.items():
        if rows[a][0] is not None:
            least[r] = min(least.get(r, rows[a][0]), rows[a][0])
    return [(rows[a][0], sum(a in p for p in pairs), least.get(of[a])) for a in range(len(rows))]
