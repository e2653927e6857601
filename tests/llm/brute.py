"""Plain Python versions of what the operators return."""

import hashlib
import math
import re
from collections import defaultdict
from itertools import combinations

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, width):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def roots(rows, width, percent):
    """The sets of (doc_id, text) rows, and for each row the number of a row that stands for its component."""
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            up[top(i)] = top(j)
    return sets, [top(i) for i in range(len(rows))]


def components(rows, width, percent):
    """(doc_id, text) rows to (doc_id, size, component)."""
    sets, top = roots(rows, width, percent)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[top[i]].append(d)
    return sorted(((d, len(sets[i]), min((x for x in ids[top[i]] if x is not None), default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def base_spans(text):
    """Strong spans of op7 as the contract words them."""
    t = text or ""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 32]
    out.sort()
    text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in out)
    return [sum(k == n for _, k, _ in out) for n in range(3)] + [hashlib.sha256(text.encode()).hexdigest(), text]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contamination(docs, items, span=10):
    """(doc_id, n_words, n_hit, item ids) for each document."""
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(len(w), span)
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    found |= {str(i) for i in windows[k] if i is not None}
        out.append((d, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=str)


def deduped_lines(docs):
    """(doc_id, text) with later windows of three lines, or of a whole shorter text, removed; docs have distinct (id, text)."""
    windows, first = {}, {}
    for d, t in docs:
        if t is not None:
            ls = t.split("\n")
            windows[d, t] = [tuple(ls[p : p + 3]) for p in range(max(1, len(ls) - 2))]
            for p, k in enumerate(windows[d, t]):
                place = ((d is not None, d or 0), p, t)
                if any(k) and (k not in first or place < first[k]):
                    first[k] = place
    out = []
    for d, t in docs:
        if t is None:
            out.append((d, None))
            continue
        gone = set()
        for p, k in enumerate(windows[d, t]):
            if any(k) and first[k] != ((d is not None, d or 0), p, t):
                gone |= set(range(p, p + len(k)))
        out.append((d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)))
    return sorted(out, key=str)


def spelled(words, longest=5, shared=2):
    """(class, word) to probability: Kneser-Ney over letters, from {word: (n0, n1)}, runs seen once left to the backoff."""
    raw, c = defaultdict(lambda: [0, 0]), {}
    for w, n in words.items():
        t = f"^{w}$"
        for k in range(1, longest + 1):
            for i in range(len(t) - k + 1):
                for y in (0, 1):
                    raw[t[i : i + k]][y] += n[y]
    longer = defaultdict(lambda: [0, 0])
    for g, n in raw.items():
        for y in (0, 1):
            longer[g[1:]][y] += n[y] > 0
    for g, n in raw.items():
        if g != "^":
            v = n if len(g) == longest or g[0] == "^" else longer[g]
            c[g] = [sum(v)] * 2 if len(g) <= shared else v
    cut = {k: [discount([v[y] for g, v in c.items() if len(g) == k]) for y in (0, 1)] for k in {len(g) for g in c}}
    after = defaultdict(list)
    for g in c:
        after[g[:-1]].append(g)
    letters = sum(len(g) == 1 for g in c) + 1

    def probability(y, w):
        t, out = f"^{w}$", 1.0
        for i in range(1, len(t)):
            p = 1 / letters
            for k in range(1, min(longest, i + 1) + 1):
                follow = after.get(t[i - k + 1 : i], [])
                total = sum(c[g][y] for g in follow)
                if sum(sum(c[g]) for g in follow) < 2 or not total:
                    continue
                part = {g: max(c[g][y] - cut[k][y], 0) / total for g in follow if sum(c[g]) >= 2}
                p = part.get(t[i - k + 1 : i + 1], 0) + (1 - sum(part.values())) * p
            out *= p
        return out

    return probability


def discount(values):
    ones, twos = values.count(1), values.count(2)
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def toxic_ratio(pairs):
    """(history, word) to the log of how much likelier toxic is, from {(h, w): (n0, n1)}."""
    n, f = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (_, w), v in pairs.items():
        for y in (0, 1):
            n[w][y] += v[y]
            f[w][y] += v[y] > 0
    spell, known = spelled(n), {w for w in n if sum(n[w]) >= 2}
    words_cut = [discount([v[y] for v in f.values()]) for y in (0, 1)]
    pairs_cut = [discount([v[y] for v in pairs.values()]) for y in (0, 1)]
    total = [sum(v[y] for v in f.values()) for y in (0, 1)]
    own = {w: [max(f[w][y] - words_cut[y], 0) / total[y] for y in (0, 1)] for w in known}
    rest = [1 - sum(v[y] for v in own.values()) for y in (0, 1)]

    def likelihood(y, h, w):
        p = own.get(w, [0, 0])[y] + rest[y] * spell(y, w)
        if h not in known:
            return p
        part = {x: max(v[y] - pairs_cut[y], 0) / max(n[h][y], 1) for (g, x), v in pairs.items() if g == h and max(v) >= 2 and x in known}
        return part.get(w, 0) + (1 - sum(part.values())) * p

    return lambda h, w: math.log(likelihood(1, h, w)) - math.log(likelihood(0, h, w))


def notices(model, text, least=0.5, share=0.6, most=12):
    """op6 in the query's mode: every run of lines of a text is put to the classifier, whatever words it holds, and confirmed by templates."""
    from cardloom.llm import licenses as lic

    lines = (text or "").split("\n")
    blank = [not lic.words(x) for x in lines]
    runs = [(a, b) for a in range(len(lines)) for b in range(a, len(lines)) if not any(blank[a : b + 1])]
    whole = {(a, b) for a, b in runs if (a == 0 or blank[a - 1]) and (b + 1 == len(lines) or blank[b + 1])}
    held = lambda t, a, b: len(t & lic.pairs(lic.words("\n".join(lines[a : b + 1]))))
    taken, out = set(), []
    for a, b in sorted((r for r in runs if r[1] - r[0] < most or r in whole), key=lambda r: (r[1] - r[0], r)):
        if taken & set(range(a, b + 1)) or not (hit := model.name("\n".join(lines[a : b + 1]), least, share)):
            continue
        t = next(t for f, k, t in lic.TEMPLATES if (f, k) == hit[:2])
        while b + 1 < len(lines) and not blank[b + 1] and b + 1 not in taken and held(t, a, b + 1) > held(t, a, b):
            b += 1
        while a and not blank[a - 1] and a - 1 not in taken and held(t, a - 1, b) > held(t, a, b):
            a -= 1
        taken |= set(range(a, b + 1))
        start = sum(len(x) + 1 for x in lines[:a])
        out.append((hit[0], start, start + len("\n".join(lines[a : b + 1]))))
    return sorted(out, key=lambda x: x[1])
