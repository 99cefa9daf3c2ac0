"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

GAP = r"[^\x20\x09-\x0D]+"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(GAP, t or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def url(u, rules):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = low(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def dedup(rows, width=20):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w, gone = words(t), set()
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if k in seen:
                gone.update(range(i, i + width))
            seen.add(k)
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def contaminated(rows, items, width=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    owners = defaultdict(set)
    for i, t in items:
        w = find(t)
        for k in range(max(1, len(w) - width + 1)) if w and i is not None else ():
            owners[tuple(w[k : k + width])].add(str(i))
    out = {}
    for d, t in rows:
        w, hit, got = find(t), set(), set()
        for o, who in owners.items():
            for k in range(len(w) - len(o) + 1):
                if tuple(w[k : k + len(o)]) == o:
                    hit.update(range(k, k + len(o)))
                    got |= who
        out[d] = (len(w), len(hit), len(got), sha(",".join(sorted(got))), bool(hit))
    return out


def components(rows, width=4, percent=85):
    sets = {}
    for d, t in rows:
        w = words(low(t))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def base(t):
    w = words(t)
    runs = Counter()
    for i in range(len(w) - 7):
        runs[tuple(w[i : i + 8])] += 1
    hit = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def _classes(t):
    rare = re.sub("[a-z \u00c0-\u024f]+", "", t or "")
    counts = [len(re.findall(p, rare)) for p in ("[A-Z]", "[0-9]", r"[.,;:!?'\"()-]", r"[#*$%&|<>]")]
    return [len(t or "") - len(rare), *counts, len(rare) - sum(counts)]


def _lead(w, names):
    c = Counter(w)
    return [c[n] for n in names] + [len(w) - sum(c[n] for n in names)]


def _share(x):
    return [a / max(1, sum(x)) for a in x]


def _distance(p, q):
    half = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
    return math.sqrt(max(0, sum(half(a, b) + half(b, a) for a, b in zip(p, q, strict=True)) / 2))


def quality(rows, min_words=40, most=(0.31, 0.28), common=12):
    """rows: id, text, lang."""
    counts = defaultdict(Counter)
    for _, t, lang in rows:
        counts[lang].update(words(t))
    leads = {lang: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:common]] for lang, c in counts.items() if lang is not None and c}
    sums = {}
    for _, t, lang in rows:
        if lang in leads:
            a, b = sums.setdefault(lang, ([0] * (len(leads[lang]) + 1), [0] * 6))
            sums[lang] = [x + y for x, y in zip(a, _lead(words(t), leads[lang]), strict=True)], [x + y for x, y in zip(b, _classes(t), strict=True)]
    out = {}
    for d, t, lang in rows:
        b, far = base(t), False
        if b[0] >= min_words and sums:
            each = []
            for k in [lang] if lang in leads else leads:
                got = _lead(words(t), leads[k]), _classes(t)
                each.append([_distance(_share(x), _share(y)) for x, y in zip(got, sums[k], strict=True)])
            far = any(x > m for x, m in zip(min(each), most, strict=True))
        out[d] = (*b, not b[5] and not far)
    return out


def base_secrets(t):
    """Counts of the three kinds of base matches, and the digest of their spans."""
    t, found = t or "", []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", t):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, "access", m.end()))
    for m in re.finditer("[0-9a-f]+", t):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, "hex", m.end()))
    found.sort()
    n = Counter(k for _, _, k, _ in found)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in found))
