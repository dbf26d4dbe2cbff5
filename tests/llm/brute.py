"""Plain versions of the operators, for small inputs."""

import math
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


def near(rows, width=4, percent=80):
    """{doc_id: (n_shingles, component)} by an inverted index over all shingles; ids are distinct."""
    sets = {d: shingles(t, width) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index = defaultdict(list)
    for d in sorted(sets):
        common = defaultdict(int)
        for s in sets[d]:
            for o in index[s]:
                common[o] += 1
            index[s].append(d)
        for o, n in common.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    t = text or ""
    w = WORD.findall(t)
    seen = defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    repeat = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat), len(lines)


def fences(feats, groups, metrics, fence, prior, unit):
    """{group: {metric: (lo, hi)}} of rows' measures, by counting over sorted values of the mixed sketches."""
    at = lambda v: (v >> s << s, 1 << s) if (s := max(0, v.bit_length() - 9)) else (v, 1)
    hist = defaultdict(lambda: defaultdict(int))
    for m, (lang, source) in zip(feats, groups):
        for k, v in m.items():
            for g in ((lang, source), (lang,), ()):
                hist[g, k][at(v)] += 1
    out = defaultdict(dict)
    for lang, source in set(groups):
        q = {}
        for k in {k for g, k in list(hist) if g == (lang, source)}:
            mixed = defaultdict(int)
            for b, n in hist[(lang, source), k].items():
                mixed[b] += unit * n
            for g in ((lang,), ()):
                total = sum(hist[g, k].values())
                for b, n in hist[g, k].items():
                    mixed[b] += prior * unit * n // total
            total = sum(mixed.values())
            for p in (25, 75):
                cum = 0
                for (b, wide), w in sorted(mixed.items()):
                    cum += w
                    if w and 100 * cum >= p * total:
                        q[k, p] = b + float(p * total - 100 * (cum - w)) * wide / (100 * w)
                        break
        for k, (sides, size, worth) in metrics.items():
            if (k, 25) in q:
                reach = fence * max(q[k, 75] - q[k, 25], worth / q[size, 25])
                out[lang, source][k] = (math.ceil(q[k, 25] - reach) if sides == "both" else -math.inf, math.floor(q[k, 75] + reach))
    return out


def kept(rows, metrics, fence, prior, unit):
    """Verdicts of (lang, source, text) rows."""
    feats, failed = [], []
    for _, _, text in rows:
        n, chars, sym, dup, rep, lines = counts(text)
        feats.append({"symbols": 10000 * sym // n, "dup_lines": 10000 * dup // lines, "repeats": 10000 * rep // n, "word_len": 1000 * chars // n, "n_words": n, "n_lines": lines} if n else {})
        failed.append(n < 50 or 100 * rep > 50 * n)
    groups = [r[:2] for r in rows]
    f = fences(feats, groups, metrics, fence, prior, unit)
    return [not bad and all(f[g][k][0] <= m[k] <= f[g][k][1] for k in metrics if k in m) for m, g, bad in zip(feats, groups, failed)]


def mix(rows, weights=(5, 2, 1), share=1.5, most=2):
    """Words that each (doc_id, source, size, text) row gives. Hashes are compared whole: rows of one hash go together."""
    import hashlib

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    h = lambda d, t: int(md5(("" if d is None else str(d)) + ":" + md5(t or ""))[:9], 16)
    size = defaultdict(int)
    for _, s, n, _ in rows:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, full = {}, share * sum(size.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        given = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if given[s] > most * size[s] + 1e-9]
        if not over:
            target |= given
            break
        for s in over:
            target[s] = most * size[s]
            left -= target[s]
            full.add(s)
    out = [0] * len(rows)
    for s in names:
        times = int(target[s] / size[s] + 1e-12) if size[s] else 0
        budget, total, below = target[s] - times * size[s], 0, 0
        by = defaultdict(int)
        for d, src, n, t in rows:
            if src == s:
                by[h(d, t)] += n
        for x in sorted(by):
            if total + by[x] > budget + 1e-6:
                below = x + (2 * (budget - total) > by[x])
                break
            total += by[x]
        for i, (d, src, n, t) in enumerate(rows):
            if src == s:
                out[i] = n * (times + (h(d, t) < below))
    return out, target
