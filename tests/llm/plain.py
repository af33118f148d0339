"""Plain versions of the contracts, one document at a time."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shingles(text):
    w = re.findall(SPACED, (text or "").translate(LOWER))
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(docs):
    """{doc_id: (set size, smallest reachable id)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def of(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = of(a), of(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), of(i)) for i in ids}


def without_repeats(docs, window=50):
    first = {}
    words = {i: re.findall(SPACED, t or "") for i, t in docs}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k: k + window]), i)
    out = {}
    for i, w in words.items():
        kept, covered = [], 0
        for k, word in enumerate(w):
            if k + window <= len(w) and first[tuple(w[k: k + window])] < i:
                covered = k + window
            if k >= covered:
                kept.append(word)
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def phrase_places(text, phrases):
    w = re.findall(ALNUM, (text or "").translate(LOWER))
    return len(w), sorted((i, label) for label, p in phrases for i in range(len(w)) if w[i: i + len(p.split())] == p.split())


def strong_spans(text):
    text = text or ""
    found = []
    low = re.compile(r"""(%s)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % "|".join(
        "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) + ("_?" + "".join(f"[{c}{c.upper()}]" for c in "key") if k == "api" else "")
        for k in ("password", "passwd", "secret", "token", "api")))
    for rank, (kind, pattern) in enumerate((("assign", low), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))):
        for m in pattern.finditer(text):
            if len(m.group(2) if kind == "assign" else m.group()) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(found))


def divergence(docs, least=30, top=50):
    """Rows (lang, source, part, item, value, rank) for documents (text, lang, source), all None-able."""
    docs = [tuple(x or "" for x in d) for d in docs]
    terms = [Counter(re.findall(r"[^\x00-\x60\x7B-\x7F]+", t.translate(LOWER))) for t, _, _ in docs]
    out = []
    for lang in {d[1] for d in docs}:
        holds = Counter(t for d, c in zip(docs, terms, strict=True) if d[1] == lang for t in c)
        kept = {t for t, n in holds.items() if n >= least}
        sums = {s: Counter() for _, g, s in docs if g == lang}
        for (_, g, s), c in zip(docs, terms, strict=True):
            if g == lang:
                sums[s].update({t: n for t, n in c.items() if t in kept})
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in sums.items()}
        q = share(sum(sums.values(), Counter()))
        for s in sums:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sums if o != s]
            over = [(q[t] - p[s][t], t) for t in kept if sums[s][t] and p[s][t] > q[t]]
            key = lambda x: (x[0], x[1].encode())
            out += [(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(sorted(pairs, key=key), 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, t) in enumerate(sorted(over, key=key)[:top], 1)]
    return sorted(out)


def ranked(docs, items, top=10):
    """Rows (item_id, rank, doc_id, score) for documents (id, text) and items (id, text)."""
    words = lambda t: Counter(re.findall(ALNUM, (t or "").translate(LOWER)))
    bags = [(i, c) for i, t in docs if (c := words(t))]
    n, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in bags:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, k, i, -s) for k, (s, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r))


def mixture(docs, entropy, max_repeat, blocks=64, seed=17):
    """Exponent and sorted rows (id, pass, place) of documents (id, text, source), one after the other."""
    digest = lambda *parts: hashlib.md5("|".join(parts).encode()).hexdigest()
    number = lambda text: xxhash.xxh64(text.encode(), seed=42).intdigest()
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    held, total = {}, {}
    for i, text, source in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        order = digest(str(seed), f"={i}|{42 if text is None else signed(number(text))}")[:16]
        held.setdefault(source, {}).setdefault(signed(number(order)) % blocks, []).append((order, n, i))
        total[source] = total.get(source, 0) + n
    share = {s: n / sum(total.values()) for s, n in total.items() if n}

    def fits(a):
        w = [x ** a for x in share.values()]
        h = -sum(x / sum(w) * math.log(x / sum(w)) for x in w)
        ratio = [x ** (a - 1) for x in share.values()]
        return h <= entropy * math.log(len(w)) + 1e-12, max(ratio) / min(ratio) <= max_repeat * (1 + 1e-12)

    grid = [k / 1000 for k in range(16001)]
    good = [a for a in grid if all(fits(a))]
    low, high = (good[0] - 0.001, good[0]) if good else (max(a for a in grid if fits(a)[1]), max(a for a in grid if fits(a)[1]) + 0.001)
    for _ in range(40):
        mid = (low + high) / 2
        if all(fits(mid)) if good else not fits(mid)[1]:
            high = mid
        else:
            low = mid
    a = 0.0 if good and good[0] == 0 else round(high if good else low, 6)
    least, out = max(x / x ** a for x in share.values()), []
    for s in held:
        target = math.floor(share.get(s, 0) ** a * least * sum(total.values()) + 0.5) if s in share else 0
        for p in range(1, (math.ceil(target / total[s]) if total[s] else 1) + 1):
            left, before = min(total[s], target - total[s] * (p - 1)), 0
            for place, b in enumerate(sorted(held[s], key=lambda b: (digest(str(seed), f"={s}", str(p), str(b)), b)), 1):  # noqa: B023
                spent = before
                for _, n, i in sorted(held[s][b]):
                    spent += n
                    if spent <= left:
                        out.append((i, p, place))
                before += sum(n for _, n, _ in held[s][b])
    return a, sorted(out)
