"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


BASE_PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else int(d) * 2 - 9 * (d > "4") for k, d in enumerate(reversed(digits))) % 10 == 0


def pii(text):
    out = []
    for k, (kind, rx) in enumerate(BASE_PII.items()):
        for m in rx.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda m=m: all(int(x) < 256 for x in m[0].split(".")), "card": lambda d=d: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 10 <= len(d) <= 15}[kind]()
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


BASE_SECRETS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def secrets(text):
    out = []
    for k, (kind, rx) in enumerate(BASE_SECRETS.items()):
        for m in rx.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= (12, 18, 16)[k]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def shingles(text):
    w = ascii_lower(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_copies(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(sets, links)
    return {i: (len(sets[i]), comp[i]) for i in sets}


def substring(rows, window=35):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def tiles(item, text, least):
    """Greedy string tiling without hashes: of all equal free stretches the longest, first by item place, then by text place."""
    free_item, free_text, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and free_item[i + n] and free_text[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        free_item[i : i + n] = free_text[j : j + n] = [False] * n
        out.append((i, j, n))


def contaminations(docs, items, least=5, threshold=0.5):
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    out = []
    for doc, text in docs:
        for item, other in items:
            if item is not None and len(w := split(other)) >= least:
                marked = sum(n for *_, n in tiles(w, split(text), least))
                if marked >= threshold * len(w):
                    out.append((doc, item, marked / len(w)))
    return out


def disclosures(rows, support=3, generalise=0.6, remove=0.8):
    """id -> all spans of a text, as kind:start:end, with the terms that tell an entity."""
    base = {i: [x.split(":") for x in pii(t).split(",") if x] for i, t in rows}
    base = {i: [(k, int(a), int(b)) for k, a, b in x] for i, x in base.items()}
    text = {i: t or "" for i, t in rows}
    words = {i: [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W_]+", t)] for i, t in text.items()}
    entities = {i: {(k, text[i][a:b].lower()) for k, a, b in x} for i, x in base.items()}
    n_e = Counter(e for x in entities.values() for e in x)
    n_t = Counter(w for x in words.values() for w in {w for w, *_ in x})
    n_te = Counter((e, w) for i, x in entities.items() for e in x for w in {w for w, *_ in words[i]})
    d = len(rows)
    share = {k: math.log2(d * n / (n_t[k[1]] * n_e[k[0]])) / math.log2(d / n_e[k[0]]) for k, n in n_te.items() if n >= support and d > n_e[k[0]]}
    order = [*BASE_PII, "generalised", "removed"]
    out = {}
    for i in text:
        found = list(base[i])
        for w, a, b in words[i]:
            most = max((share.get((e, w), 0) for e in entities[i]), default=0)
            if most >= generalise and not any(x <= a and b <= y for _, x, y in base[i]):
                found.append(("removed" if most >= remove else "generalised", a, b))
        out[i] = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (s[1], order.index(s[0]))))
    return out


def capacity(sizes, shards):
    """The smallest largest part of a row of sizes cut into parts, over all ways to cut."""
    best = [[0] + [math.inf] * len(sizes)] + [[math.inf] * (len(sizes) + 1) for _ in range(shards)]
    for k in range(1, shards + 1):
        for j in range(len(sizes) + 1):
            best[k][j] = min(max(best[k - 1][i], sum(sizes[i:j])) for i in range(j + 1))
    return best[shards][len(sizes)]


def ftrl(rows, labels, buckets, order, epochs, alpha=0.3, beta=1.0, l1=0.02, l2=0.5):
    """Follow the regularised leader, coordinate by coordinate: rows are ({bucket: value}, label); gives {(bucket, label): weight}."""
    z, n = Counter(), Counter()

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(epochs):
        for j in order.permutation(len(rows)):
            values, label = rows[j]
            values = values | {buckets: 1.0}  # the bias
            scores = {y: sum(v * weight((b, y)) for b, v in values.items()) for y in labels}
            top = max(scores.values())
            total = sum(math.exp(s - top) for s in scores.values())
            wants = {y: math.exp(scores[y] - top) / total - (y == label) for y in labels}
            old = {(b, y): weight((b, y)) for b in values for y in labels}
            for b, v in values.items():
                for y in labels:
                    g, k = v * wants[y], (b, y)
                    z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * old[k]
                    n[k] += g * g
    return {k: weight(k) for k in z}


def window_logit(net, words):
    """The forward pass of one window, word by word and number by number."""
    from glossalake.llm import toxicity

    h, p = toxicity.HIDDEN, {k: v.astype(float) for k, v in net.p.items()}
    inputs = [net.embed([w])[0][0].astype(float) if w else None for w in words]
    states = [[], []]
    for k, seen in ((0, inputs), (1, inputs[::-1])):
        state = [0.0] * h
        for x in seen:
            a = [p[f"b{k}"][c] + (0 if x is None else sum(x[i] * p[f"W{k}"][i][c] for i in range(len(x)))) for c in range(3 * h)]
            u = [sum(state[i] * p[f"U{k}"][i][c] for i in range(h)) for c in range(3 * h)]
            z = [1 / (1 + math.exp(-(a[c] + u[c]))) for c in range(h)]
            r = [1 / (1 + math.exp(-(a[h + c] + u[h + c]))) for c in range(h)]
            new = [math.tanh(a[2 * h + c] + r[c] * u[2 * h + c]) for c in range(h)]
            state = [new[c] + z[c] * (state[c] - new[c]) for c in range(h)]
            states[k].append(state)
    both = [f + b for f, b, w in zip(states[0], states[1][::-1], words, strict=True) if w]
    scores = [sum(s[c] * p["v"][c] for c in range(2 * h)) for s in both]
    weights = [math.exp(s - max(scores)) for s in scores]
    pooled = [sum(w * s[c] for w, s in zip(weights, both, strict=True)) / sum(weights) for c in range(2 * h)]
    return sum(pooled[c] * p["o"][c] for c in range(2 * h)) + float(p["c"][0])


def toxicity_score(net, text):
    from glossalake.llm import toxicity

    words = re.findall(r"\w+", (text or "").lower())
    if not words:
        return 0.0
    short = [""] * max(0, toxicity.WINDOW - len(words))
    windows = [words[k : k + toxicity.WINDOW] + short for k in range(max(1, len(words) - toxicity.WINDOW + 1))]
    return 1 / (1 + math.exp(-max(window_logit(net, w) for w in windows)))
