"""Plain versions of what the operators compute, written from their descriptions and without their code."""

import math
import re
from collections import Counter, defaultdict

import xxhash


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- repeated runs of sentences


def sentence_list(text):
    """(start, end, words, folded) of every sentence: up to marks before a blank, a line feed or a full-width mark; long ones fall into pieces."""
    ends, i = [], 0
    while i < len(text):
        if text[i] in ".!?":
            j = i
            while j < len(text) and text[j] in ".!?":
                j += 1
            if j < len(text) and text[j].isspace():
                ends.append(j)
            i = j
        else:
            if text[i] == "\n" or text[i] in "。！？":
                ends.append(i + 1)
            i += 1
    out, at = [], 0
    for end in [*ends, len(text)]:
        if end <= at:
            continue
        found = [(m.start() + at, m.group()) for m in re.finditer(r"\S+", text[at:end])]
        words = [w.lower() for _, w in found]
        pieces = [len(words)]
        if len(words) > 24:
            pieces = [k + 1 for k, w in enumerate(words[:-1]) if xxhash.xxh32_intdigest(w.strip(" .!?,;:")) % 8 == 0] + pieces
        last = 0
        for k in pieces:
            out.append((found[last][0] if last else at, found[k][0] if k < len(words) else end, k - last, " ".join(words[last:k]).strip(" .!?,;:")))
            last = k
        at = end
    return [s for s in out if s[2]]


def removed_characters(rows):
    """For [(doc_id, text)], unlike in id and text: the set of removed places of each row, by its index."""
    first, seen = {}, defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        s = sentence_list(text or "")
        for a in range(len(s)):
            b = a
            while b < len(s) and (b - a < 2 or sum(x[2] for x in s[a:b]) < 16):
                b += 1
            if b - a >= 2 and sum(x[2] for x in s[a:b]) >= 16:
                seen[i].append((tuple(x[3] for x in s[a:b]), s[a][0], s[b - 1][1]))
    for i in sorted(seen, key=lambda i: (rows[i][0] is None, rows[i][0])):
        for run, a, _ in seen[i]:
            first.setdefault(run, (i, a))
    return {i: {k for run, a, b in seen.get(i, ()) if first[run] != (i, a) for k in range(a, b)} for i in range(len(rows))}


# ---- naive Bayes over hashed n-grams


def bucket(gram):
    key = 0
    for c in gram:
        key = (key * 0x9E3779B97F4A7C15 + ord(c) + len(gram)) % 2**64
    key ^= key >> 29
    return key * 0xBF58476D1CE4E5B9 % 2**64 >> 48


def letters(text):
    return " " + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text) + " "


def grams_of(text):
    t = letters(text)
    return Counter(bucket(t[i : i + k]) for k in (1, 2, 3) for i in range(len(t) - k + 1))


def bayes(learn, texts):
    """(language, score) of each text; ``learn`` holds (text, lang)."""
    counts, number = defaultdict(Counter), Counter()
    for text, lang in learn:
        number[lang] += 1
        counts[lang].update(grams_of(text) if text else {})
    out = []
    for t in texts:
        if not t or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        own = grams_of(t)
        score = {}
        for lang in sorted(number):
            total = sum(counts[lang].values()) + 0.1 * 65536
            score[lang] = math.log(number[lang] / sum(number.values())) + sum(n * math.log((counts[lang][g] + 0.1) / total) for g, n in own.items())
        best = max(sorted(score), key=score.get)
        out.append((best, 1 / sum(math.exp(x - score[best]) for x in score.values())))
    return out


# ---- interpolated modified Kneser-Ney


def folded(text):
    pair = lambda n: chr(0xD800 + (n >> 10)) + chr(0xDC00 + (n & 0x3FF))
    return "".join(" " if ord(c) < 33 or 127 <= ord(c) < 161 else "0" if c in "0123456789" else pair(ord(c) - 0x10000) if ord(c) > 0xFFFF else c for c in text)


class KneserNey:
    """Characters after up to three before; starts are padded."""

    def __init__(self, texts, order=4):
        self.order, top = order, Counter()
        for t in texts:
            t = "\x02" * (order - 1) + folded(t)
            top.update(t[i : i + order] for i in range(len(t) - order + 1))
        self.level = {order: top}
        for k in range(order - 1, 0, -1):
            self.level[k] = Counter(g[1:] for g in self.level[k + 1])
        self.symbols = len(self.level[1]) + 1
        self.discount, self.total, self.left = {}, defaultdict(int), defaultdict(float)
        for k, c in self.level.items():
            n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            d = (1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 0.75, 3 - 4 * y * n4 / n3 if n3 and n4 else 0.9)
            self.discount[k] = [min(max(x, 0.1), 0.95 + i) for i, x in enumerate(d)]
            for g, v in c.items():
                self.total[g[:-1], k] += v
                self.left[g[:-1], k] += self.discount[k][min(v, 3) - 1]

    def p(self, gram):
        k = len(gram)
        below = self.p(gram[1:]) if k > 1 else 1 / self.symbols
        if not self.total[gram[:-1], k]:
            return below
        v = self.level[k][gram]
        alpha = (v - self.discount[k][min(v, 3) - 1]) / self.total[gram[:-1], k] if v else 0.0
        return alpha + self.left[gram[:-1], k] / self.total[gram[:-1], k] * below

    def log_p(self, text):
        t = "\x02" * (self.order - 1) + folded(text)
        return sum(math.log(self.p(t[i : i + self.order])) for i in range(len(t) - self.order + 1))


def quantile(values, q):
    """The value at the rank that the share names."""
    v = sorted(values)
    return v[max(0, math.ceil(q * len(v)) - 1)]


def quality(docs, trusted, reach=2):
    """doc_id -> kept, for [(doc_id, text, lang)]; limits come from trusted texts under the model of the other half of them."""
    good = [(i, t, lang or "und") for i, t, lang in docs if i in trusted and t]
    model = KneserNey([t for _, t, _ in good])
    half = lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42) & 1
    halves = [[t for _, t, _ in good if half(t) == k] for k in (0, 1)]
    models = [KneserNey(halves[1]), KneserNey(halves[0])] if all(halves) else [model, model]
    rates = [(lang, -models[half(t)].log_p(t) / len(t)) for _, t, lang in good]
    limit = {}
    for lang in {x for x, _ in rates} | {None}:
        own = [r for x, r in rates if lang in (None, x)]
        limit[lang] = quantile(own, 0.5), quantile(own, 0.99)
    out = {}
    for i, t, lang in docs:
        mid, high = limit.get(lang or "und", limit[None])
        out[i] = bool(t) and (50 * mid - model.log_p(t)) / (50 + len(t)) <= mid + reach * (high - mid)
    return out


# ---- shingles, benchmark windows, secrets


def alike_groups(texts):
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    return groups([(i, j) for i in sets for j in sets if i < j and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))], sets)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def benchmark_windows(items):
    windows = defaultdict(set)
    for k, t in items.items():
        ws = WORD.findall(lower(t))
        for i in range(max(1, len(ws) - 9)) if ws else ():
            windows[tuple(ws[i : i + 10])].add(k)
    return windows


def hit_by(text, windows):
    ws, hit, found = WORD.findall(lower(text)), set(), set()
    for n in {len(w) for w in windows}:
        for a in range(len(ws) - n + 1):
            if (w := tuple(ws[a : a + n])) in windows:
                hit |= set(range(a, a + n))
                found |= windows[w]
    return len(ws), hit, found


RULES = (
    (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 8), (re.compile("AKIA[A-Z0-9]+"), 0, 16), (re.compile("[0-9a-f]+"), 0, 32),
    (re.compile("gh[oprsu]_[A-Za-z0-9]{36,}"), 0, 0), (re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 0), (re.compile("-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), 0, 0),
)


def masked(text):
    held = [False] * len(text or "")
    starts = set()
    for regex, group, least in RULES:
        for m in regex.finditer(text or ""):
            if len(m[group]) >= least:
                starts.add(m.start())
                held[m.start() : m.end()] = [True] * (m.end() - m.start())
    if not starts:
        return text
    return "".join("" if held[i] and i and held[i - 1] else "[SECRET]" if held[i] else c for i, c in enumerate(text))


# ---- label model and classifier over votes


def logit(p):
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def vote_tree(votes, post):
    """The voter above each voter, or -1: the heaviest tree of the mutual information given the label, grown from the first voter."""
    n, m = len(votes), len(votes[0])
    gain = [[0.0] * m for _ in range(m)]
    for label in (0, 1):
        w = [p if label else 1 - p for p in post]
        total = sum(w) + 1e-9
        for i in range(m):
            for j in range(m):
                for a in (0, 1):
                    for b in (0, 1):
                        joint = max(sum(x for x, r in zip(w, votes) if r[i] == a and r[j] == b) / total, 1e-12)
                        alone = max(sum(x for x, r in zip(w, votes) if r[i] == a) * sum(x for x, r in zip(w, votes) if r[j] == b) / total**2, 1e-12)
                        gain[i][j] += total / n * joint * math.log(joint / alone)
    above, inside = [-1] * m, [0]
    while len(inside) < m:
        g, i, j = max((gain[i][j], i, j) for i in inside for j in range(m) if j not in inside)
        above[j] = i if g > 0.005 else -1
        inside.append(j)
    return above


def vote_posteriors(votes, trust, weight=50.0, silent=0.02, rounds=60):
    m = len(trust)
    post = [1 - math.prod(1 - min(t, 0.99) for v, t in zip(r, trust) if v) if any(r) else silent for r in votes]
    right = lambda rows, t: (sum(p for p in rows) + weight * t) / (len(rows) + weight)
    for step in range(rounds):
        if step % 10 == 0:
            above = vote_tree(votes, post)
        pi = sum(post) / len(post)
        of = [right([p for r, p in zip(votes, post) if r[j]], trust[j]) for j in range(m)]
        alone, beside = [], []
        for j, k in enumerate(above):
            without = [p for r, p in zip(votes, post) if r[j] and (k < 0 or not r[k])]
            both = [p for r, p in zip(votes, post) if r[j] and k >= 0 and r[k]]
            alone.append(max(0.0, logit(right(without, trust[j])) - logit(pi)))
            beside.append(max(0.0, logit(right(both, trust[j])) - logit(of[k])) if k >= 0 else 0.0)
        before = post
        post = [1 / (1 + math.exp(-(logit(pi) + sum(beside[j] if above[j] >= 0 and r[above[j]] else alone[j] for j in range(m) if r[j])))) if any(r) else silent for r in votes]
        if max(abs(a - b) for a, b in zip(post, before)) < 1e-4:
            break
    return post


def logistic(votes, post, rounds=600, ridge=2e-5):
    """(weights, bias) by gradient steps, each divided by the root of the squares so far."""
    n, m = len(votes), len(votes[0])
    mean = min(max(sum(post) / n, 1e-3), 0.999)
    w, b, sw, sb = [0.0] * m, logit(mean), [1e-6] * m, 1e-6
    for _ in range(rounds):
        e = [1 / (1 + math.exp(-(b + sum(w[j] for j in range(m) if r[j])))) - p for r, p in zip(votes, post)]
        g = [sum(x for x, r in zip(e, votes) if r[j]) / n + ridge * w[j] for j in range(m)]
        gb = sum(e) / n
        sw, sb = [s + x * x for s, x in zip(sw, g)], sb + gb * gb
        w, b = [x - 0.5 * y / math.sqrt(s) for x, y, s in zip(w, g, sw)], b - 0.5 * gb / math.sqrt(sb)
    return w, b


def chosen_voters(names, rows, labels, least, right=0.85, lift=4.0):
    """Features in the order given that are right often enough, and that stand out where those of their family before them are silent."""
    out = []
    for k, f in enumerate(names):
        held = [y for r, y in zip(rows, labels) if r[k]]
        if (sum(held) + 0.5) / (len(held) + 1) < right:
            continue
        own = f.split(":", 1)[1]
        family = [j for j in out if not f.startswith("form:") and not names[j].startswith("form:") and (own.startswith(names[j].split(":", 1)[1]) or names[j].split(":", 1)[1].startswith(own))]
        rest = [(r[k], y) for r, y in zip(rows, labels) if not any(r[j] for j in family)]
        n1, n0 = sum(y for _, y in rest), sum(not y for _, y in rest)
        a, b = sum(1 for v, y in rest if v and y), sum(1 for v, y in rest if v and not y)
        if a and n0 and (a + 0.5) / (n1 + 1) > lift * (b + 0.5) / (n0 + 1):
            share = n1 / (n1 + n0)
            if 2 * (a * math.log((a + 0.01) / ((a + b) * share)) + b * math.log((b + 0.01) / ((a + b) * (1 - share)))) > least:
                out.append(k)
    return out
