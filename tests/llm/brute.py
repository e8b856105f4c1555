"""Plain Python versions of the operators, for small inputs."""

import collections
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def generalised_jaccard(a, b):
    a, b = collections.Counter(words(lower(a))), collections.Counter(words(lower(b)))
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def rules(text):
    found = words(text)
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    counts = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def shingles(text, k=5):
    w = words(lower(text))
    return frozenset([tuple(w)] if 0 < len(w) < k else (tuple(w[i : i + k]) for i in range(len(w) - k + 1)))


def components(ids, texts):
    sets, inverted = [shingles(t) for t in texts], collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in inverted[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)), key=lambda r: ids[r])
                root[b] = a
    return [len(s) for s in sets], [ids[find(i)] for i in range(len(ids))]


def targets(sizes, weights, cap):
    """Water filling by rounds."""
    rest, open_, out = float(sum(sizes.values())), dict(weights), {}
    while open_:
        level = rest / sum(open_.values())
        full = [s for s in open_ if cap * sizes[s] <= open_[s] * level]
        if not full:
            return out | {s: w * level for s, w in open_.items()}
        for s in full:
            out[s] = float(cap * sizes[s])
            rest -= out[s]
            del open_[s]
    return out


def tokens(text):
    return [*words(lower(text)), "</s>"]


def language_model(rows, held_out=1, folds=5):
    one, two = collections.Counter(), collections.Counter()
    for doc_id, text in rows:
        if fold(doc_id, folds) != held_out:
            t = tokens(text)
            one.update(t)
            two.update(zip(["<s>", *t[:-1]], t, strict=True))
    return one, two


def language_scores(text, one, two, weights, buckets):
    n, v, t = sum(one.values()), len(one), tokens(text)
    base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
    total = 0.0
    for h, w in zip(["<s>", *t[:-1]], t, strict=True):
        context = one["</s>"] if h == "<s>" else one[h]
        a = weights[min(int(math.floor(math.log2(context + 1))), buckets - 1)]
        total += math.log10(a[0] / (v + 1) + a[1] * one[w] / max(n, 1) + a[2] * two[h, w] / max(context, 1))
    return len(t), sum(one[w] > 0 for w in t), n, base, total


LETTERS = re.compile("[A-Za-z\u00c0-\u00ff]+")


def vocabulary(rows, shortest=5, least=3):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run if h % 97 else run[:at] + run[at + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def variants(rows):
    """word, form, root, n, n_near, form_n by comparing the words that agree but for one place."""
    counts = vocabulary(rows)
    without, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            without[w[:i], w[i + 1 :]].add(w)
    for (a, b), group in without.items():
        for w in group:
            near[w] |= group - {w}
            if a + b in counts:
                near[w].add(a + b)
                near[a + b].add(w)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 2 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return [(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()]


def aligned_groups(a_lengths, b_lengths):
    """[(tokens of A, tokens of B)] by walking both lists of lengths."""
    out, i, j, at_a, at_b = [], 0, 0, 0, 0
    while i < len(a_lengths):
        first = i, j
        at_a, i = at_a + a_lengths[i], i + 1
        at_b, j = at_b + b_lengths[j], j + 1
        while at_a != at_b:
            if at_a < at_b:
                at_a, i = at_a + a_lengths[i], i + 1
            else:
                at_b, j = at_b + b_lengths[j], j + 1
        out.append((range(first[0], i), range(first[1], j)))
    return out
