"""Plain versions of the operators, for small tables."""

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width=5):
    words = WORD.findall(lowered(text))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_duplicates(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    keys = sorted(sets)
    edges = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    found = components(keys, edges)
    return {k: (len(sets[k]), found[k], found[k] == k) for k in keys}


def base_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered), n < 50 or 100 * len(covered) > 50 * n


def ngram_scores(texts, strengths):
    """Interpolated n-grams by counting whole tuples; ``strengths`` are those of contexts of one word, two words and so on."""
    end, start, order = object(), object(), len(strengths) + 1
    tokens = {k: WORD.findall(lowered(t)) + [end] for k, t in texts.items()}
    out_of = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in texts}
    grams, contexts = Counter(), Counter()
    for k, t in tokens.items():
        padded = [start] * (order - 1) + t
        for at in range(order - 1, len(padded)) if not out_of[k] else ():
            for length in range(order):
                grams[tuple(padded[at - length : at + 1])] += 1
                contexts[tuple(padded[at - length : at])] += 1
    n, v = contexts[()], sum(len(g) == 1 for g in grams)
    out = {}
    for k, t in tokens.items():
        padded, base, score = [start] * (order - 1) + t, 0.0, 0.0
        for at in range(order - 1, len(padded)):
            p = (grams[(padded[at],)] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for length, strength in enumerate(strengths, 1):
                p = (grams[tuple(padded[at - length : at + 1])] + strength * p) / (contexts[tuple(padded[at - length : at])] + strength)
            score += math.log10(p)
        out[k] = out_of[k], len(t), sum(grams[(x,)] > 0 for x in t), n, base, score
    return out


def jump(key, buckets):
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def best_fit(lengths, capacity=4096):
    """Number of sequences that best-fit decreasing needs, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        rooms.insert(bisect_left(rooms, room - n), room - n)
    return len(rooms)


def plain_label_model(rows, rounds):
    """Prior and vote probabilities by expectation-maximisation, document by document; votes are 1 good, 0 bad, 2 none."""
    belief = []
    for votes in rows:
        said = [v for v in votes if v != 2]
        start = (said.count(1) + 1) / (len(said) + 2)
        belief.append(min(start, 0.4) if 0 in said else max(start, 0.6))
    wide = len(rows[0])
    for _ in range(rounds):
        good = sum(belief)
        prior = (good + 1) / (len(rows) + 2)
        given = [[[0.0] * 3 for _ in range(wide)] for _ in range(2)]
        for label, total in ((0, len(rows) - good), (1, good)):
            for k in range(wide):
                for v in range(3):
                    held = sum((b if label else 1 - b) for b, votes in zip(belief, rows) if votes[k] == v)
                    given[label][k][v] = (held + 1) / (total + 3)
        last, belief = belief, []
        for votes in rows:
            odds = math.log(prior / (1 - prior))
            for k, v in enumerate(votes):
                if v != 2:
                    odds += math.log(given[1][k][v] / (given[1][k][0] + given[1][k][1])) - math.log(given[0][k][v] / (given[0][k][0] + given[0][k][1]))
            belief.append(1 / (1 + math.exp(-max(-40, min(40, odds)))))
        if max(abs(a - b) for a, b in zip(belief, last)) < 1e-9:
            break
    return prior, given


def plain_regression(rows, target, rounds, rate, shrink):
    """Logistic regression by full gradients with adaptive steps, on tables of weights."""
    weights, bias, squares, square = {}, 0.0, {}, 1e-8
    share = min(0.98, max(0.02, sum(target) / len(target)))
    worth = [t / (2 * share) + (1 - t) / (2 * (1 - share)) for t in target]
    for places, _ in rows:
        weights |= dict.fromkeys(places, 0.0)
    squares = dict.fromkeys(weights, 1e-8)
    for _ in range(rounds):
        errors = [w * (t - 1 / (1 + math.exp(-(bias + sum(weights[p] * v for p, v in zip(*row)))))) / len(rows) for w, t, row in zip(worth, target, rows)]
        slope = {p: -shrink * w for p, w in weights.items()}
        for e, (places, values) in zip(errors, rows):
            for p, v in zip(places, values):
                slope[p] += e * v
        for p, g in slope.items():
            squares[p] += g * g
            weights[p] += rate * g / math.sqrt(squares[p])
        square += sum(errors) ** 2
        bias += rate * sum(errors) / math.sqrt(square)
    return weights, bias
