"""Plain Python versions of the operators."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def stats(text):
    text = text or ""
    w = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeat = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeat)}


def substrings(docs, length=100):
    """(n_bytes, n_removed, n_spans, sha256) of each text, in order."""
    seen, out = set(), []
    for text in docs:
        b = (text or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                covered[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out.append((len(b), sum(covered), sum(1 for k, _ in itertools.groupby(covered) if k), hashlib.sha256(kept).hexdigest()))
    return out


def weighted(docs):
    """TF-IDF elements of each text: (shingle, occurrence) to weight."""
    bags = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else collections.Counter() for t in docs]
    df = collections.Counter(s for b in bags for s in b)
    n = sum(bool(b) for b in bags)
    idf = {s: (1 + max(0.0, math.log((n + 1) / (c + 1))) / math.log(n + 2)) / 2 for s, c in df.items()}
    return [{(s, k): idf[s] for s, c in b.items() for k in range(c)} for b in bags]


def jaccard(a, b):
    common = sum(v for k, v in a.items() if k in b)
    return common / max(sum(a.values()) + sum(b.values()) - common, 1e-12)


def near_classes(docs, threshold=0.8):
    """Class (smallest index) of each text."""
    bags, up = weighted(docs), list(range(len(docs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        if bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= threshold:
            a, b = sorted((top(i), top(j)))
            up[b] = a
    return [top(i) for i in range(len(docs))]


def line_runs(docs, span=20):
    """Kept text of each text, in order: a run of ``span`` words is the union of the shortest ones from and up to its lines."""
    seen, out = set(), []
    for text in docs:
        if text is None:
            out.append(None)
            continue
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if words(x)]
        gone = set()
        size = [len(words(lines[i])) for i in full]
        for step in (1, -1):
            for a in range(len(full)):
                n, b = 0, a
                while 0 <= b < len(full) and n < span:
                    n += size[b]
                    b += step
                if n >= span:
                    low, high = sorted((a, b - step))
                    key = (step, *(lines[i] for i in full[low : high + 1]))
                    if key in seen:
                        gone.update(range(full[low], full[high] + 1))
                    seen.add(key)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def base_scores(rows):
    """doc_id to (n_tokens, n_known, train_tokens, base score)."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {i: [*words((t or "").translate(lower)), None] for i, t in rows}
    count = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    return {i: (len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tokens.items()}


def tree_scores(rows, least, most, share, depth, divergence, discount):
    """doc_id to the log10 probability of the text by a plain suffix tree: contexts are tuples of symbols, None is the end, 0 any rarer word."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {i: [*words((t or "").translate(lower)), None] for i, t in rows}
    train = [ws for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for ws in train for w in ws)
    mass = sum(count.values()) + 0.1 * (len(count) + 1)
    while sum(c >= least for c in count.values()) > most:
        least *= 2
    symbols = {w for w, c in count.items() if c >= least} | {None}
    sym = lambda w: w if w in symbols else 0
    root = {w: (count[w] + 0.1) / mass for w in symbols}
    root[0] = max(1 - sum(root.values()), 0.1 / mass)
    rare = max(mass - sum(count[w] + 0.1 for w in symbols), 0.1)
    levels, kept, shares, rest = [], set(), {}, {}

    def probability(before, x):
        p = root[x]
        for k in range(1, depth + 1):
            c = before[len(before) - k :] if len(before) >= k else None
            if c in kept:
                p = shares[c].get(x, 0.0) + rest[c] * p
        return p

    candidates = {(s,) for s in root}
    for k in range(1, depth + 1):
        follow = collections.defaultdict(collections.Counter)
        for ws in train:
            s = [None, *map(sym, ws)]
            for i in range(k, len(s)):
                if tuple(s[i - k : i]) in candidates:
                    follow[tuple(s[i - k : i])][s[i]] += 1
        low = max(2.0, least * share)
        while sum(c >= low for f in follow.values() for c in f.values()) > most:
            low *= 2
        levels.append(candidates)
        new, longer = set(), set()
        for c in candidates:
            total = max(sum(follow[c].values()), 1)
            entries = {x: n for x, n in follow[c].items() if n >= low}
            shares[c] = {x: max(n - discount, 0) / total for x, n in entries.items()}
            rest[c] = max(1 - sum(shares[c].values()), 0)
            short = {x: probability(c[1:], x) for x in entries}
            gain = sum(n / total * math.log(n / total / short[x]) for x, n in entries.items())
            left = max(1 - sum(entries.values()) / total, 0)
            if left > 1e-12:
                gain += left * math.log(left / max(1 - sum(short.values()), 1e-12))
            if gain >= divergence and total >= least:
                new.add(c)
            longer |= {(*c, x) for x, n in entries.items() if n >= least and x is not None and (*c[1:], x) in candidates}
        kept |= new
        candidates = longer
    for k in range(depth, 1, -1):
        kept |= {c[1:] for c in kept if len(c) == k}

    def score(ws):
        s, total = [None, *map(sym, ws)], 0.0
        for i, w in enumerate(ws, 1):
            p = probability(tuple(s[max(0, i - depth) : i]), s[i])
            total += math.log10(p * ((count[w] + 0.1) / rare if s[i] == 0 else 1.0))
        return total

    return {i: score(ws) for i, ws in tokens.items()}


def targets(sizes, weights, most=3):
    out, free, rest = {}, dict(enumerate(sizes)), sum(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / total > most * sizes[i]]
        if not over:
            out |= {i: rest * weights[i] / total for i in free}
            break
        for i in over:
            out[i] = most * sizes[i]
            del free[i]
        rest -= sum(most * sizes[i] for i in over)
    return [out[i] for i in range(len(sizes))]


def sainte_lague(votes, seats, caps):
    got = [0] * len(votes)
    for _ in range(seats):
        fit = [i for i in range(len(votes)) if got[i] < caps[i] and votes[i] > 0]
        if not fit:
            break
        got[max(fit, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
    return got
