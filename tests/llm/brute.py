"""Plain-Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

SPACE_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LETTER_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").encode().lower()


def words(text):
    return SPACE_WORDS.findall((text or "").encode())


def shingles(text, n):
    w = SPACE_WORDS.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1)))


def join(docs, n, num, den):
    """[(doc_id, text)] -> sorted (doc_id, set size, component_id)."""
    sets = [shingles(t, n) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * den >= num * max(len(sets[i]), len(sets[j])):
            both = len(sets[i] & sets[j])
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(docs):
        r = root(i)
        if doc_id is not None:
            smallest[r] = min(smallest.get(r, doc_id), doc_id)
    return sorted(((d, len(s), smallest.get(root(i))) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=repr)


def repeats(docs, window=20):
    """[(doc_id, text)] -> sorted (doc_id, n_words, n_removed, kept_sha256)."""
    last = float("inf")
    lists = [(last if d is None else d, words(t)) for d, t in docs]
    first = {}
    for d, w in lists:
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, (last, last)), (d, i))
    out = []
    for (doc_id, _), (d, w) in zip(docs, lists):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < (d, i):
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def contamination(docs, items, window=13):
    """Sorted (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    phrases = {}
    for item, text in items:
        w = LETTER_WORDS.findall(lower(text))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            phrases.setdefault(tuple(w[i:i + window]), set()).add("" if item is None else str(item))
    lengths = {len(p) for p in phrases}
    out = []
    for doc_id, text in docs:
        w = LETTER_WORDS.findall(lower(text))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i:i + n])) in phrases:
                    hit.update(range(i, i + n))
                    found |= phrases[p]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def crc(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode())


def language_model(docs, mix):
    """Sorted (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) with exactly quantised pair counts."""
    lists = [(d, d is not None and crc(d) % 7 == 2, [*SPACE_WORDS.findall(lower(t)), None]) for d, t in docs]
    single, pair = Counter(), Counter()
    for _, held, w in lists:
        if not held:
            single.update(w)
            pair.update(zip([None, *w], w))
    n, v = sum(single.values()), len(single)
    out = []
    for d, held, w in lists:
        base = [(single[x] + 1) / (n + v + 1) for x in w]
        p = []
        for before, x, b in zip([None, *w], w, base):
            c = pair[before, x]
            c = 2 ** int(math.log2(c)) if c else 0
            p.append(mix * min(c, single[before]) / single[before] + (1 - mix) * b if single[before] else b)
        out.append((d, held, len(w), sum(single[x] > 0 for x in w), n, sum(map(math.log10, base)), sum(map(math.log10, p))))
    return sorted(out, key=repr)


def top_k(vectors, every, k):
    """[(vec_id, components or None)] -> sorted (query_id, rank, vec_id, score)."""
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in usable if i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)
