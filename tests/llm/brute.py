"""Slow and plain versions of operators, for comparison."""

import hashlib
import math
import struct

import xxhash


def spark_hash(*values):
    """xxhash64 as Spark chains it over columns: texts, and whole numbers of 4 ("i", n) or 8 bytes."""
    h = 42
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def mix_weights(tokens, target_entropy, max_repeats, budget):
    """Weights by source and the budget that is spent, found on a fine walk over exponents instead of by bisection."""
    p = {s: n / sum(tokens.values()) for s, n in tokens.items()}

    def at(a):
        w = {s: x**a for s, x in p.items()}
        norm = sum(w.values())
        w = {s: x / norm for s, x in w.items()}
        return w, -sum(x * math.log(x) for x in w.values() if x), max(budget * w[s] / tokens[s] for s in w)

    goal = target_entropy * math.log(len(p))
    a = max((x / 2000 for x in range(0, 40_000)), key=lambda x: (at(x)[1] >= goal - 1e-9, x)) if at(0)[1] >= goal else 0
    steps = range(2001)
    ways = [1 + (a - 1) * i / 2000 for i in steps]
    held = [x for x in ways if at(x)[2] <= max_repeats + 1e-9]
    return at(held[-1])[0] if held else at(1)[0]


def mix_stream(rows, weights, budget, seed=1):
    """(source, place, id, epoch) of each emission. rows: id, text, source; a source's rows come in whole epochs, each in an order of blocks of its own, until one no longer fits its budget."""
    out = []
    sources = {}
    for i, text, source in rows:
        name = "null" if source is None else "=" + source
        key = spark_hash(("i", seed), i, text)
        sources.setdefault(name, []).append((key, len((text or "").split()), i))
    for name, held in sources.items():
        if not sum(n for _, n, _ in held):
            out += [(name, i, 0) for _, _, i in held]
            continue
        left, epoch = math.floor(weights[name] * budget * (1 + 1e-9) + 1e-6), 0
        going = True
        while going:
            order = sorted(held, key=lambda r: (signed(spark_hash(("i", seed), "block", epoch, name, ("i", r[0] >> 54))), r[0] >> 54, r[0]))
            groups = {}
            for key, n, i in order:  # rows alike in id and text stand or fall together
                groups.setdefault(key, []).append((n, i))
            for same in groups.values():
                if sum(n for n, _ in same) > left:
                    going = False
                    break
                left -= sum(n for n, _ in same)
                out += [(name, i, epoch) for _, i in same]
            epoch += 1
    return sorted(out, key=str)


def repeats(rows):
    """By id: n_bytes, n_removed, n_spans, sha256 and what is left of each text. Rows without an id come last, by a hash of their text."""
    first, out = {}, {}
    texts = [(2**62 + (spark_hash(t or "") >> 2) if i is None else i, i, (t or "").encode()) for i, t in rows]
    for k, _, b in texts:
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            first[w] = min(first.get(w, (k, p)), (k, p))
    for k, i, b in texts:
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] != (k, p):
                cover[p : p + 100] = b"\1" * 100
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        spans = sum(c and not (at and cover[at - 1]) for at, c in enumerate(cover))
        out.setdefault(i, []).append((len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return {k: sorted(v) for k, v in out.items()}


def similar_classes(texts, similarity=0.8):
    """For each text the place of the first one that it is linked to, directly or over others, by five words in a row."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or (sets[i] and sets[j] and both >= similarity * (len(sets[i]) + len(sets[j]) - both)):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(sets))]


def unigram_count(word, pieces, byte_score):
    """Pieces of a word's best path, over all ends and all pieces, without sharing."""
    best = [(0.0, 0)]
    longest = max(map(len, pieces))
    for i in range(1, len(word) + 1):
        size = len(word[i - 1].encode())
        at = (best[i - 1][0] + size * byte_score, best[i - 1][1] + size)
        for j in range(i - 1, max(-1, i - longest - 1), -1):
            s = pieces.get(word[j:i])
            if s is not None and best[j][0] + s >= at[0]:
                at = (best[j][0] + s, best[j][1] + 1)
        best.append(at)
    return best[-1][1]
