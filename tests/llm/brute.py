"""Plain Python counterparts of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import xxhash


def lower_ascii(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t))


def space_words(t, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(t) if lower else (t or ""))


def contamination(docs, items, window=10):
    phrases = collections.defaultdict(set)
    for i, t in items:
        w = alnum_words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            phrases[tuple(w[a : a + k])].add(i)
    sizes = {len(p) for p in phrases}
    out = []
    for d, t in docs:
        w, hit, found = alnum_words(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in phrases:
                    hit.update(range(a, a + k))
                    found |= phrases[tuple(w[a : a + k])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def repeats(docs, length=100):
    """docs in order of id."""
    seen, out = set(), []
    for d, t in docs:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                cover[p : p + length] = b"\x01" * length
            seen.add(s)
        spans = sum(1 for i in range(len(cover)) if cover[i] and (not i or not cover[i - 1]))
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((d, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def fingerprint(t, width=3):
    w = space_words(t)
    grams = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_groups(docs, radius=3):
    prints = {d: fingerprint(t) for d, t in docs}
    s = Sets(prints)
    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                s.join(a, b)
    return {d: (f"{prints[d]:016x}", s.find(d)) for d in prints}


def jaccard_groups(docs, width=5, similarity=0.8):
    def grams(t):
        w = space_words(t)
        return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = {d: grams(t) for d, t in docs}
    s = Sets(sets)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or (x | y and len(x & y) >= similarity * len(x | y)):
                s.join(a, b)
    return {d: s.find(d) for d in sets}


def kneser_ney(docs, held_out):
    """(n_tokens, n_known, train_tokens, base, score) of each document by a trigram model of the others."""
    toks = {d: space_words(t) + ["</end>"] for d, t in docs}
    uni, tri = collections.Counter(), collections.Counter()
    for d, w in toks.items():
        if not held_out(d):
            uni.update(w)
            tri.update(zip(["<begin>", "<begin>", *w][: len(w)], ["<begin>", *w][: len(w)], w, strict=True))
    n, v = sum(uni.values()), len(uni)

    def disc(c):
        m = [sum(1 for x in c if x == k) for k in (1, 2, 3, 4)]
        if not (m[0] and m[1]):
            return [0, 0.5, 1.0, 1.5]
        y = m[0] / (m[0] + 2 * m[1])
        d3 = 3 - 4 * y * m[3] / m[2] if m[2] else 1.5
        return [0, min(max(1 - 2 * y * m[1] / m[0], 0), 1), min(max(2 - 3 * y * m[2] / m[1], 0), 2), min(max(d3, 0), 3)]

    def level(counts):
        """Counts of n-grams, what follows each context, counts one order lower by different words before, and discounts."""
        after, lower = collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
        for g, c in counts.items():
            after[g[:-1]][0] += c
            after[g[:-1]][min(c, 3)] += 1
            lower[g[1:]] += 1
        return counts, after, lower, disc(list(counts.values()))

    three, after3, pairs, d3 = level(tri)
    two, after2, ones, d2 = level(pairs)
    d1, total = disc(list(ones.values())), sum(ones.values())
    free = sum(d1[min(c, 3)] for c in ones.values()) / total if total else 1.0

    def p(g):
        if len(g) == 1:
            return (ones[g] - d1[min(ones[g], 3)]) / max(total, 1) + free / (v + 1)
        counts, after, d = (three, after3, d3) if len(g) == 3 else (two, after2, d2)
        low = p(g[1:])
        if g[:-1] not in after:
            return low
        s, c = after[g[:-1]], counts[g]
        return (c - d[min(c, 3)]) / s[0] + sum(d[k] * s[k] for k in (1, 2, 3)) / s[0] * low

    out = {}
    for d, w in toks.items():
        base = sum(math.log10((uni[x] + 1) / ((n + v + 1) or 1)) for x in w)
        logs = sum(math.log10(p(g)) for g in zip(["<begin>", "<begin>", *w][: len(w)], ["<begin>", *w][: len(w)], w, strict=True))
        out[d] = len(w), sum(uni[x] > 0 for x in w), n, base, logs
    return out


def base_rules(t):
    w = space_words(t, lower=False)
    symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = set()
    for k in range(len(w) - 7):
        if c[tuple(w[k : k + 8])] > 1:
            cover.update(range(k, k + 8))
    return len(w), sum(map(len, w)), symbols, dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def base_licenses(t, phrases):
    w, places, labels = alnum_words(t), [], set()
    for p, name in phrases.items():
        k = p.split()
        for a in range(len(w) - len(k) + 1):
            if w[a : a + len(k)] == k:
                places.append(a)
                labels.add(name)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def template_pattern(template):
    """A template with markup as a regular expression over words that are each followed by a space."""
    import re

    out, at = [], 0
    word = lambda part: "".join(re.escape(w) + " " for w in alnum_words(part))
    for m in re.finditer(r"<<(beginOptional|endOptional|var;words=(\d+)-(\d+))>>", template):
        out.append(word(template[at : m.start()]))
        at = m.end()
        out.append({"b": "(?:", "e": ")?"}.get(m[1][0]) or f"(?:[^ ]+ ){{{m[2]},{m[3]}}}")
    return re.compile("(?<![^ ])" + "".join(out) + word(template[at:]))


def license_labels(text, templates):
    line = "".join(w + " " for w in alnum_words(text))
    return {label for label, t in templates if template_pattern(t).search(line)}


def target_ratios(docs, trusted, buckets=1 << 15):
    """Of each document the mean log ratio of its hashed n-grams, target against raw, in whole thousandths a bucket."""
    import xxhash

    def long(h, seed):
        return xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)

    def grams(t):
        w = space_words(t, lower=False)
        one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        two = [0 if a == b else long(b, long(a, 42)) for a, b in zip(one, one[1:], strict=False)]
        end = [xxhash.xxh64_intdigest((3).to_bytes(4, "little"), xxhash.xxh64_intdigest(x[-3:].encode(), 42)) for x in w]
        return [h % buckets for h in one + two + end]

    each = [(d, grams(t)) for d, t in docs]
    raw, target = [1] * buckets, [1] * buckets
    for d, g in each:
        for x in g:
            raw[x] += 1
            target[x] += d in trusted
    if sum(target) == buckets:
        return [(d, 0.0) for d, _ in each]
    apart = math.log(sum(raw) / sum(target))
    weight = [round(1000 * (math.log(t / r) + apart)) for t, r in zip(target, raw, strict=True)]
    return [(d, sum(weight[x] for x in g) / (1000 * len(g)) if g else 0.0) for d, g in each]


def mixed(rows, budget=0.75, seed=20_240_101, targets=None, rounds=100):
    """rows (id, text, source, lang): of each its tokens, source, language, topic, probability, weight and whether it is kept."""
    import numpy as np
    from tamis.llm.textbytes import LOWER, NONSPACE, word_bounds, word_hashes

    def bucket(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return int(word_hashes(raw, *word_bounds(raw, np.array([0, len(raw)]), NONSPACE)[:2])[0] >> np.uint64(48))

    said = [collections.Counter(bucket(w) for w in space_words(t) if len(w.encode()) >= 5) for _, t, _, _ in rows]
    have = collections.Counter(b for c in said for b in c)
    common = sorted((b for b, n in have.items() if n <= 0.1 * len(rows)), key=lambda b: (-have[b], b))[:24]
    rare = {b: math.log(len(rows) / have[b]) for b in common}
    topics = []
    for c in said:
        own = [(-c[b] * rare[b], b) for b in common if b in c]
        topics.append(f"topic-{min(own)[1]:04x}" if own else "(other)")
    tokens = [len(space_words(t, lower=False)) for _, t, _, _ in rows]
    keys = [(s or "(none)", g or "(none)", k) for (_, _, s, g), k in zip(rows, topics, strict=True)]
    cell = collections.Counter()
    for k, n in zip(keys, tokens, strict=True):
        cell[k] += n
    total = sum(cell.values())
    wants = []
    for m, power in enumerate((0.5, 0.7, 0.7)):
        sums = collections.Counter()
        for k, n in cell.items():
            sums[k[m]] += n
        all_ = sum(n**power for n in sums.values()) or 1.0
        want = {k: n**power / all_ for k, n in sums.items()}
        given = (targets or {}).get(("source", "lang", "topic")[m])
        if given:
            want = {k: given.get(k, v) for k, v in want.items()}
            want = {k: v / sum(want.values()) for k, v in want.items()}
        wants.append(want)
    w = dict.fromkeys(cell, 1.0)
    for _ in range(rounds if total else 0):
        off = 0.0
        for m, want in enumerate(wants):
            now = collections.Counter()
            for k in cell:
                now[k[m]] += cell[k] * w[k] / total
            off = max([off] + [abs(now[k] - want[k]) for k in now if now[k] > 0])
            for k in cell:
                if now[k[m]] > 0:
                    w[k] *= want[k[m]] / now[k[m]]
        if off < 1e-9:
            break
    some = [k for k in cell if cell[k] and w[k] > 0]
    low, high = 0.0, max([1 / w[k] for k in some], default=1.0)
    if some and budget < 1:
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(cell[k] * min(1, mid * w[k]) for k in some) < budget * total else (low, mid)
    rate = high
    out = []
    for (i, _, _, _), k, n in zip(rows, keys, tokens, strict=True):
        p = min(1.0, rate * w[k])
        inner = 42 if i is None else xxhash.xxh64_intdigest((i % 2**64).to_bytes(8, "little"), 42)
        u = (xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), inner) >> 11) / 2**53
        out.append((i, n, *k, p, rate * w[k] / p if rate * w[k] > 0 else 1.0, u < p))
    return out


def cut_repeats(rows, length=100):
    """rows (id, text) in order of place: texts without what also starts earlier, None where nothing is left of a text."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                cover[p : p + length] = b"\x01" * length
            seen.add(s)
        if not any(cover):
            out.append((i, t, True))
        else:
            rest = bytes(x for x, c in zip(b, cover, strict=True) if not c).decode(errors="ignore")
            out.append((i, rest, bool(rest.strip())))
    return out


def cut_passages(text, phrases, sizes):
    """A text without the passages of a benchmark, from the first byte of a passage's first word to the last of its last; None where no word is left."""
    low = lower_ascii(text)
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
    w, hit = [low[a:b] for a, b in places], set()
    for k in sizes:
        for a in range(len(w) - k + 1):
            if tuple(w[a : a + k]) in phrases:
                hit.update(range(a, a + k))
    if not hit:
        return text
    if len(hit) == len(w):
        return None
    out, at = [], 0
    for j in sorted(hit):
        if j - 1 not in hit:
            out.append(text[at : places[j][0]])
        at = places[j][1]
    return "".join(out) + text[at:]


def pipeline(docs, trusted, items, window=10):
    """docs (id, text, source, lang): the rows that the five stages leave, as ``mixed`` gives them, with their texts."""
    ratio = target_ratios([(k, t) for k, (_, t, _, _) in enumerate(docs)], {k for k, d in enumerate(docs) if d[0] in trusted and d[0] is not None})
    docs = [d for d, (_, x) in zip(docs, ratio, strict=True) if not base_rules(d[1])[5] and x >= -0.25]
    group = jaccard_groups([(k, d[1]) for k, d in enumerate(docs)])
    order = lambda k: (docs[k][0] is None, docs[k][0] or 0, k)
    heads = {}
    for k, c in group.items():
        heads[c] = min(heads.get(c, k), k, key=order)
    docs = sorted((docs[k] for k in heads.values()), key=lambda d: (d[0] is None, d[0] or 0, hashlib.sha256((d[1] or "").encode()).digest()))
    docs = [(d[0], t, *d[2:]) for d, (_, t, keep) in zip(docs, cut_repeats([(d[0], d[1]) for d in docs]), strict=True) if keep]
    phrases = set()
    for _, t in items:
        w = alnum_words(t)
        k = min(window, len(w))
        phrases |= {tuple(w[a : a + k]) for a in range(len(w) - k + 1 if k else 0)}
    docs = [(d[0], cut_passages(d[1], phrases, {len(p) for p in phrases}), *d[2:]) for d in docs]
    docs = [d for d in docs if d[1] is not None]
    return [(*m, d[1]) for m, d in zip(mixed(docs), docs, strict=True) if m[7]]
