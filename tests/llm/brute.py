"""Plain Python versions of what the operators compute."""

import math
import re
from collections import Counter
from functools import cache
from itertools import combinations

import zstandard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def near_groups(rows, k, percent):
    """{row number: (set size, component, kept)} of (doc_id, text) rows with distinct or equal ids."""
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if d is not None else []
        component = min(members) if members else None
        out[i] = (len(sets[i]), component, d is None or d == component)
    return out


def repeated(rows, length):
    """{doc_id: (positions of repeated words, words)} of (doc_id, text) rows, in order of doc_id."""
    first, out = {}, {}
    for d, t in sorted(rows):
        w, at = words(t), set()
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            seen = first.setdefault(key, (d, i))
            if seen != (d, i) and (seen[0] != d or seen[1] + length <= i):
                at.update(range(i, i + length))
        out[d] = at
    return out


def cut(text, at):
    """``text`` without its words at the positions ``at``; white space inside a cut run goes too."""
    data, found = text, list(WORD.finditer(text.translate(LOWER)))
    kept, pos, i = [], 0, 0
    while i < len(found):
        if i in at:
            j = i
            while j + 1 in at:
                j += 1
            kept.append(data[pos : found[i].start()])
            pos, i = found[j].end(), j
        i += 1
    return "".join(kept) + data[pos:]


def multiset(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def weighted(a, b, k):
    x, y = multiset(a, k), multiset(b, k)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def contaminated(text, items, k, percent):
    """Ids of the items that some item-sized window of the text reaches."""
    w, out = words(text), []
    for item_id, t in items:
        v = words(t)
        n = len(v)
        if v and any(100 * weighted(w[max(0, s) : s + n], v, k) >= percent for s in range(-n + 1, len(w)) if w[max(0, s) : s + n]):
            out.append(item_id)
    return sorted(out)


@cache
def codecs(*contents):
    out = []
    for content in contents:
        how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=18, hash_log=18, search_log=6, min_match=4, target_length=16, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        out.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d))
    return out


def toxic_score(text, model):
    """A toxicity model's score: how many bytes each window of 8 words saves with one dictionary over the other."""
    if model.weights is None:
        return model.base
    w = (text or "").lower().split()
    cut = [(" " + " ".join(w[i : i + 8]) + " ").encode() for i in range(0, max(1, len(w)), 8)]
    packed = [[len(codec.compress(x)) for x in cut] for codec in codecs(model.ordinary, model.toxic)]
    saved = sorted((a - b for a, b in zip(*packed)), reverse=True)
    n, over = len(saved), lambda x: sum(s >= x for s in saved)
    x = [saved[0], saved[1] if n > 1 else 0, min(saved[0], 4), sum(saved) / n, over(3) / n, over(6) / n, math.sqrt(over(3)), math.sqrt(over(6)), math.log1p(n)]
    z = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(x, model.mean, model.scale)]
    p = 1 / (1 + math.exp(-sum(a * b for a, b in zip([*z, 1], model.weights))))
    return p if saved[0] > 0 else min(p, model.base)


def grams(text):
    """Hashed 2-, 3- and 4-grams of the bytes of words, a word's ends counting as a byte 0."""
    raw = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    raw = [0 if b == 32 or 9 <= b <= 13 else b for b in raw]
    out = Counter()
    for k in (2, 3, 4):
        for i in range(len(raw) - k + 1):
            if all(raw[i + 1 : i + k - 1]):
                h = 0
                for b in raw[i : i + k]:
                    h = (h * 0x01000193 + b) & 0xFFFFFFFF
                out[((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 20] += 1
    return out


def vote(v, x):
    if len(v.classes) == 1:
        return v.classes[0], 1.0
    support = Counter()
    for p, (a, b) in enumerate(combinations(v.classes, 2)):
        s = 1 / (1 + math.exp(-min(30, max(-30, v.slope[p] * (v.bias[p] + sum(n * float(v.weights[g, p]) for g, n in x.items()))))))
        support[a] += s
        support[b] += 1 - s
    best = max(v.classes, key=lambda c: support[c])
    return best, support[best] / (len(v.classes) - 1)


def language(text, model):
    """A language model's choice and score for one text."""
    if not text or not any(map(str.isalpha, text)) or model.families is None:
        return "und", 0.0
    found = grams(text)
    x = {g: n / sum(found.values()) for g, n in found.items()}
    family, support = vote(model.families, x)
    lang, near = vote(model.languages[family], x)
    return lang, support * near
