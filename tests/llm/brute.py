"""Plain Python versions of the contracts, written apart from the operators."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def spans(text, patterns, keep, order):
    out = []
    for kind, rx in patterns.items():
        for m in re.finditer(rx, text):
            if keep(kind, m):
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=order)


def said(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    def keep(kind, m):
        digits = re.sub(r"[^0-9]", "", m[0])
        if kind == "ip":
            return all(int(x) <= 255 for x in m[0].split("."))
        if kind == "card":
            total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            return 16 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    kinds = list(PII)
    return spans(text, PII, keep, lambda s: (kinds.index(s[0]), s[1]))


SECRETS = {
    "assign": r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def secrets(text):
    kinds = list(SECRETS)
    keep = lambda k, m: len(m[1]) >= 8 if k == "assign" else len(m[0]) >= (16 if k == "access" else 32)
    return spans(text, SECRETS, keep, lambda s: (s[1], kinds.index(s[0])))


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    counts = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        counts.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(prints):
    """{id: smallest id reachable} by comparing all pairs."""
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return {ids[i]: ids[root(i)] for i in range(len(ids))}


def repeats(texts, size):
    """For each text: the mask of bytes covered by a size-byte string that also starts anywhere else."""
    starts = defaultdict(list)
    for i, t in enumerate(texts):
        for p in range(len(t) - size + 1):
            starts[t[p : p + size]].append((i, p))
    masks = [np.zeros(len(t), bool) for t in texts]
    for found in starts.values():
        if len(found) > 1:
            for i, p in found:
                masks[i][p : p + size] = True
    return masks


def crc(data):
    return zlib.crc32(data)


def disclosing(texts, generalise_at=0.98, remove_at=1.0, generalise_to=0.5, support=0.6):
    """{term: (kind, label)} of the different texts, by the definitions of the operator."""
    texts = sorted(set(texts))
    words = [set(re.findall(r"[^\W_]{3,}", t.lower())) for t in texts]
    near = []
    for t in texts:
        own = set()
        for kind, a, b in pii(t):
            before, after = t[max(0, a - 161) : a], t[b : b + 161]
            before = re.sub(r"^\S+", "", before) if a > 160 else before
            after = re.sub(r"\S+$", "", after) if len(after) > 160 else after
            found = re.findall(r"[^\W_]{3,}", before.lower())[-8:] + re.findall(r"[^\W_]{3,}", after.lower())[:8]
            value = t[a:b].lower() if kind == "email" else t[a:b] if kind == "ip" else re.sub("[^0-9]", "", t[a:b])
            own |= {(f"{kind}:{value}", None), *((f"{kind}:{value}", w) for w in found)}
        near.append(own)
    n = len(texts)
    pairs = {p for own in near for p in own if p[1]}
    out, least = {}, {}
    for c, t in pairs:
        n_c, n_ct, n_t = sum((c, None) in own for own in near), sum((c, t) in own for own in near), sum(t in w for w in words)
        information = math.log(n / n_c)
        strength = math.log(min(n_ct, n_t) * n / (n_c * n_t)) / information if information > 0 else 0
        if strength >= generalise_at - 1e-9:
            gone = strength >= remove_at - 1e-9 and (min(n_ct, n_t) + n_c / n) / (n_t + 1) >= support
            out[t] = gone or out.get(t, False)
            least[t] = max(least.get(t, 0), n * (n_c / n) ** generalise_to)
    standing = [{t for _, t in own if t} for own in near]

    def label(t):
        for k in range(min(12, len(t) - 1), 0, -1):
            if sum(any(w.startswith(t[:k]) and len(w) > k for w in own) for own in standing) >= least[t] * (1 - 1e-9):
                return f"[{t[:k]}*]"
        return "[TERM]"

    return {t: ("remove", "") if gone else ("generalise", label(t)) for t, gone in out.items()}
