"""Plain versions of the operators, a document at a time, to compare with."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import xxhash

WHITE = b" \t\n\x0b\x0c\r"


def words(text):
    out, word = [], b""
    for c in (text or "").encode():
        if c in WHITE:
            if word:
                out.append(word)
            word = b""
        else:
            word += bytes([c])
    return out + [word] if word else out


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def quality_base(text):
    text = text or ""
    w = [x.decode() for x in words(text)]
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i, t in enumerate(zip(w, w[1:], w[2:])):
        if windows[t] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if words(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def exact_dedup(docs):
    """docs: (doc_id, text); rows doc_id, keep_id, group_size, kept, sha256."""
    groups = collections.defaultdict(list)
    for d, t in docs:
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), d))
    out = []
    for norm, members in groups.items():
        keep = min(members)[1]
        out += [(d, keep, len(members), d == keep, sha(norm.encode())) for _, d in members]
    return sorted(out)


def fingerprint(text):
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(docs):
    marks = [(d, fingerprint(t)) for d, t in docs]
    root = {d: d for d, _ in marks}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, a) in enumerate(marks):
        for e, b in marks[:i]:
            if (a ^ b).bit_count() <= 2:
                p, q = find(d), find(e)
                root[max(p, q)] = min(p, q)
    return sorted((d, f"{m:016x}", find(d)) for d, m in marks)


def substring_dedup(docs, length=50):
    first = {}
    split = {d: words(t) for d, t in docs}
    for d in sorted(split):
        for i in range(len(split[d]) - length + 1):
            first.setdefault(tuple(split[d][i : i + length]), d)
    out = []
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone |= set(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), sha(kept)))
    return sorted(out)


def suffix_dedup(docs, length=100):
    first = {}
    data = {d: (t or "").encode() for d, t in docs}
    for d in sorted(data):
        for i in range(len(data[d]) - length + 1):
            first.setdefault(data[d][i : i + length], (d, i))
    out = []
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (d, i):
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(kept)))
    return sorted(out)


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc32(tokens):
    return zlib.crc32(b"".join(t.to_bytes(4, "little") for t in tokens))


def line_key(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in bare)


def line_dedup(docs, min_points=20, min_docs=3):
    """docs: (doc_id, text); rows doc_id, n_lines, n_dropped, sha256."""
    holders = collections.defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            holders[line_key(line)].add((d is not None, d))
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            key = line_key(line)
            common = len(key) >= min_points and len(holders[key]) >= min_docs
            if not common or max(holders[key]) == (d is not None, d):
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return sorted(out, key=repr)


def word_counts(docs):
    n = collections.Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def spelling_variants(n, ratio=10):
    """n: counts by word; rows word, n, n_near, form, form_n, root."""
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root))
    return sorted(out, key=repr)
