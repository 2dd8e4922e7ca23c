from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import exact_dedup, repeats, simhash, substrings, suffix_sort
from postlake.llm.components import connected_components
from tests.llm import brute


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
NEAR = ("doc_id", "fingerprint", "component_id")
WORDS = ("doc_id", "n_words", "n_removed", "kept_sha256")
BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def texts_with_shared_parts(seed: int, n: int) -> list[tuple[int, str]]:
    """Documents of few words that share passages, some within one document."""
    rnd = random.Random(seed)
    passages = [" ".join(rnd.choice("ab cd é x1 qq zz".split()) for _ in range(80)) for _ in range(4)]
    out = []
    for d in range(n):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages).split()
            a = rnd.randint(0, 30)
            parts += p[a : a + rnd.randint(20, 70)]
            parts += [f"u{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 15))]
        out.append((d, rnd.choice([" ", "\n", "  "]).join(parts)))
    return out


def test_exact_dedup(frame, documents, odd):
    for docs in (documents, odd, []):
        got = rows(exact_dedup.exact_duplicates(frame(docs)), *EXACT)
        assert got == brute.exact_dedup(docs)


def test_exact_dedup_heads_alone_do_not_decide(frame):
    docs = [(1, "x" * 300 + "a"), (2, "x" * 300 + "b"), (3, "x" * 300 + " a")]
    got = rows(exact_dedup.exact_duplicates(frame(docs)), "doc_id", "keep_id")
    assert got == [(1, 3), (2, 2), (3, 3)]


def test_exact_dedup_keeps_columns_and_handles_null_and_repeated_ids(frame):
    docs = frame([(None, "a"), (1, "a"), (1, "a"), (2, "b")])
    kept = exact_dedup.without_duplicates(docs)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(None, "a"), (2, "b")}


def test_fingerprints(documents, odd):
    for _, text in [*documents[:60], *odd]:
        assert simhash.fingerprint(text) == brute.fingerprint(text)


def test_near_duplicates(frame, documents, odd):
    for docs in (documents, odd, []):
        assert rows(simhash.near_duplicates(frame(docs)), *NEAR) == brute.near_components(docs)


def test_every_link_of_two_bits_is_found(spark):
    rnd = random.Random(3)
    marks = {0}
    for _ in range(60):
        base = rnd.getrandbits(64)
        for _ in range(8):
            marks.add(base)
            base ^= 1 << rnd.randrange(64) | (1 << rnd.randrange(64) if rnd.random() < 0.5 else 0)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    pairs = simhash.near_pairs(spark.createDataFrame([(m,) for m in signed], "mark long"))
    found = {r.node: r.root for r in connected_components(pairs).collect()}
    want = {
        (a, b)
        for a in signed
        for b in signed
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    }
    assert all(found.get(a, a) == found.get(b, b) for a, b in want)
    groups = {}
    for a, b in want:
        groups.setdefault(a, set()).add(b)
    seen = set()
    for m in signed:  # components are no larger than the links make them
        if m not in seen:
            part, todo = set(), [m]
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo += groups[x]
            seen |= part
            assert {x for x in signed if found.get(x, x) == found.get(m, m)} == part


def test_lists_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    members = np.array(sorted(random.Random(1).sample(range(1 << 12), 300)), np.int64)
    near = simhash.linked(members, 2, 6)
    root = {int(m): int(m) for m in members}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        assert (a ^ b).bit_count() <= 2
        root[find(a)] = find(b)
    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 2:
                assert find(a) == find(b)


def test_near_copies_of_one_text_leave_one(frame):
    base = [f"w{i}" for i in range(400)]
    docs = [(d, " ".join(base[:d] + ["new"] * (d % 3 == 0) + base[d:])) for d in range(30)]
    got = simhash.without_near_duplicates(frame(docs))
    want = {c for _, _, c in brute.near_components(docs)}
    assert {r.doc_id for r in got.collect()} == want


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000}
    assert connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("group", [repeats.GROUP, 1])
def test_substring_dedup(frame, documents, odd, group):
    for docs in (documents, odd, texts_with_shared_parts(1, 60), []):
        got = substrings.digests(substrings.without_repeats(frame(docs), 50, group=group))
        assert rows(got, *WORDS) == brute.substring_dedup(docs, 50)


@pytest.mark.parametrize("group", [repeats.GROUP, 1])
def test_suffix_dedup(frame, documents, odd, group):
    for docs in (documents, odd, texts_with_shared_parts(2, 60), []):
        got = suffix_sort.digests(suffix_sort.without_repeats(frame(docs), 100, group=group))
        assert rows(got, *BYTES) == brute.suffix_dedup(docs, 100)


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_short_strings(frame, seed):
    docs = texts_with_shared_parts(seed, 40)
    got = substrings.digests(substrings.without_repeats(frame(docs), 6, group=3))
    assert rows(got, *WORDS) == brute.substring_dedup(docs, 6)
    got = suffix_sort.digests(suffix_sort.without_repeats(frame(docs), 11, group=3))
    assert rows(got, *BYTES) == brute.suffix_dedup(docs, 11)


def test_texts_longer_than_a_chunk(documents, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 64)
    units = repeats.byte_units(documents[0][1].encode() * 2)
    runs = list(zip(*repeats._runs(units, 33, 100), strict=True))
    covered = [w for _, a, b in runs for w in range(a, b + 1)]
    assert covered == list(range(len(units) - 99))
    by_window = {}
    for gram, a, b in runs:
        for w in range(a, b + 1):
            assert by_window.setdefault(units.part(w, w + 100), gram) == gram


def test_repeated_and_null_ids(frame):
    text = " ".join(f"w{i}" for i in range(80))
    docs = frame([(1, text), (1, text), (None, text), (2, text)])
    got = substrings.without_repeats(docs, 50)
    assert sorted((str(r.doc_id), r.n_removed) for r in got.collect()) == [
        ("1", 80),
        ("1", 80),
        ("2", 80),
        ("None", 0),
    ]
    got = suffix_sort.without_repeats(docs, 100)
    size = len(text)
    assert sorted((str(r.doc_id), r.n_removed) for r in got.collect()) == [
        ("1", size),
        ("1", size),
        ("2", size),
        ("None", 0),
    ]


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abcd\xff\x00"])
def test_two_stage_sort(letters):
    rnd = random.Random(len(letters))
    text = bytes(rnd.choice(letters) for _ in range(700))
    data = np.frombuffer(text, np.uint8)
    wanted = np.array([rnd.random() < 0.6 and i <= 700 - 24 for i in range(700)])
    order = suffix_sort.two_stage_sort(data, wanted, 24)
    assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
    cut = [text[i : i + 24] for i in order]
    assert cut == sorted(cut)
    shared = suffix_sort.common_prefixes(data, order, 24)
    for k in range(1, len(order)):
        a, b = cut[k - 1], cut[k]
        same = next((i for i in range(24) if a[i] != b[i]), 24)
        assert shared[k] == same


def test_deep_nodes_are_equal_windows():
    rnd = random.Random(5)
    words = np.array([rnd.randrange(3) for _ in range(500)])
    at = np.arange(495)
    node = substrings.deep_nodes(words, at, 5)
    by = {}
    for i in at:
        by.setdefault(tuple(words[i : i + 5]), []).append(i)
    for same in by.values():
        assert len({node[i] for i in same}) == 1
        assert (node[same[0]] == -1) == (len(same) == 1)
    assert len({n for n in node if n >= 0}) == sum(len(s) > 1 for s in by.values())


def test_one_row_of_each_group_stays_and_no_unique_text_leaves(frame):
    long = [" ".join(f"{c}{i}" for i in range(300)) for c in "abcd"]
    a, b, c, d = long
    docs = [(1, a), (1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, d), (4, d + " "), (4, "x"), (4, " x")]
    for without in (exact_dedup.without_duplicates, simhash.without_near_duplicates):
        got = without(frame(docs))
        assert got.columns == frame(docs).columns
        kept = sorted((str(r.doc_id), r.text.strip()) for r in got.collect())
        assert kept == [("1", a), ("2", b), ("3", c), ("4", d), ("4", "x")]


def test_documents_that_share_a_key(frame, documents, monkeypatch):
    monkeypatch.setattr(repeats, "row_key", lambda doc_id, text: F.lit(7).cast("long"))
    for docs in (documents, texts_with_shared_parts(3, 40)):
        got = substrings.digests(substrings.without_repeats(frame(docs), 50))
        assert rows(got, *WORDS) == brute.substring_dedup(docs, 50)
        got = suffix_sort.digests(suffix_sort.without_repeats(frame(docs), 100, group=3))
        assert rows(got, *BYTES) == brute.suffix_dedup(docs, 100)
