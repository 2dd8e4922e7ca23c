from __future__ import annotations

import random

from postlake.llm import spelling
from tests.llm import brute

NAMES = ("word", "n", "n_near", "form", "form_n", "root")


def rows(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.select(*NAMES).collect()), key=repr)


def found(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return rows(spelling.spelling_variants(words))


def test_word_counts(frame, documents, odd):
    runs = [(1, "Straßenbahn STRASSENBAHN Ärzteblatt,ärzteblatt x÷y×z abcdefg_abcdefg"), (None, "Wörterbuch " * 90)]
    for docs in (documents, odd + runs + runs, []):
        got = spelling.word_counts(frame(docs)).collect()
        assert {r.word: r.n for r in got} == brute.word_counts(docs)
        assert len({r.word for r in got}) == len(got)


def test_variants_of_documents(spark, documents):
    counts = brute.word_counts(documents)
    some = dict(sorted(counts.items())[:1500])
    assert found(spark, some) == brute.spelling_variants(some)


def test_runs_of_equal_characters(spark):
    words = ["aaaaaaa", "aaaaaaaa", "aaaaaab", "baaaaaa", "aabaaaa", "aabaaaaa", "abbaaaa", "aabbaaa", "abababa", "bababab"]
    counts = {w: 10**k for k, w in enumerate(words)}
    assert found(spark, counts) == brute.spelling_variants(counts)


def test_dense_words(spark):
    rnd = random.Random(5)
    for _ in range(3):
        words = {"".join(rnd.choice("abé÷") for _ in range(rnd.randint(3, 6))) for _ in range(250)}
        counts = {w: rnd.choice([1, 1, 2, 20, 20, 400, 5000]) for w in words}
        assert found(spark, counts) == brute.spelling_variants(counts)


def test_roots_follow_many_forms(spark):
    word, counts = "abcdefghijkl", {}
    for k in range(12):
        counts[word[: 12 - k] + "z" * k] = 10**k
    got = found(spark, counts)
    assert got == brute.spelling_variants(counts)
    assert {r[5] for r in got} == {"a" + "z" * 11}


def test_ties_take_the_first_in_code_point_order(spark):
    counts = {"éabcdef": 50, "zabcdef": 50, "xabcdef": 1, "eabcdef": 50}
    got = {r[0]: r[3] for r in found(spark, counts)}
    assert got["xabcdef"] == "eabcdef"


def test_no_words(spark):
    assert found(spark, {}) == []
    assert found(spark, {"abcdefg": 3}) == [("abcdefg", 3, 0, None, None, "abcdefg")]
