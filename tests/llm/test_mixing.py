from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from postlake.llm import mixing


def fill(given, children):
    """children: {name: (weight, most)} -> budgets, by raising the level step by step."""
    full, rest = {}, {c: v for c, v in children.items() if v[0] > 0}
    while rest:
        left = given - sum(full.values())
        total = sum(w for w, _ in rest.values())
        over = {c for c, (w, m) in rest.items() if Fraction(left * w, total) >= m}
        if not over:
            return {c: full.get(c, 0) if c not in rest else left * rest[c][0] // total for c in children}
        for c in over:
            full[c] = rest.pop(c)[1]
    return {c: full.get(c, 0) for c in children}


def brute(rows, weights, share, epochs, seed):
    """rows: (doc_id, path, tokens)."""
    leaf = defaultdict(list)
    for d, path, n in rows:
        leaf[path].append((d, n))
    given = {(): sum(n for _, _, n in rows) * share[0] // share[1]}
    for depth in range(1, 4):
        level = defaultdict(int)
        for path, docs in leaf.items():
            reached = all(weights(path[:k]) > 0 for k in (1, 2, 3))
            level[path[:depth]] += epochs * sum(n for _, n in docs) * reached
        budgets = {}
        for parent in {p[:-1] for p in level}:
            children = {p: (weights(p), m) for p, m in level.items() if p[:-1] == parent}
            budgets |= fill(given[parent], children)
        given = budgets
    out = []
    for path, docs in leaf.items():
        have = sum(n for _, n in docs)
        for e in range(epochs):
            done = e * have
            for _, d, n in sorted(
                (hashlib.md5(f"{seed}:{e}:{d}".encode()).hexdigest(), d, n) for d, n in docs
            ):
                if have and (done < given[path] or (e + 1) * have <= given[path]):
                    out.append((d, *path, e, given[path]))
                done += n
    return sorted(out)


def weigh(path):
    return {1: {"d0": 4, "d1": 3}, 2: {"en": 5}, 3: {"s0": 0, "s1": 3}}[len(path)].get(path[-1], 1)


@pytest.mark.parametrize("share,epochs,step", [((1, 1), 2, 4096), ((1, 2), 1, 2), ((5, 2), 3, 1), ((0, 1), 1, 5)])
def test_mix(spark, monkeypatch, share, epochs, step):
    monkeypatch.setattr(mixing, "STEP_ROWS", step)
    rnd = random.Random(epochs)
    rows = [
        (
            d,
            (rnd.choice(["d0", "d1", "d2"]), rnd.choice(["en", "de"]), rnd.choice(["s0", "s1", "s1", "s2"])),
            rnd.choice([0, 1, 5, 900]),
        )
        for d in range(300)
    ]
    docs = spark.createDataFrame(
        [(d, *p, n, "x") for d, p, n in rows],
        "doc_id long, d string, l string, s string, n long, epoch string",
    )
    got = mixing.mix(
        docs,
        [("domain", F.col("d")), ("lang", F.col("l")), ("source", F.col("s"))],
        [
            F.expr("CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 ELSE 1 END"),
            F.expr("CASE lang WHEN 'en' THEN 5 ELSE 1 END"),
            F.expr("CASE source WHEN 's0' THEN 0 WHEN 's1' THEN 3 ELSE 1 END"),
        ],
        F.col("n"),
        share=share,
        epochs=epochs,
        seed=7,
    )
    assert got.columns == [*docs.columns, "domain", "lang", "source", "epoch_", "leaf_budget"]
    found = sorted((r.doc_id, r.domain, r.lang, r.source, r.epoch_, r.leaf_budget) for r in got.collect())
    assert found == brute(rows, weigh, share, epochs, 7)


def test_shortage_goes_to_siblings_first(spark):
    # the small source of (a, x) is short; its sibling takes the rest, domain b nothing
    rows = [(1, "a", "x", "small", 10), (2, "a", "x", "big", 500), (3, "b", "y", "other", 500)]
    leaves = spark.createDataFrame(rows, "n long, d string, l string, s string, tokens long")
    weights = [F.lit(1)] * 3
    got = mixing.leaf_budgets(leaves.drop("n"), ["d", "l", "s"], weights, (200, 1010), 1)
    assert {r.s: r.budget for r in got.collect()} == {"small": 10, "big": 90, "other": 100}


def test_mix_edge_cases(spark, frame, odd):
    levels = [("domain", F.lit(None)), ("lang", F.col("lang"))]
    docs = frame([*odd, (None, "a b c"), (9, "one"), (9, "one")])
    got = mixing.mix(docs, levels, [F.lit(1), F.lit(None)], mixing.word_count("text"))
    assert got.count() == 0  # a null weight gets nothing
    got = mixing.mix(docs, levels, [F.lit(1), F.lit(2)], mixing.word_count("text"))
    assert got.count() == docs.count()
    assert mixing.mix(docs.limit(0), levels, [F.lit(1), F.lit(2)], F.lit(1)).count() == 0
    assert mixing.mix(docs, levels, [F.lit(1), F.lit(2)], F.lit(None).cast("long")).count() == 0


@pytest.mark.parametrize("zero", [("a",), ("a", "x"), ("a", "x", "p")])
def test_a_node_without_weight_is_no_capacity_of_its_parents(spark, zero):
    rows = [(d, p, 100) for d, p in enumerate([(a, x, q) for a in "abc" for x in "xy" for q in "pq"] * 3)]
    docs = spark.createDataFrame([(d, *p, n) for d, p, n in rows], "doc_id long, d string, l string, s string, n long")

    def weight(path):
        return 0 if path == zero else 2 if path[-1] in "ap" else 1

    def column(depth):
        names = ["d", "l", "s"][:depth]
        is_zero = F.lit(len(zero) == depth)
        for c, v in zip(names, zero):
            is_zero = is_zero & (F.col(c) == v)
        return F.when(is_zero, 0).when(F.col(names[-1]).isin("a", "p"), 2).otherwise(1)

    for share in ((4, 5), (1, 1)):
        got = mixing.mix(
            docs.withColumnsRenamed({"d": "d_", "l": "l_", "s": "s_"}),
            [("d", F.col("d_")), ("l", F.col("l_")), ("s", F.col("s_"))],
            [column(k) for k in (1, 2, 3)],
            F.col("n"),
            share=share,
            epochs=1,
            seed=4,
        )
        taken = sorted((r.doc_id, r.d, r.l, r.s, r.epoch, r.leaf_budget) for r in got.collect())
        assert taken == brute(rows, weight, share, 1, 4)
        reachable = sum(n for _, p, n in rows if p[: len(zero)] != zero)
        whole = sum({(r[1], r[2], r[3]): r[5] for r in taken}.values())
        assert min(reachable, 3600 * share[0] // share[1]) - whole < 12  # rounding alone
