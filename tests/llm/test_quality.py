from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from postlake.llm import quality_gate, toxicity
from tests.llm import brute


def test_signals(documents, odd):
    for _, text in [*documents, *odd]:
        assert quality_gate.measured(text)[:5] == brute.quality_base(text)


@pytest.mark.parametrize("n", [1, 7, 60])
def test_binomial_tail(n):
    for p in (Fraction(1, 50), Fraction(1, 3), Fraction(9, 10)):
        for k in range(n + 1):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert quality_gate.binomial_tail(k, n, float(p)) == pytest.approx(float(want), rel=1e-9)


def test_strictest_cutoff():
    # 0 of n rejected passes once (1 - risk)^n <= delta
    need = math.ceil(math.log(0.05) / math.log(0.99))
    assert quality_gate.strictest([0, 0], need, 0.01, 0.05) == 2
    assert quality_gate.strictest([0, 0], need - 1, 0.01, 0.05) == 0
    assert quality_gate.strictest([0, 1, 0], need, 0.01, 0.05) == 1
    assert quality_gate.strictest([], 0, 0.01, 0.05) == 0


def quality_docs(spark, n, seed=0):
    rnd = random.Random(seed)
    rows, labels = [], []
    for d in range(n):
        good = rnd.random() < 0.8
        lang = rnd.choice(["a", "b", None])
        text = " ".join(f"w{rnd.randrange(10**6)}{'' if good else '#'}" for _ in range(60))
        rows.append((d, text, lang))
        labels.append((d, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_cutoffs_by_brute_force(spark):
    docs, labels, good = quality_docs(spark, 3000)
    rules = quality_gate.RULES[:2]
    marked = quality_gate.signals(docs)
    got = {r.stratum: r for r in quality_gate.cutoffs(marked, labels, rules, 0.05, 0.05).collect()}
    rows = marked.collect()
    assert set(got) == {"", "a", "b"}
    for stratum, found in got.items():
        own = [r for r in rows if r.stratum == stratum and good[r.doc_id]]
        assert found.n_good == len(own)
        for rule in rules:
            want = None
            for c in rule.cutoffs:
                k = sum(r[rule.part] / r[rule.whole] > c for r in own)
                tail = sum(
                    math.comb(len(own), i) * 0.025**i * 0.975 ** (len(own) - i) for i in range(k + 1)
                )
                if tail > 0.05 / 6:
                    break
                want = c
            assert found[f"cut_{rule.name}"] == want


def test_verdicts(spark):
    docs, labels, good = quality_docs(spark, 3000)
    got = quality_gate.judged(docs, labels, quality_gate.RULES[:2], 0.05).collect()
    assert all(r.kept for r in got if good[r.doc_id])
    assert not any(r.kept for r in got if not good[r.doc_id])


def test_quality_edge_cases(spark, frame, odd):
    rows = [*odd, (None, "a b"), (9, "one"), (9, "one")]
    none = spark.createDataFrame([(None, 1), (5, None), (9, 1), (9, 0)], "doc_id long, quality int")
    got = quality_gate.judged(frame(rows), none).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.kept == (not r.base_failed)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality_gate.judged(frame([]), none).count() == 0
    assert quality_gate.judged(frame(rows), none.limit(0)).count() == len(rows)


def toxic_docs(n, seed=0):
    rnd = random.Random(seed)
    rows = []
    for d in range(n):
        bad = d % 5 == 1
        body = [
            " ".join(f"v{rnd.randrange(3000)}" for _ in range(rnd.randint(3, 12))) + rnd.choice(".!?\n")
            for _ in range(rnd.randint(1, 40))
        ]
        if bad:
            body.insert(rnd.randrange(len(body) + 1), f"you grubla{rnd.randrange(99)} thing.")
        rows.append((d, " ".join(body), int(bad)))
    return rows


def test_toxicity_learns_stems_and_finds_sentences(spark):
    rows = toxic_docs(1500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    assert np.mean([got[d].predicted == y for d, _, y in rows]) > 0.99
    found = toxicity.offending_sentences(docs, model).collect()
    assert {r.doc_id for r in found} >= {d for d, _, y in rows if y and got[d].score > 0.9}
    texts = dict(r[:2] for r in rows)
    for r in found:
        assert "grubla" in r.sentence
        assert texts[r.doc_id][r.start : r.end] == r.sentence
    kept = toxicity.without_toxic(docs.withColumnRenamed("doc_id", "doc_id"), labels)
    assert {r.doc_id for r in kept.collect()} == {d for d, g in got.items() if not g.predicted}


def test_held_out_rows_are_not_learnt(spark):
    rows = toxic_docs(600)
    import zlib

    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    held = {d for d, *_ in rows if zlib.crc32(str(d).encode()) % 5 == 0}
    labels = [(d, y) for d, _, y in rows]
    turned = [(d, 1 - y if d in held else y) for d, y in labels]
    a = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    b = toxicity.train(docs, spark.createDataFrame(turned, "doc_id long, toxic int"))
    assert a == b
    got = toxicity.scores(docs, a).collect()
    assert {r.doc_id for r in got if r.held_out} == held


def test_toxicity_gradient():
    """The trained loss is not above the loss of small steps from the trained weights."""
    rows = toxic_docs(120)
    texts, y = [r[1] for r in rows], [r[2] for r in rows]
    model = toxicity.fit(texts, y)

    def loss(m):
        p = np.clip([m.score(t) for t in texts], 1e-12, 1 - 1e-12)
        return -np.mean(np.where(np.array(y) == 1, np.log(p), np.log1p(-p)))

    assert loss(model) < 0.05 < loss(toxicity.Model(model.bias, {}))


def test_toxicity_edge_cases(spark, frame, odd):
    rows = [*odd, (None, "a b"), (9, "one")]
    for labels in ([], [(9, 1)], [(9, 0), (8, 1), (None, 1), (7, None)]):
        marks = spark.createDataFrame(labels, "doc_id long, toxic int")
        model = toxicity.train(frame(rows), marks)
        got = toxicity.scores(frame(rows), model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert toxicity.scores(frame([]), model).count() == 0
        kept = toxicity.without_toxic(frame(rows), marks)
        assert kept.columns == frame(rows).columns


def test_length_alone_is_not_toxic(spark):
    # a tenth of the toxic labels has no telling word, which a text's length must not pay for
    rows = [(d, t, int(y or d % 50 == 3)) for d, t, y in toxic_docs(1500)]
    rnd = random.Random(9)
    long = "".join(f"v{rnd.randrange(3000)} v{rnd.randrange(3000)}. " for _ in range(30_000))
    rows += [(10_000, long, None), (10_001, long + "you grubla7 thing.", None), (10_002, "", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.score(long) < 0.1 < 0.5 < model.score(long + "you grubla7 thing.")
    assert model.sentence("nothing learnt here.") == 0 < model.leak
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    assert {10_000, 10_002} <= kept and 10_001 not in kept


def test_the_leak_alone_drops_nothing():
    texts = [f"w{d}." for d in range(100)]
    model = toxicity.fit(texts, [int(d % 10 > 0) for d in range(100)])
    assert all(model.score(t) < 0.5 for t in [*texts, "", None])


def marked(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_without_both_labels_every_document_stays(spark):
    rows = toxic_docs(150)
    docs, labels = marked(spark, rows)
    held = labels.filter(toxicity.held_out(labels["doc_id"]))
    for some in (labels.limit(0), held, labels.filter("toxic = 1"), labels.filter("toxic = 0")):
        kept = toxicity.without_toxic(docs, some)
        assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in rows]
        got = toxicity.scores(docs, toxicity.train(docs, some))
        assert got.filter("predicted = 1").count() == 0


def test_one_long_text_does_not_end_the_sample(spark):
    rows = toxic_docs(300)
    drawn = spark.createDataFrame([(r[0],) for r in rows if not r[2]], "doc_id long")
    order = drawn.filter(~toxicity.held_out(drawn["doc_id"])).selectExpr("doc_id", "xxhash64(doc_id) h")
    first = order.orderBy("h").first().doc_id
    want = toxicity.train(*marked(spark, [r for r in rows if r[0] != first]), max_chars=400_000)
    # longer than the budget, or just fitting: either way the others are drawn
    for n in (400_001, 399_000):
        long = [(d, "zz " * (n // 3) if d == first else t, y) for d, t, y in rows]
        docs, labels = marked(spark, long)
        model = toxicity.train(docs, labels, max_chars=400_000)
        assert model == want
        kept = {r.doc_id for r in toxicity.without_toxic(docs, labels, max_chars=400_000).collect()}
        assert kept == {d for d, t, y in long if model.score(t) < 0.5}
        assert np.mean([(d in kept) != bool(y) for d, _, y in long]) > 0.95


def test_steps_use_each_cutoff_once_and_get_stricter():
    order = quality_gate.steps(quality_gate.RULES)
    assert len(order) == len(set(order)) == sum(len(r.cutoffs) for r in quality_gate.RULES)
    for k, rule in enumerate(quality_gate.RULES):
        assert [j for r, j in order if r == k] == list(range(len(rule.cutoffs)))


def test_few_good_labels_suffice(spark):
    # (1 - risk)^n <= delta / strata with two strata, and one text fewer
    need = math.ceil(math.log(quality_gate.DELTA / 2) / math.log(1 - quality_gate.RISK))
    rows, labels = [], []
    for lang, n in (("a", need), ("b", need - 1)):
        for good in [1] * n + [0] * 20:
            words = [f"w{k}{'' if good or k % 2 else '#'}" for k in range(60)]
            rows.append((len(rows), " ".join(words), lang))
            labels.append((len(labels), good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_gate.judged(docs, marks).collect()
    good = dict(labels)
    assert {(r.stratum, good[r.doc_id], r.kept) for r in got} == {
        ("a", 1, True),
        ("a", 0, False),
        ("b", 1, True),
        ("b", 0, True),
    }


def test_cutoffs_of_the_union_by_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for d in range(900):
        marks = {0: "#", 1: "!", 2: "X"}.get(rnd.randrange(60), "")
        part = rnd.random()
        words = [f"w{rnd.randrange(10**6)}{marks if rnd.random() < part else ''}" for _ in range(60)]
        rows.append((d, " ".join(words), "a"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1) for d, *_ in rows], "doc_id long, quality int")
    signals = quality_gate.signals(docs)
    rules = quality_gate.RULES
    found = quality_gate.cutoffs(signals, labels, risk=0.04).first()
    texts, cut, rejected = signals.collect(), {}, set()
    for k, j in quality_gate.steps(rules):
        rule = rules[k]
        over = {r.doc_id for r in texts if r[rule.part] / (r[rule.whole] or 1) > rule.cutoffs[j]}
        rejected |= over
        if quality_gate.binomial_tail(len(rejected), len(texts), 0.04) > 0.05:
            break
        cut[rule.name] = rule.cutoffs[j]
    assert rejected and {r.name: found[f"cut_{r.name}"] for r in rules} == {
        r.name: cut.get(r.name) for r in rules
    }


def test_copies_in_the_holdout_are_one_trial(spark):
    """300 copies of one good text are no 300 trials; equal texts of two strata are two."""
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(d, words, "a") for d in range(300)] + [(d, f"{words} x{d}", "b") for d in range(300, 600)]
    rows += [(600, words, "b"), (601, None, "b"), (602, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    marked = quality_gate.signals(docs)
    rules = quality_gate.RULES
    got = {r.stratum: r for r in quality_gate.cutoffs(marked, labels, rules, same="text_hash").collect()}
    assert {s: r.n_good for s, r in got.items()} == {"a": 1, "b": 302}
    assert all(got["a"][f"cut_{r.name}"] is None for r in rules)
    assert any(got["b"][f"cut_{r.name}"] is not None for r in rules)
    # a text with more symbols than any good one goes where there are enough trials
    odd = spark.createDataFrame(
        [(900, words.replace(" ", " # "), "a"), (901, words.replace(" ", " # "), "b")], docs.schema
    )
    kept = {r.doc_id: r.kept for r in quality_gate.judged(docs.unionByName(odd), labels, copies_once=True).collect()}
    assert kept[900] and not kept[901] and kept[0] and kept[300]


def test_scores_name_the_sentences(spark):
    rows = toxic_docs(600)
    docs = spark.createDataFrame([*[r[:2] for r in rows], (9001, None), (9002, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    texts = dict(r[:2] for r in rows)
    got = toxicity.scores(docs, model).collect()
    sure = {}
    for r in toxicity.offending_sentences(docs, model).collect():
        sure.setdefault(r.doc_id, []).append((r.start, r.end, r.score))
    for r in got:
        own = [tuple(s) for s in r.offending]
        if not r.predicted:
            assert own == []
            continue
        if r.doc_id in sure:
            assert own == sorted(sure[r.doc_id])
        else:
            every = [(s.start(), s.end(), model.sentence(s[0])) for s in toxicity.SENTENCE.finditer(texts[r.doc_id])]
            assert own == [max(every, key=lambda s: s[2])]
    assert any(r.offending for r in got) and {r.doc_id for r in got} >= {9001, 9002}
