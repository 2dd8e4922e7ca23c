from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from postlake.llm import line_dedup
from tests.llm import brute

NAMES = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def digests(df):
    return sorted((tuple(r[c] for c in NAMES) for r in line_dedup.digests(df).collect()), key=repr)


def repeating(seed: int, n: int) -> list[tuple[int, str]]:
    """Documents of few kinds of lines, in different writings and with white space around."""
    rnd = random.Random(seed)
    kinds = ["Über the WHOLE footer line %d É" % k for k in range(12)] + ["short", "", "x" * 20, "y" * 19]
    out = []
    for d in range(n):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            line = rnd.choice(kinds) if rnd.random() < 0.7 else f"own line of document number {d} {rnd.random()}"
            line = "".join(c.upper() if rnd.random() < 0.2 and c.isascii() else c for c in line)
            lines.append(rnd.choice(["", " ", "\t\r"]) + line + rnd.choice(["", "  ", "\x0b"]))
        out.append((d, "\n".join(lines)))
    return out


def test_line_dedup(frame, documents, odd):
    for docs in (documents, odd, repeating(1, 60), []):
        got = digests(line_dedup.without_common_lines(frame(docs)))
        assert got == brute.line_dedup(docs)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (5, 2), (9, 3)])
def test_runs_and_batches_do_not_change_the_result(frame, batches, fanout):
    docs = repeating(2, 80)
    kept = line_dedup.without_common_lines(frame(docs), batches=batches, fanout=fanout)
    assert digests(kept) == brute.line_dedup(docs)


def test_texts_that_shuffle(frame, monkeypatch):
    monkeypatch.setattr(line_dedup, "PLACES", -1)
    docs = repeating(3, 50)
    assert digests(line_dedup.without_common_lines(frame(docs))) == brute.line_dedup(docs)


def test_only_letters_of_ascii_change_case(frame):
    docs = [(d, t) for d, t in enumerate(["É" + "a" * 20, "é" + "a" * 20, "É" + "A" * 20, "K" + "a" * 20, "k" + "a" * 20])]
    assert digests(line_dedup.without_common_lines(frame(docs), min_docs=2)) == brute.line_dedup(docs, min_docs=2)


def test_null_and_repeated_ids(frame):
    line = "a line that all documents share"
    docs = [(None, line), (None, line + "\n" + line), (1, line), (1, line), (1, line + "\nmore"), (7, line)]
    kept = line_dedup.without_common_lines(frame(docs))
    assert digests(kept) == brute.line_dedup(docs)
    # two rows of one id are one document
    assert [r.n_dropped for r in line_dedup.without_common_lines(frame(docs[2:])).collect()] == [0] * 4


def test_columns_stay_and_null_texts_stay_null(frame):
    docs = frame([(1, None), (2, "x")]).withColumnsRenamed({"size": "N_Lines", "mark": "places"})
    docs = docs.withColumn("hash", F.lit(1)).withColumn("raw", F.lit("r"))
    kept = line_dedup.without_common_lines(docs)
    assert kept.columns == [*docs.columns, "n_lines_", "n_dropped"]
    assert [(r.text, r.n_lines_) for r in kept.orderBy("doc_id").collect()] == [(None, 1), ("x", 1)]


def test_a_hot_line_in_a_long_document(frame):
    line = "the same line in every document of all"
    docs = [(d, line) for d in range(300)] + [(500, "\n".join([line, "z"] * 4000)), (900, "\n".join(["q"] * 9000 + [line]))]
    assert digests(line_dedup.without_common_lines(frame(docs))) == brute.line_dedup(docs)


def test_runs_hold_a_line_once(spark, frame):
    lines = line_dedup.long_lines(frame(repeating(4, 40)), 20, "doc_id", "text").select("doc_id", "hash").cache()
    store = line_dedup.LineRuns(spark, fanout=2)
    for b in range(5):
        store.add(lines.filter(F.col("doc_id") % 5 == b))
        seen = [r.hash for run in store.runs() for r in run.collect()]
        assert len(seen) == len(set(seen))
        assert all(len(level) < 2 for level in store.levels)
    assert len(seen) == lines.select("hash").distinct().count()
    # meeting a run neither shuffles nor sorts it
    run = store.runs()[0]
    with store._settings():
        joined = lines.groupBy("hash").count().join(run.hint("merge"), "hash", "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    right = plan[plan.index("FileScan parquet spark_catalog") - 400 :]
    assert "Bucketed: true" in right and "Exchange" not in right and "Sort [" not in right
    store.close()
    assert spark.sql("SHOW TABLES LIKE 'line_run_*'").count() == 0
