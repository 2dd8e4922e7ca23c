"""Quality rules whose cutoffs come with a guarantee.

Each rule measures a text and rejects it above a cutoff.  For each stratum the labelled rows
are a holdout.  One fixed sequence of steps, each of which makes one rule stricter, is tested
from the laxest on: a step passes if the share of good texts that the rules together reject is,
by an exact binomial test, below the risk.  The union of the rules only grows, and the tests
stop at the first that fails, so they need no correction among themselves; the confidence is
divided among strata.  Together: with probability 1 - ``delta``, in every stratum at most
``risk`` of the good texts are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.encoding import slices
from postlake.llm.frames import written
from postlake.operators.skew import lookup_join

SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
MARKS = b"!?"


@dataclass(frozen=True)
class Rule:
    """Rejects texts whose ``part / whole`` (two signals) lies above a cutoff, one of
    ``cutoffs`` in falling order, which are fixed before any label is seen."""

    name: str
    part: str
    whole: str
    cutoffs: tuple[float, ...]


def _steps(first: float, last: float, n: int = 40) -> tuple[float, ...]:
    return tuple(round(first + (last - first) * k / (n - 1), 6) for k in range(n))


RULES = (
    Rule("symbols", "n_symbols", "n_words", _steps(1.0, 0.02)),
    Rule("capitals", "n_capitals", "word_chars", _steps(1.0, 0.1)),
    Rule("marks", "n_marks", "n_words", _steps(2.0, 0.05)),
    Rule("dup_lines", "n_dup_lines", "n_lines", _steps(1.0, 0.05)),
    Rule("repeats", "n_repeat_words", "n_words", _steps(1.0, 0.05)),
)
RISK = 0.02
DELTA = 0.05
SIGNALS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_lines",
)


def repeated_words(words: list[bytes], span: int = 3) -> int:
    """Words in windows of ``span`` words that the list holds twice or more."""
    if len(words) <= span:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    windows = ids[: len(ids) - span + 1]
    for k in range(1, span):
        pair = windows * len(number) + ids[k : len(ids) - span + 1 + k]
        # numbered anew, so that products stay small however long the text
        windows = np.unique(pair, return_inverse=True)[1]
    twice = np.flatnonzero(np.bincount(windows)[windows] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + span, -1)
    return int((np.cumsum(edge) > 0).sum())


def measured(text: str | None) -> tuple[int, ...]:
    """The signals of one whole text, in the order of ``SIGNALS``.

    Words are what ASCII white space separates; a line counts if it has a word.
    """
    text = text or ""
    data = text.encode()
    words = data.split()
    points = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in data.split(b"\n") if x.split()] if b"\n" in data else words[:1]
    return (
        len(words),
        points,
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(data) - len(data.translate(None, CAPITALS)),
        len(data) - len(data.translate(None, MARKS)),
        len(lines),
    )


def signals(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang"
) -> DataFrame:
    """doc_id, stratum, text_hash and the signals of every row; a null stratum is the empty string."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    kind = rows.schema["doc_id"].dataType

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measured(t) for part in slices(batch["text"]) for t in part]
            columns = np.array(found, np.int64).reshape(-1, len(SIGNALS)).T
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["stratum"], batch["text_hash"], *map(pa.array, columns)],
                ["doc_id", "stratum", "text_hash", *SIGNALS],
            )

    kinds = ", ".join(f"{s} long" for s in SIGNALS)
    return rows.mapInArrow(measure, f"doc_id {kind.simpleString()}, stratum string, text_hash long, {kinds}")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X(n, p), as the regularised incomplete beta function
    I(1 - p; n - k, k + 1) by its continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(front + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - front * _fraction(b, a, 1 - x) / b
    return front * _fraction(a, b, x) / a


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out = d
    for m in range(1, 100_000):
        before = out
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            out *= c * d
        if abs(out - before) <= 1e-14 * abs(out):
            break
    return out


def strictest(rejected: list[int], n: int, risk: float, delta: float) -> int:
    """How many cutoffs, from the laxest on, pass the test that the share of good texts
    they reject is below ``risk``; ``rejected`` counts these among ``n`` good texts."""
    passed = 0
    for k in rejected:
        if n == 0 or k > n * risk or binomial_tail(k, n, risk) > delta:
            break
        passed += 1
    return passed


def steps(rules: tuple[Rule, ...]) -> list[tuple[int, int]]:
    """The fixed sequence of (rule, place of its cutoff), in which the places of a rule rise.

    Rule by rule the laxer half of the cutoffs, then rule by rule the stricter half, so that a
    rule that good texts break does not keep the others from being used.  The last rule comes
    whole at the end: of ``RULES`` it is the one whose laxer half the base rule has already.
    """
    out = []
    for half in (0, 1):
        for k, rule in enumerate(rules[:-1]):
            cut = len(rule.cutoffs) // 2
            out += [(k, j) for j in (range(cut, len(rule.cutoffs)) if half else range(cut))]
    return out + [(len(rules) - 1, j) for j in range(len(rules[-1].cutoffs))] if rules else out


def cutoffs(
    marked: DataFrame,
    labels: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    risk: float = RISK,
    delta: float = DELTA,
    id_col: str = "doc_id",
    label_col: str = "quality",
    same: str | None = None,
) -> DataFrame:
    """One row per stratum with labelled good texts: stratum, n_good and a cutoff per rule,
    null where no step of it passes.  ``marked`` is what ``signals`` returns.

    Rows of a stratum that agree in the column ``same`` are one trial, as copies of a text are
    judged alike; without it all labelled rows count.  Null labels and ids are ignored; an id with several labels is
    good only if all say so.
    """
    good = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("good"))
        .filter("good IN (0, 1) AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("good").alias("good"))
        .filter("good = 1")
    )
    held = marked.join(good, "doc_id")
    if same is not None:
        held = held.dropDuplicates(["stratum", same])
    # the first step that rejects a good text, as later ones do too: counted, not carried
    order = steps(rules)
    place = {step: t for t, step in enumerate(order)}
    firsts = []
    for k, rule in enumerate(rules):
        own = F.array(*[F.lit(place[k, j]) for j in range(len(rule.cutoffs))])
        above = sum((F.expr(_value(rule)) > c).cast("int") for c in rule.cutoffs)
        # a text above n cutoffs is rejected from the n-th last on
        firsts.append(F.try_element_at(own, F.when(above > 0, F.lit(len(rule.cutoffs) + 1) - above)))
    first = F.coalesce(F.array_min(F.array(*firsts)), F.lit(len(order)))
    counts = held.select("stratum", first.alias("first")).groupBy("stratum", "first")
    counts = written(counts.agg(F.count(F.lit(1)).alias("n")), "quality-counts")
    sure = delta / max(1, counts.select("stratum").distinct().count())

    def choose(part_of: pd.DataFrame) -> pd.DataFrame:
        n_first = np.zeros(len(order) + 1, np.int64)
        np.add.at(n_first, part_of["first"].to_numpy(), part_of["n"].to_numpy())
        n = int(n_first.sum())
        passed = strictest(np.cumsum(n_first)[:-1].tolist(), n, risk, sure)
        last = dict(order[:passed])
        row: dict[str, object] = {"stratum": part_of["stratum"].iloc[0], "n_good": n}
        for k, rule in enumerate(rules):
            row[f"cut_{rule.name}"] = rule.cutoffs[last[k]] if k in last else None
        return pd.DataFrame([row])

    kinds = ", ".join(f"cut_{r.name} double" for r in rules)
    return counts.groupBy("stratum").applyInPandas(choose, f"stratum string, n_good long, {kinds}")


def _value(rule: Rule) -> str:
    """SQL of what a rule measures; 0 where there is nothing to divide by."""
    return f"coalesce(try_divide({rule.part}, {rule.whole}), 0D)"


def judged(
    docs: DataFrame,
    labels: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    risk: float = RISK,
    delta: float = DELTA,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_col: str = "quality",
    copies_once: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, stratum, the signals, base_failed, kept, and
    ``rejected_by``, the names of the rules that reject it.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated three-word
    windows.  ``kept``: not base_failed and rejected by no rule.  Null texts count as empty;
    a null stratum is one of its own; a stratum without enough labels rejects nothing beyond
    the base.  ``copies_once`` counts labelled good rows of a stratum with one text as one trial
    (texts are told apart by a 64-bit hash, so at worst a trial is missing); without it the
    guarantee takes all labelled rows to be independent.  Repeated rows are judged alike; an empty table gives an empty result.
    """
    same = "text_hash" if copies_once else None
    marked = written(signals(docs, id_col, text_col, stratum_col), "quality-signals")
    chosen = written(cutoffs(marked, labels, rules, risk, delta, id_col, label_col, same), "quality-cutoffs")
    rows = lookup_join(marked, chosen, ["stratum"], "left")
    over = [F.when(F.expr(f"{_value(r)} > cut_{r.name}"), F.lit(r.name)) for r in rules]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id",
        "stratum",
        *SIGNALS,
        failed.alias("base_failed"),
        F.array_compact(F.array(*over)).alias("rejected_by"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))

