"""Toxicity by multiple-instance learning.

Labels say whether a document is toxic, not which of its sentences.  Every sentence with a
learnt feature gets a probability from its words, a document is toxic with the noisy-or of
these sentences and of one leak, and the word weights are trained through that from document
labels alone.  The same weights then point out the sentences.  Sentences without a learnt
feature add nothing, so length alone makes no document toxic.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.encoding import slices

#: Bounds of the training sample: documents, of these toxic ones, and characters of their texts.
TRAIN_DOCS = 8_000
TRAIN_TOXIC = 2_000
TRAIN_CHARS = 48_000_000
#: A feature must be met in this many toxic documents of the sample.
MIN_DOCS = 3
#: Beginnings of a word that are features, in characters.
STEMS = (3, 4, 5, 6, 7, 8)
#: Words whose weight a worker keeps.
CACHE = 300_000
#: Most that the leak can be, so that no document is toxic without a learnt feature.
LEAK = 0.25
SENTENCE = regex.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
WORD = regex.compile(r"[\p{L}\p{N}]+")


def features(word: str) -> list[str]:
    """The word itself and its beginnings, which stand for words of one stem."""
    return ["=" + word, *[word[:k] for k in STEMS if len(word) > k]]


@dataclass
class Model:
    """A sentence's log-odds are ``bias`` and the weights of its different words, a word's
    being the sum of its features' weights.  ``leak`` is the probability that a document is
    toxic for what no feature shows."""

    bias: float
    weights: dict[str, float]
    leak: float = 0.0
    _words: dict[str, float | None] = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "leak": self.leak, "_words": {}}

    def word(self, word: str) -> float | None:
        """The weight of a word, None if it has no learnt feature."""
        try:
            return self._words[word]
        except KeyError:
            if len(self._words) >= CACHE:
                self._words.clear()
            known = [self.weights[f] for f in features(word) if f in self.weights]
            found = self._words[word] = math.fsum(known) if known else None
            return found

    def sentence(self, text: str) -> float:
        """Probability that one sentence is toxic; 0 without a learnt feature."""
        found = [v for v in map(self.word, set(WORD.findall(text.lower()))) if v is not None]
        return _sigmoid(self.bias + math.fsum(found)) if found else 0.0

    def score(self, text: str | None) -> float:
        """Noisy-or over the leak and the sentences of a whole text."""
        found = [p for s in SENTENCE.findall(text or "") if (p := self.sentence(s))]
        clean = math.log1p(-self.leak) + math.fsum(math.log1p(-p) for p in found)
        return min(1.0, max(0.0, -math.expm1(clean)))

    def offending(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Start, end and probability of the sentences that reach ``least``; if none does, of
        the likeliest one."""
        found = [(s.start(), s.end(), self.sentence(s[0])) for s in SENTENCE.finditer(text or "")]
        found = [f for f in found if f[2] > 0]
        return [f for f in found if f[2] >= least] or sorted(found, key=lambda f: -f[2])[:1]


def _sigmoid(z: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _present(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text.lower())) for f in features(w)}


def telling_features(texts: list[str], toxic: list[int]) -> list[str]:
    """Features that toxic documents have more often than chance allows.

    With n documents that have a feature, k of them toxic, and the toxic share p of all, the
    chance of so many is at most exp(-n KL(k/n, p)); it must be below one over the number of
    features looked at, so about one is kept by accident however many there are.
    """
    p = sum(toxic) / len(toxic)
    with_it = Counter(f for t, y in zip(texts, toxic, strict=True) if y for f in _present(t))
    with_it = {f: k for f, k in with_it.items() if k >= MIN_DOCS}
    clean: Counter[str] = Counter()
    for t, y in zip(texts, toxic, strict=True):
        if not y:
            clean.update(with_it.keys() & _present(t))
    found = []
    for f, k in with_it.items():
        n, r = k + clean[f], k / (k + clean[f])
        far = r * math.log(r / p) + ((1 - r) * math.log((1 - r) / (1 - p)) if r < 1 else 0.0)
        if r > p and n * far > math.log(len(with_it)):
            found.append(f)
    return sorted(found)


def fit(
    texts: list[str], toxic: list[int], epochs: int = 300, rate: float = 0.3, decay: float = 1e-4
) -> Model:
    """Train on whole texts and their labels by Adagrad on the log loss of the noisy-or.

    Without both labels there is nothing to tell apart: no weights and no leak, so every
    document scores 0 and is kept.  The leak stays at most ``LEAK``.
    """
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return Model(-30.0, {})
    names = telling_features(texts, toxic)
    index = {f: k for k, f in enumerate(names)}
    known: dict[str, list[int]] = {}
    doc, sentence, feature, n = [], [], [], 0
    for d, text in enumerate(texts):
        for s in SENTENCE.findall(text.lower()):
            before = len(feature)
            for w in set(WORD.findall(s)):
                if w not in known:
                    known[w] = [index[f] for f in features(w) if f in index]
                feature += known[w]
            if len(feature) > before:
                sentence += [n] * (len(feature) - before)
                doc.append(d)
                n += 1
    doc, sentence, feature = (np.array(x, np.int64) for x in (doc, sentence, feature))
    cost = np.full(len(y), 1 / len(y))
    w, b, c, most = np.zeros(len(names)), -4.0, -4.0, math.log(LEAK / (1 - LEAK))
    seen_w, seen_b, seen_c = np.full(len(names), 1e-10), 1e-10, 1e-10
    for _ in range(epochs):
        z = b + np.bincount(sentence, w[feature], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        leak = _sigmoid(c)
        clean = math.log1p(-leak) + np.bincount(doc, np.log1p(-p), len(y))
        clean = np.minimum(clean, -1e-9)
        # d loss / d z of a sentence: p for clean documents, -p (1 - q) / q for toxic ones
        pull = np.where(y > 0, cost * np.exp(clean) / np.expm1(clean), cost)
        g = p * pull[doc]
        grad = np.bincount(feature, g[sentence], len(w)) + decay * w / max(1, len(w))
        seen_w += grad**2
        w -= rate * grad / np.sqrt(seen_w)
        seen_b += g.sum() ** 2
        b -= rate * g.sum() / math.sqrt(seen_b)
        g = leak * pull.sum()
        seen_c += g**2
        c = min(most, c - rate * g / math.sqrt(seen_c))
    return Model(float(b), dict(zip(names, w.tolist(), strict=True)), _sigmoid(c))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document's label must not be learnt: crc32 of its id as text is 0 mod folds."""
    of = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
    return F.coalesce(of == 0, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_docs: int = TRAIN_DOCS,
    max_toxic: int = TRAIN_TOXIC,
    max_chars: int = TRAIN_CHARS,
) -> Model:
    """A model from a bounded sample of the labelled rows outside the held-out fold.

    Up to ``max_toxic`` toxic rows are drawn, so that rare labels are seen, and clean ones up
    to ``max_docs`` in all, in the order of a hash of their id while their texts have at most
    ``max_chars`` characters.  Toxic rows have the first call on their share of the characters
    and clean ones on the rest; texts longer than a hundredth of ``max_chars`` come after the
    others, and one that no longer fits is passed over, so no text takes the place of many.
    Null labels, ids and texts are not drawn; an id with several labels counts as toxic if
    one of them is, and its texts are drawn together.
    """
    marks = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .filter("label IN (0, 1) AND doc_id IS NOT NULL")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    turn = F.xxhash64("doc_id")
    chosen = None
    for label, most in ((0, max_docs - max_toxic), (1, max_toxic)):
        part = marks.filter(F.col("label") == label).orderBy(turn, "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = texts.filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    sizes = known.groupBy("doc_id", "label").agg(F.sum(F.length("text")).alias("n"))
    sizes = sizes.orderBy(turn, "doc_id").limit(max_docs).collect()
    sizes.sort(key=lambda row: row.n > max_chars // 100)
    taken, chars = {}, 0
    for label, most in ((1, max_chars * max_toxic // max_docs), (0, max_chars), (1, max_chars)):
        for row in sizes:
            if row.label == label and row.doc_id not in taken and chars + row.n <= most:
                taken[row.doc_id] = row.n
                chars += row.n
    sample = known.filter(F.col("doc_id").isin(list(taken))).orderBy(turn, "doc_id").limit(max_docs)
    rows = sample.select("text", "label").toPandas()
    return fit(rows["text"].tolist(), rows["label"].tolist())


def scores(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score, predicted and ``offending`` of every row of ``docs``: where the
    sentences are (in characters) for which it is predicted toxic, and their own scores.  It is
    empty if the row is not predicted, or for what no sentence shows.

    Null texts count as empty; null ids are not held out; repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found, spans = [], []
            for part in slices(batch["text"]):
                for text in part:
                    found.append(own.score(text))
                    some = own.offending(text) if found[-1] >= 0.5 else []
                    spans.append([dict(zip(("start", "end", "score"), s, strict=True)) for s in some])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(found, "float64"), pa.array(spans, places)],
                ["doc_id", "score", "offending"],
            )

    places = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    spans_type = "array<struct<start: bigint, end: bigint, score: double>>"
    out = rows.mapInArrow(scored, f"doc_id {kind.simpleString()}, score double, offending {spans_type}")
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "offending",
    )


def offending_sentences(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = 0.5,
) -> DataFrame:
    """doc_id, number, start, end (in characters), sentence and score of every sentence whose
    own probability is at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    names = ["doc_id", "number", "start", "end", "sentence", "score"]

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found, row = [], 0
            for part in slices(batch["text"]):
                for text in part:
                    for k, s in enumerate(SENTENCE.finditer(text or "")):
                        if (p := own.sentence(s[0])) >= least:
                            found.append((row, k, s.start(), s.end(), s[0], p))
                    row += 1
            of, *rest = zip(*found, strict=True) if found else [()] * 6
            kinds = ["int64", "int64", "int64", "string", "float64"]
            arrays = [pa.array(c, t) for c, t in zip(rest, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(of, "int64")), *arrays], names
            )

    return rows.mapInArrow(
        located,
        f"doc_id {kind.simpleString()}, number long, start long, end long, sentence string, score double",
    )


def without_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    **training,
) -> DataFrame:
    """``docs`` whose score stays below ``threshold``, all columns unchanged.

    The score is computed beside each row, so no row is shuffled.
    """
    model = train(docs, labels, id_col, text_col, **training)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(lambda t: shared.value.score(t))

    return docs.filter(score(F.col(text_col)) < threshold)
