"""Substring deduplication on words with prefix-partitioned suffix trees.

Suffixes are split by prefixes of varying length into groups that fit in a task (see
``repeats``; prefixes are taken at anchors).  A task builds the subtrees of its suffixes from
the top: the suffixes below a node are told apart by their next word, a suffix alone below a
node is a leaf and is left.  Nodes that still have several suffixes at the depth of a window
are the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.repeats import GROUP, Search, marked_rows, repeated_spans, with_marks, word_units


def deep_nodes(words: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix (its place in the numbered ``words``) the node at ``depth`` words below
    the root, numbered from 0; -1 for a suffix that is alone before that."""
    node = np.full(len(suffixes), -1, np.int64)
    live = np.arange(len(suffixes))
    at = np.zeros(len(suffixes), np.int64)
    most = int(words.max(initial=0)) + 1
    for d in range(depth):
        edge = at * most + words[suffixes[live] + d]
        _, at, members = np.unique(edge, return_inverse=True, return_counts=True)
        shared = members[at] > 1
        live, at = live[shared], at[shared]
    node[live] = np.unique(at, return_inverse=True)[1]
    return node


def solve(length: int):
    """Marks the windows whose document is the first that has them."""

    def own(contexts: list[bytes], document: np.ndarray, _: np.ndarray) -> list[np.ndarray]:
        number: dict[bytes, int] = {}
        lists = [[number.setdefault(w, len(number)) for w in c.split()] for c in contexts]
        sizes = np.array([len(x) for x in lists])
        words = np.concatenate([np.array(x, np.int64) for x in lists])
        counts = sizes - length + 1
        shift = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts)
        suffixes = np.arange(counts.sum()) + shift
        of = np.repeat(document, counts)
        node = deep_nodes(words, suffixes, length)
        first = np.ones(len(suffixes), bool)
        inner = node >= 0
        least = np.full(int(node.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node[inner], of[inner])
        first[inner] = of[inner] == least[node[inner]]
        return np.split(first, np.cumsum(counts)[:-1])

    return own


def search(length: int = 50) -> Search:
    """Windows of ``length`` words; anchors of a fifth, a half and all of that."""
    grams = tuple(sorted({max(1, length // 5), max(1, length // 2), length}))
    return Search(length, grams, word_units, solve(length))


def without_repeats(
    docs: DataFrame,
    length: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    group: int = GROUP,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, text (the kept words joined by
    one space) and removed (array of spans first, last of words).

    A word is removed if a window of ``length`` words that covers it also starts in a document
    with a smaller id.  Windows are judged on the input.  Null texts have no words; a null id
    sorts before all others; rows that repeat an id are ordered by a hash of their text, and
    rows that repeat id and text are one document, each getting its result.
    """
    how = search(length)
    marked = with_marks(docs, how, id_col, text_col, group)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in marked_rows(batch):
                rows = []
                for doc_id, data, *marks in part:
                    gone = repeated_spans(word_units(data), how, *marks, within=False).tolist()
                    words = data.split()
                    kept, at = [], 0
                    for a, b in gone:
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    spans = [{"first": a, "last": b - 1} for a, b in gone]
                    text = b" ".join(kept).decode()
                    rows.append((doc_id, len(words), len(words) - len(kept), text, spans))
                columns_out = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays(columns_out, NAMES)

    return marked.mapInArrow(
        keep,
        "doc_id long, n_words long, n_removed long, text string, "
        "removed array<struct<first: long, last: long>>",
    )


NAMES = ["doc_id", "n_words", "n_removed", "text", "removed"]
KINDS = [
    pa.int64(),
    pa.int64(),
    pa.int64(),
    pa.string(),
    pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])),
]


def digests(kept: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the sha256 of the kept text."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))

