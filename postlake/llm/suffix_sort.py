"""Suffix-array deduplication on bytes with two-stage sorting.

The contexts that meet in a task (see ``repeats``) are laid end to end and their suffixes are
sorted in two stages.  Only suffixes whose first byte is not larger than their second are
sorted directly.  The others follow from them: walking the buckets of first bytes upwards, the
suffix before each sorted one, if its first byte is larger, is the next of its own bucket.
Adjacent common prefixes then show which windows are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.repeats import GROUP, Search, byte_units, marked_rows, repeated_spans, with_marks


def eights(text: np.ndarray, beyond: int) -> np.ndarray:
    """At each place the next eight bytes as one number, the first byte highest; zeros and
    ``beyond`` further places follow the text."""
    padded = np.concatenate([text, np.zeros(beyond + 8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text) + beyond, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


def direct_sort(eight: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of their suffixes, as far as ``depth`` bytes tell."""
    order = places[np.argsort(eight[places], kind="stable")]
    new = np.ones(len(order), bool)
    new[1:] = np.diff(eight[order]) != 0
    for k in range(8, depth, 8):
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        key = eight[order[tied] + k]
        turn = np.lexsort((key, group))
        order[tied] = order[tied][turn]
        key = key[turn]
        new[tied[1:]] |= key[1:] != key[:-1]
    return order


def two_stage_sort(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The places in ``wanted`` (booleans) in the order of their suffixes of ``text``, as far
    as at least ``depth`` bytes tell; so many bytes must follow each of them."""
    if not len(text):
        return np.empty(0, np.int64)
    falls = np.append(text[:-1] > text[1:], False)
    # a falling suffix follows from the next one, which must then be sorted too
    needed = wanted.copy()
    more = np.flatnonzero(wanted & falls) + 1
    while len(more := more[~needed[more]]):
        needed[more] = True
        more = more[falls[more]] + 1
    eight = eights(text, depth + 8)
    direct = direct_sort(eight, np.flatnonzero(needed & ~falls), depth)
    ends = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for byte in range(256):
        # second bytes of falling suffixes are smaller, so these come first in the bucket
        bucket = np.concatenate([*induced[byte], direct[ends[byte] : ends[byte + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[needed[before] & falls[before]]
        first = text[before]
        turn = np.argsort(first, kind="stable")
        cuts = np.searchsorted(first[turn], np.arange(257))
        for larger in np.unique(first).tolist():
            induced[larger].append(before[turn[cuts[larger] : cuts[larger + 1]]])
    order = np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix in ``order`` shares with the one before it, up to ``most``; the
    first shares none."""
    eight = eights(text, most + 8)
    shared = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for k in range(0, most, 8):
        odd = eight[order[live] + k] ^ eight[order[live - 1] + k]
        same = np.zeros(len(live), np.int64)
        for b in range(8):
            same += odd >> np.uint64(56 - 8 * b) == 0
        shared[live] += same
        live = live[same == 8]
    return np.minimum(shared, most)


def solve(length: int):
    """Marks the windows that no document, and no earlier place of their own, has before."""

    def own(contexts: list[bytes], document: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
        sizes = np.array([len(c) for c in contexts])
        text = np.frombuffer(b"".join(contexts), np.uint8)
        counts = sizes - length + 1
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        windows = inside + np.repeat(np.cumsum(sizes) - sizes, counts)
        wanted = np.zeros(len(text), bool)
        wanted[windows] = True
        order = two_stage_sort(text, wanted, length)
        kind = np.cumsum(common_prefixes(text, order, length) < length)
        # where a window is: by document, then by its place there
        place = np.empty(len(text), np.int64)
        turn = np.lexsort((np.repeat(start, counts) + inside, np.repeat(document, counts)))
        place[windows[turn]] = np.arange(len(windows))
        first = np.zeros(len(text), bool)
        if len(order):
            begins = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
            least = np.minimum.reduceat(place[order], begins)
            first[order] = place[order] == np.repeat(least, np.diff(np.append(begins, len(order))))
        return np.split(first[windows], np.cumsum(counts)[:-1])

    return own


def search(length: int = 100) -> Search:
    """Windows of ``length`` bytes; anchors of a third, two thirds and all of that."""
    grams = tuple(sorted({max(1, length // 3), max(1, 2 * length // 3), length}))
    return Search(length, grams, byte_units, solve(length))


def without_repeats(
    docs: DataFrame,
    length: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    group: int = GROUP,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, kept (the remaining bytes of
    the UTF-8 text) and removed (array of spans first, last of bytes).

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a
    document with a smaller id, or before in the same document.  Strings are judged on the
    input.  Null texts are empty; a null id sorts before all others; rows that repeat an id
    are ordered by a hash of their text, and rows that repeat id and text are one document,
    each getting its result.
    """
    how = search(length)
    marked = with_marks(docs, how, id_col, text_col, group)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in marked_rows(batch):
                rows = []
                for doc_id, data, *marks in part:
                    gone = repeated_spans(byte_units(data), how, *marks, within=True).tolist()
                    cuts = [0, *(x for span in gone for x in span), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                    spans = [{"first": a, "last": b - 1} for a, b in gone]
                    rows.append((doc_id, len(data), len(data) - len(kept), kept, spans))
                columns_out = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays(columns_out, NAMES)

    return marked.mapInArrow(
        keep,
        "doc_id long, n_bytes long, n_removed long, kept binary, "
        "removed array<struct<first: long, last: long>>",
    )


NAMES = ["doc_id", "n_bytes", "n_removed", "kept", "removed"]
KINDS = [
    pa.int64(),
    pa.int64(),
    pa.int64(),
    pa.binary(),
    pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])),
]


def digests(kept: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the sha256 of the remaining bytes."""
    return kept.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
