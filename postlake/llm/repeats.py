"""Finding strings of a fixed length that occur more than once, in a corpus of any size.

A window is ``length`` consecutive units (words or bytes) of one text.  Comparing all windows
would move the corpus many times over, so windows are reached through anchors: of the short
grams inside a window, the one with the smallest hash.  Equal windows have equal anchors at
equal places, and neighbouring windows mostly share theirs, so there are few anchors.  Anchors
that occur once are dropped.  The text around the others, their context, holds whole windows;
equal contexts are reduced to their first place before anything is grouped.  Contexts that
share an anchor then meet in one task, where a suffix structure finds the equal windows.

A group of contexts that is too large for a task is split by longer grams, in the end as long
as the window; then a group is a single context.  Hashes only decide what meets: contexts are
compared in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.encoding import slices
from postlake.llm.frames import sized, written
from postlake.session import discard

#: Windows of a text that are looked at together.
CHUNK = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
#: Contexts of one anchor that a task takes; larger groups are split by longer grams.
GROUP = 1_000
#: Bytes of contexts that a task compares at once.
ROOM = 3 << 20
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: list[np.ndarray] = []


@dataclass(frozen=True)
class Units:
    """A text as bytes, and where its units start and end in them."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bytewise: bool = False

    def __len__(self) -> int:
        return len(self.starts)

    def part(self, a: int, b: int) -> bytes:
        """The bytes of units ``a`` to ``b`` - 1."""
        return self.data[self.starts[a] : self.ends[b - 1]].tobytes()


def byte_units(data: bytes) -> Units:
    at = np.arange(len(data) + 1)
    return Units(np.frombuffer(data, np.uint8), at[:-1], at[1:], True)


def word_units(data: bytes) -> Units:
    """What ASCII white space separates, joined by single spaces."""
    words = data.split()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]) if words else ends
    return Units(np.frombuffer(b" ".join(words), np.uint8), starts, ends)


@dataclass(frozen=True)
class Search:
    """Which windows count as repeated, and how a task finds equal ones.

    ``grams`` are the lengths of anchors, growing up to ``length``.  ``solve`` gets contexts,
    each with the rank of its first place and counting windows from there, and returns for
    every window whether it is the first of its kind.
    """

    length: int
    grams: tuple[int, ...]
    units: Callable[[bytes], Units]
    solve: Callable[[list[bytes], np.ndarray, np.ndarray], list[np.ndarray]]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16, 2 * len(_powers[0]) if _powers else 0)
        both = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        _powers[:] = both
    return _powers


def gram_hashes(units: Units, a: int, b: int, size: int) -> np.ndarray:
    """Hashes of the grams of ``size`` units that start at units ``a`` to ``b`` - 1."""
    low, high = int(units.starts[a]), int(units.ends[b + size - 2])
    up, down = _power(high - low + 1)
    sums = np.zeros(high - low + 1, np.uint64)
    np.cumsum((units.data[low:high] + np.uint64(1)) * up[: high - low], out=sums[1:])
    if units.bytewise:
        h = (sums[size : size + b - a] - sums[: b - a]) * down[: b - a]
    else:
        start = units.starts[a:b] - low
        h = (sums[units.ends[a + size - 1 : b + size - 1] - low] - sums[start]) * down[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(units: Units, size: int, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor: its hash, the first window and the last."""
    windows = len(units) - length + 1
    for a in range(0, windows, CHUNK):
        b = min(a + CHUNK, windows)
        h = gram_hashes(units, a, b + length - size, size)
        least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        span, width = 1, length - size + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: span - width], least[width - span :])
        place = (least & _PLACE).astype(np.int64)
        cut = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [b - a]]) - 1
        yield h[place[first]].view(np.int64), first + a, last + a


def _runs(units: Units, size: int, length: int) -> tuple[np.ndarray, ...]:
    parts = list(anchors(units, size, length))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def row_key(doc_id: Column, text: Column) -> Column:
    """What tells rows apart that repeat an id.  Other rows are told apart by the id."""
    return F.xxhash64(doc_id, text)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, data (a text's bytes) and key; a row is doc_id and key, its document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    return docs.select(
        doc_id.alias("doc_id"), row_key(doc_id, text).alias("key"), text.cast("binary").alias("data")
    )


def _by_document(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on doc_id and key.  Rows meet by key, which is never null; ids may be."""
    right = right.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    both_null = F.col("doc_id").isNull() & F.col("_id").isNull()
    same = (F.col("key") == F.col("_key")) & F.coalesce(F.col("doc_id") == F.col("_id"), both_null)
    return left.join(right, same, how).drop("_id", "_key")


def _found_anchors(texts: DataFrame, search: Search) -> DataFrame:
    """gram, doc_id and key of every anchor."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch["data"]):
                grams = [_runs(search.units(d), search.grams[0], search.length)[0] for d in part]
                sizes = [len(g) for g in grams]
                rows = pa.array(np.repeat(np.arange(at, at + len(part)), sizes))
                at += len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(grams)), batch["doc_id"].take(rows), batch["key"].take(rows)],
                    ["gram", "doc_id", "key"],
                )

    return texts.mapInArrow(find, "gram long, doc_id long, key long")


def lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of an Arrow column of lists of longs as arrays; null lists are empty."""
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield values[a:b]


CONTEXTS = "gram long, context binary, doc_id long, key long, first long"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [()] * 5
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["gram", "context", "doc_id", "key", "first"])


def _contexts(texts: DataFrame, search: Search) -> DataFrame:
    """The contexts of the anchors that ``texts`` lists in ``grams``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch[c] for c in ("doc_id", "key", "data"))
            every = lists(batch["grams"])
            for part in zip(*(slices(c, 64) for c in columns), strict=True):
                rows = []
                for doc_id, key, data in zip(*part, strict=True):
                    grams = next(every)
                    units = search.units(data)
                    gram, first, last = _runs(units, search.grams[0], search.length)
                    for k in np.flatnonzero(np.isin(gram, grams)).tolist():
                        a, b = int(first[k]), int(last[k]) + search.length
                        rows.append((int(gram[k]), units.part(a, b), doc_id, key, a))
                yield _table(rows)

    return texts.select("doc_id", "key", "data", "grams").mapInArrow(cut, CONTEXTS)


def _finer(contexts: DataFrame, search: Search, size: int) -> DataFrame:
    """The same windows in contexts of longer grams."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch[c] for c in ("context", "doc_id", "key", "first"))
            for part in zip(*(slices(c, 256) for c in columns), strict=True):
                rows = []
                for context, doc_id, key, start in zip(*part, strict=True):
                    units = search.units(context)
                    for gram, first, last in zip(
                        *(x.tolist() for x in _runs(units, size, search.length)), strict=True
                    ):
                        inner = units.part(first, last + search.length)
                        rows.append((gram, inner, doc_id, key, start + first))
                yield _table(rows)

    return contexts.select("context", "doc_id", "key", "first").mapInArrow(cut, CONTEXTS)


def _distinct(contexts: DataFrame) -> DataFrame:
    """Each context once, with its first place.  Copies meet on the map side first."""
    place = F.min(F.struct("doc_id", "key", "first")).alias("place")
    kept = contexts.groupBy("gram", "context").agg(place)
    return written(kept.select("gram", "context", "place.*"), "repeat-contexts")


def _sized_groups(
    contexts: DataFrame, search: Search, group: int
) -> tuple[DataFrame, list[DataFrame]]:
    """Contexts grouped by grams so long that no group has more than ``group``, and the
    written tables that they are read from."""
    small, tables = None, [contexts]
    for size in (*search.grams[1:], None):
        counts = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        large = written(counts.filter(F.col("n") > group).select("gram"), "repeat-large")
        tables.append(large)
        if size is None or large.isEmpty():
            break
        large = sized(large)
        rest = contexts.join(large, "gram", "left_anti")
        small = rest if small is None else small.unionByName(rest)
        contexts = _distinct(_finer(contexts.join(large, "gram", "left_semi"), search, size))
        tables.append(contexts)
    return contexts if small is None else small.unionByName(contexts), tables


def runs_of(marks: np.ndarray) -> np.ndarray:
    """Where runs of true values start and end (first, last + 1), a row each."""
    padded = np.zeros(len(marks) + 2, bool)
    padded[1:-1] = marks
    return np.flatnonzero(padded[1:] != padded[:-1]).reshape(-1, 2)


def _firsts(contexts: DataFrame, search: Search, room: int) -> DataFrame:
    """doc_id, key, low, high: runs of windows that are the first of their kind."""

    def solved(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        doc_id = table["doc_id"].combine_chunks()
        known, ids = doc_id.is_valid().to_numpy(False), doc_id.fill_null(0).to_numpy()
        keys, first = table["key"].to_numpy(), table["first"].to_numpy()
        # dense ranks of the documents, null ids first
        order = np.lexsort((keys, ids, known))
        new = np.ones(len(order), bool)
        new[1:] = np.any([np.diff(x[order]) != 0 for x in (known, ids, keys)], axis=0)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        own = search.solve(table["context"].to_pylist(), rank, first)
        edges = [runs_of(o) + first[k] for k, o in enumerate(own)]
        rows = pa.array(np.repeat(np.arange(len(edges)), [len(e) for e in edges]))
        low, high = np.concatenate(edges).T
        columns = [doc_id.take(rows), pa.array(keys).take(rows), pa.array(low), pa.array(high)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "low", "high"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                gram = batch["gram"].to_numpy()
                if held and sum(b["context"].nbytes for b in held) >= room:
                    # up to where the last gram ends
                    end = int(np.searchsorted(gram != held[-1]["gram"][-1].as_py(), True))
                    held.append(batch.slice(0, end))
                    batch = batch.slice(end)
                    if batch.num_rows:
                        yield solved(held)
                        held = []
                if batch.num_rows:
                    held.append(batch)
        if held:
            yield solved(held)

    dealt = contexts.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(solve, "doc_id long, key long, low long, high long")


def _again(units: Units, length: int, wanted: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Of the windows ``wanted``, those that equal one of the windows ``firsts`` of this text."""
    if not len(wanted) or not len(firsts):
        return wanted[:0]
    h = np.concatenate(
        [
            gram_hashes(units, a, min(a + CHUNK, len(units) - length + 1), length)
            for a in range(0, len(units) - length + 1, CHUNK)
        ]
    )
    at = {x: i for i, x in zip(firsts.tolist(), h[firsts].tolist(), strict=True)}
    found = [
        i
        for i, x in zip(wanted.tolist(), h[wanted].tolist(), strict=True)
        if x in at and units.part(i, i + length) == units.part(at[x], at[x] + length)
    ]
    return np.array(found, np.int64)


def repeated_spans(
    units: Units, search: Search, grams: np.ndarray, low: np.ndarray, high: np.ndarray, within: bool
) -> np.ndarray:
    """Which units of one text repeated windows cover: maximal runs first, last + 1, in order.

    ``grams`` are the hashes of its anchors that occur again, ``low`` and ``high`` (+ 1) its
    runs of windows that are the first of their kind.  ``within``: a window also counts as
    repeated if only an earlier place of its own text has it.
    """
    if not len(grams):
        return np.empty((0, 2), np.int64)
    gram, first, last = _runs(units, search.grams[0], search.length)
    hit = np.isin(gram, grams)
    window = np.repeat(hit, last - first + 1)
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        window[a:b] = False
    if not within and len(np.unique(gram[hit])) < hit.sum():
        own = np.zeros(len(window), bool)
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            own[a:b] = True
        window[_again(units, search.length, np.flatnonzero(window), np.flatnonzero(own))] = False
    spans = runs_of(window)
    spans[:, 1] += search.length - 1
    apart = spans[1:, 0] > spans[:-1, 1]
    starts = np.ones(len(spans), bool)
    starts[1:] = apart
    ends = np.ones(len(spans), bool)
    ends[:-1] = apart
    return np.column_stack([spans[starts, 0], spans[ends, 1]])


def with_marks(
    docs: DataFrame,
    search: Search,
    id_col: str = "doc_id",
    text_col: str = "text",
    group: int = GROUP,
    room: int = ROOM,
) -> DataFrame:
    """doc_id, data, grams, low and high of every row of ``docs``: what ``repeated_spans`` needs
    to mark the repeated windows of a text without looking at any other."""
    texts = _texts(docs, id_col, text_col)
    found = written(_found_anchors(texts, search), "repeat-anchors")
    counts = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    again = written(counts.filter("n > 1").select("gram"), "repeat-grams")
    hits = found.join(sized(again), "gram", "left_semi")
    grams = F.collect_set("gram").alias("grams")
    hits = written(hits.groupBy("doc_id", "key").agg(grams), "repeat-hits")
    discard(found, again)
    contexts = _distinct(_contexts(_by_document(texts, hits), search))
    groups, tables = _sized_groups(contexts, search, group)
    firsts = _firsts(groups, search, room)
    runs = F.collect_list(F.struct("low", "high")).alias("firsts")
    # dealt by key alone, as the join deals them
    firsts = firsts.repartition("key").groupBy("doc_id", "key").agg(runs)
    marks = written(_by_document(hits, firsts, "left"), "repeat-marks")
    discard(hits, *tables)
    bounds = [F.col(f"firsts.{c}").alias(c) for c in ("low", "high")]
    return _by_document(texts, marks, "left").select("doc_id", "data", "grams", *bounds)


def marked_rows(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """doc_id, data, grams, low and high of the rows ``with_marks`` gives, a few at a time."""
    marks = zip(*(lists(batch[c]) for c in ("grams", "low", "high")), strict=True)
    for ids, data in zip(slices(batch["doc_id"], 64), slices(batch["data"], 64), strict=True):
        yield [(i, d, *next(marks)) for i, d in zip(ids, data, strict=True)]
