"""Near-duplicates by SimHash fingerprints.

Fingerprints of eight bytes that differ in at most two bits agree in at least six byte
positions.  The inverted index therefore lists fingerprints under every choice of six
positions with their bytes; pairs that meet in a list share the guaranteed number of
positional bytes, are tallied and then compared bit by bit.  Within a list only the other two
bytes differ, so no list can hold more than 65,536 distinct fingerprints, however many
documents there are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.components import connected_components
from postlake.llm.encoding import slices
from postlake.llm.frames import keep_one, sized, written

#: Bytes of a fingerprint.
POSITIONS = 8
#: Rows of a list that are compared with the whole list at once.
BLOCK = 256


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text's word shingles under XXH64 with seed 42, unsigned.

    Words are what ASCII white space separates, A-Z in lower case.  A shorter text is one
    shingle; a text without words, or null, has fingerprint zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    starts = [0, *ends[: len(words) - k].tolist()]
    stops = (ends[k - 1 :] - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for a in range(0, len(starts), 1 << 15):  # bounded memory for very long texts
        part = zip(starts[a : a + (1 << 15)], stops[a : a + (1 << 15)], strict=True)
        h = np.array([hashed(joined[s:e], 42) for s, e in part], "<u8")
        bits = np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    over = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(over.view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3
) -> DataFrame:
    """doc_id, fingerprint (a long with the fingerprint's bits) and raw, the text's xxhash64,
    of every row."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("raw")
    )
    kind = rows.schema["doc_id"].dataType

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t, shingle) for part in slices(batch["text"]) for t in part]
            signed = pa.array(np.array(marks, "<u8").view("<i8"))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], signed, batch["raw"]], ["doc_id", "mark", "raw"]
            )

    return rows.mapInArrow(marked, f"doc_id {kind.simpleString()}, mark long, raw long")


def linked(members: np.ndarray, max_bits: int, least: int) -> list[tuple[int, int]]:
    """Pairs (fingerprint, other) that join up the members of one list that are within
    ``max_bits``, after at least ``least`` shared positional bytes were tallied.

    ``members`` are distinct.  A pair that other pairs already join is left out.
    """
    root = list(range(len(members)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    marks = members.view("<u8")
    for a in range(0, len(marks), BLOCK):
        odd = marks[a : a + BLOCK, None] ^ marks[None, a + 1 :]
        shared = (odd[..., None].view("u1") == 0).sum(axis=-1)
        near = (shared >= least) & (np.bitwise_count(odd) <= max_bits)
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            i, j = a + i, a + 1 + j
            if i < j and (p := find(i)) != (q := find(j)):
                root[max(p, q)] = min(p, q)
                out.append((int(members[i]), int(members[j])))
    return out


def near_pairs(marks: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs (a, b) of the distinct longs in the one column ``mark`` that join up all
    fingerprints linked by at most ``max_bits`` differing bits, directly or in a chain."""
    least = POSITIONS - max_bits
    if least < 1:
        raise ValueError("fingerprints must share at least one byte position")

    def postings() -> Iterator[Column]:
        for k, chosen in enumerate(itertools.combinations(range(POSITIONS), least)):
            mask = sum(0xFF << (8 * p) for p in chosen)
            signed = mask - (1 << 64) if mask >> 63 else mask
            key = F.col("mark").bitwiseAND(F.lit(signed).cast("long"))
            yield F.struct(F.lit(k).alias("positions"), key.alias("bytes"))

    lists = (
        marks.select("mark", F.explode(F.array(*postings())).alias("p"))
        .groupBy("p.positions", "p.bytes")
        .agg(F.collect_list("mark").alias("marks"))
        .filter(F.size("marks") > 1)
        .select("marks")
    )

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], None] = {}
            for group in batch["marks"]:
                members = np.sort(group.values.to_numpy(zero_copy_only=False))
                found.update(dict.fromkeys(linked(members, max_bits, least)))
            ends = np.array(list(found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(e) for e in ends.T], ["a", "b"])

    return lists.mapInArrow(verified, "a long, b long")


def _components(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int
) -> DataFrame:
    """doc_id, mark, raw, root (a fingerprint of the component) and component_id of every row."""
    rows = written(fingerprints(docs, id_col, text_col, shingle), "marks")
    first = written(rows.groupBy("mark").agg(F.min("doc_id").alias("first")), "marks-first")
    roots = connected_components(near_pairs(first.select("mark"), max_bits))
    classes = first.join(roots, first["mark"] == roots["node"], "left").select(
        "mark", "first", F.coalesce("root", "mark").alias("root")
    )
    classes = written(classes, "marks-classes")
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "root").select("mark", "root", "component_id")
    return rows.join(named, "mark")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_bits: int = 2,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits) and
    component_id, the smallest id that links of at most ``max_bits`` reach.

    Equal fingerprints are one entry of the index, so a group of copies of any size costs one
    row.  Null and empty texts have fingerprint zero and are linked like any other.  A null
    id never names a component unless all its ids are null.  Rows that repeat an id are
    linked by their own texts; an empty table gives an empty result.
    """
    return _components(docs, id_col, text_col, shingle, max_bits).select(
        "doc_id",
        F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def without_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_bits: int = 2,
) -> DataFrame:
    """``docs`` with one row of each component, all columns unchanged: the smallest id, null
    ids last, then the smallest hash of the text, also where rows repeat an id."""
    rows = _components(docs, id_col, text_col, shingle, max_bits)
    rows = written(rows.select("root", "doc_id", "raw"), "near-rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw"))
    firsts = rows.groupBy("root").agg(least.alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.filter("n > 1").select("root", "first"), "near-firsts")
    kept = F.expr("doc_id <=> first.doc_id AND raw = first.raw")
    verdicts = rows.join(sized(firsts), "root").select("doc_id", "raw", kept.alias("kept"))
    return keep_one(docs, written(verdicts, "near-verdicts"), id_col, text_col)
