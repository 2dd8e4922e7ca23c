"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table of frequent pre-tokens and their lengths in tokens, fitted on a
bounded sample of texts.  Tier two is the worker's cache, which asks the tokenizer's model for
what the table lacks.  No pre-token is shuffled, and counts do not depend on the table.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.encoding import (
    CACHE,
    PRE_TOKEN,
    UNSURE,
    Cache,
    Encoder,
    Unsplit,
    encoder,
    slices,
    split_words,
)

#: Rows of the broadcast table; pre-tokens longer than TABLE_CHARS stay out, so its size is bounded.
TABLE = 50_000
TABLE_CHARS = 32
#: Texts that the table is fitted on, of at most SAMPLE_CHARS characters each.
SAMPLE, SAMPLE_CHARS = 1_000, 8_000


def frequent_pre_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", rows: int = TABLE
) -> dict[str, int]:
    """Lengths in tokens of the pre-tokens that occur most in some of the shorter texts, which are
    drawn by their hashes, ``SAMPLE`` of them on average and twice as many at most; at most
    ``rows``.  The sample only speeds counting up and decides no count.
    """
    number = docs.count()
    if not number:
        return {}
    drawn = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40)) < (SAMPLE << 40) // number
    short = docs.filter(drawn & (F.length(text_col) <= SAMPLE_CHARS))
    own, seen = encoder(tokenizer), Counter()
    for row in short.select(F.col(text_col).alias("text")).limit(2 * SAMPLE).collect():
        if own.cuttable(row.text):
            seen.update(PRE_TOKEN.findall(row.text))
    best = sorted(((-n, p) for p, n in seen.items() if n > 1 and len(p) <= TABLE_CHARS))[:rows]
    return {p: len(own.pre_tokens[p]) // 4 for _, p in best}


class Lengths:
    """Numbers of tokens of whole texts, through a table of pre-tokens' lengths."""

    def __init__(self, own: Encoder, table: dict[str, int]):
        self.own, self.table = own, table
        self.pre_tokens = Cache(self._pre_token, CACHE // 8)
        self.words = Cache(self._word, CACHE)

    def _pre_token(self, piece: str) -> int:
        n = self.table.get(piece)
        return len(self.own.pre_token(piece)) // 4 if n is None else n

    def _cut(self, text: str) -> int:
        if not text.isascii() and UNSURE.search(text):
            return len(self.own.whole([text])[0]) // 4
        return sum(map(self.pre_tokens.__getitem__, PRE_TOKEN.findall(text)))

    def _word(self, word: str) -> int:
        """Tokens of a word with the space before it, or of a line end with the word after it."""
        if word[:1] == "\n":
            if word == "\n" or word[1:].split() == [word[1:]]:
                return self._cut(word)
        elif word.split() == [word]:
            if word.isalpha() and (word.isascii() or not UNSURE.search(word)):
                return self._pre_token(" " + word)
            return self._cut(" " + word)
        raise Unsplit

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null has none."""
        if not text:
            return 0
        if not self.own.cuts or any(s in text for s in self.own.special):
            return len(self.own.whole([text])[0]) // 4
        try:
            first, rest = split_words(text)
            return self._cut(first) + sum(map(self.words.__getitem__, rest))
        except Unsplit:
            return self._cut(text)


#: The counter of the job that this worker serves; it outlives the task, so its caches stay warm.
_held: dict[str, Lengths] = {}


def _lengths(job: str, tokenizer: str, table: dict[str, int]) -> Lengths:
    if job not in _held:
        _held.clear()
        _held[job] = Lengths(encoder(tokenizer), table)
    return _held[job]


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    limit: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    table_rows: int = TABLE,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Equals the tokenizers library's count for the file ``tokenizer`` without added special
    tokens.  Null texts count as empty; ids may be null or repeat; texts may have any length.
    """
    table = frequent_pre_tokens(docs, tokenizer, id_col, text_col, table_rows)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    job = uuid.uuid4().hex
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(job, tokenizer, shared.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for part in slices(batch["text"]):
                n_bytes += [len((t or "").encode()) for t in part]
                n_tokens += map(lengths.count, part)
            arrays = [batch["doc_id"], pa.array(n_bytes, "int64"), pa.array(n_tokens, "int64")]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens"])

    counts = rows.mapInArrow(counted, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
