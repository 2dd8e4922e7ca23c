from __future__ import annotations

import random

import numpy as np
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest

from postlake.llm import packing, token_counts, token_files
from postlake.llm.encoding import Encoder
from postlake.session import scratch_path
from tests.llm import brute


def test_encoder_equals_the_library(tokenizer, tokenizer_path, documents, odd):
    own = Encoder(tokenizer_path)
    for _, text in [*documents, *odd]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == brute.ids(tokenizer, text)


def test_encoder_on_odd_white_space(tokenizer, tokenizer_path):
    rnd = random.Random(1)
    parts = ["a", "B.", " ", "\n", "\t", "1", "'s", ".", "é", "\x1c", "\x85", "<|endoftext|>", "  ", "’", "…", "語", "꟎"]
    own = Encoder(tokenizer_path)
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == brute.ids(tokenizer, text), text


def test_other_kinds_of_tokenizer_go_to_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = Encoder(path), Tokenizer.from_file(path)
    text = "Some words, and <|endoftext|> more"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == brute.ids(library, text)


@pytest.mark.parametrize("rows", [0, 50, 50_000])
def test_token_counts(frame, tokenizer, tokenizer_path, documents, odd, rows):
    docs = [*documents[:50], *((1000 + d, t) for d, t in odd), (None, "x"), (1, "y")]
    got = token_counts.token_counts(frame(docs), tokenizer_path, 512, table_rows=rows)
    want = []
    for d, t in docs:
        n = len(brute.ids(tokenizer, t))
        want.append((d, len((t or "").encode()), n, n > 512))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(frame([]), tokenizer_path, 512).count() == 0


def test_token_files(spark, frame, tokenizer, tokenizer_path, documents, odd):
    docs = [*((1000 + d, t) for d, t in odd), *documents]
    path = scratch_path(spark, "test-tokens")
    token_files.write_tokens(token_files.encoded(frame(docs), tokenizer_path, 2), path)
    got = token_files.crc32_of(token_files.read_tokens(spark, path))
    want, start = [], 0
    for d, t in sorted(docs):
        tokens = [*brute.ids(tokenizer, t), 2]
        want.append((d, start, len(tokens), brute.crc32(tokens)))
        start += len(tokens)
    assert rows_of(got) == want


def rows_of(df):
    return sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in df.collect())


def test_token_files_null_and_repeated_ids_and_no_rows(spark, frame, tokenizer_path):
    docs = frame([(None, "a"), (1, "b c"), (1, "b c"), (1, "d")])
    path = scratch_path(spark, "test-tokens")
    token_files.write_tokens(token_files.encoded(docs, tokenizer_path, 2), path)
    got = sorted((r.start, r.n_tokens) for r in token_files.read_tokens(spark, path).collect())
    ends = [s + n for s, n in got]
    assert [s for s, _ in got] == [0, *ends[:-1]] and len(got) == 4
    path = scratch_path(spark, "test-tokens")
    token_files.write_tokens(token_files.encoded(frame([]), tokenizer_path, 2), path)
    assert token_files.read_tokens(spark, path).count() == 0


def test_token_file_layout(spark, frame, tokenizer_path, documents):
    path = scratch_path(spark, "test-tokens")
    token_files.write_tokens(token_files.encoded(frame(documents), tokenizer_path, 2), path)
    for file in ds.dataset(path).files:
        group = pq.read_metadata(file).row_group(0)
        columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
        tokens = columns["tokens.list.element"]
        assert "RLE_DICTIONARY" in tokens.encodings
        assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
        assert tokens.has_offset_index and columns["doc_id"].has_column_index


def check_packing(rows, capacity):
    by = {}
    for sequence, offset, length in rows:
        by.setdefault(sequence, []).append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(frame, tokenizer, tokenizer_path, documents, odd):
    docs = [*documents, *((1000 + d, t) for d, t in odd)]
    packed = packing.pack_documents(frame(docs), tokenizer_path, 2, 1024, with_tokens=True)
    got = packed.collect()
    want = []
    for d, t in docs:
        tokens = [*brute.ids(tokenizer, t), 2]
        cut = len(tokens) % 1024 or 1024
        at = [0, *range(cut, len(tokens), 1024), len(tokens)]
        for k in range(len(at) - 1):
            part = tokens[at[k] : at[k + 1]]
            want.append((d, k, at[k], len(part), brute.crc32(part)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    made = check_packing([(r.sequence_id, r.offset, r.length) for r in got], 1024)
    assert made <= -(-sum(r.length for r in got) // 1024) + 2
    whole = packing.sequences(packed).collect()
    assert sum(len(r.tokens) for r in whole) == sum(r.length for r in got)
    assert len(whole) == made


def test_packing_in_shards(spark):
    rnd = random.Random(2)
    lengths = [rnd.choice([1024, *range(1, 1024)]) for _ in range(4000)]
    pieces = spark.createDataFrame([(None, n) for n in lengths], "doc_id long, length long")
    got = packing.pack(pieces, 1024, shard=500).collect()
    assert sorted(r.length for r in got) == sorted(lengths)
    made = check_packing([(r.sequence_id, r.offset, r.length) for r in got], 1024)

    assert made <= sum(lengths) / 1024 / packing.FULL + 3


def test_packing_of_nothing(frame, tokenizer_path):
    assert packing.pack_documents(frame([]), tokenizer_path, 2, 8).count() == 0
    got = packing.pack_documents(frame([(None, None), (None, None)]), tokenizer_path, 2, 8)
    assert [(r.doc_id, r.length) for r in got.collect()] == [(None, 1)] * 2


def test_sum_of_squares_rule():
    # 6 opens; 4 fits its gap of 4 or a new one; full sequences do not count
    sequence, offset = packing.sum_of_squares(np.array([6, 4, 5, 5, 3]), 10)
    assert len(set(sequence.tolist())) == 3
    assert (offset[sequence == sequence[0]] + np.array([6, 4])[: (sequence == sequence[0]).sum()]).max() == 10
    with pytest.raises(ValueError):
        packing.sum_of_squares(np.array([11]), 10)
