from __future__ import annotations

import os

import public_tokenizers
import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def documents(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


@pytest.fixture(scope="session")
def tokenizer_path():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def tokenizer(tokenizer_path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text), with columns whose names the operators use inside."""

    def make(rows):
        kinds = "doc_id long, text string, lang string, source string, n_words long, `key` string, "
        kinds += "epoch string, normal string, size int, data string, mark string, kept string"
        full = [(d, t, "en", "src1", 1, "k", "e", "n", 2, "d", "m", "x") for d, t in rows]
        return spark.createDataFrame(full, kinds)

    return make


ODD = [
    (5, None),
    (3, ""),
    (4, " \n\t "),
    (9, "one"),
    (8, "one two"),
    (7, "One two three\n\n\nfour  five\t six"),
    (6, "One two three\nfour five six"),
    (2, "ä ö ü é — 語   x y <|endoftext|> z"),
    (1, "<|endoftext|>"),
    (10, "aaaa " * 400),
    (11, "aaaa " * 400),
    (12, "b" * 3000),
    (13, "line\n" * 300 + "# | * $"),
    (14, "w%d " * 60),
    (15, " ".join(f"w{i}" for i in range(20000))),
    (16, " ".join(f"w{i}" for i in range(10, 19000))),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
