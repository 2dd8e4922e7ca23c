from __future__ import annotations

import random
import unicodedata
from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlake import schema as S
from postlake.functions import text
from postlake.plans.versions import version_id
from tests.feed_rules import strip_parens


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_fixed_values():
    assert len(S.PREFECTURES) == 48 and S.PREFECTURES[13] == "東京都"
    assert S.PREFECTURES[27] == "大阪府" and S.PREFECTURES[47] == "沖縄県"
    assert len(S.HIRAGANA) == len(S.KATAKANA) == 86
    assert (S.HIRAGANA[0], S.KATAKANA[0]) == ("ぁ", "ァ")


def test_widths(spark):
    assert apply(spark, text.fold_width, ["（１）ー、９－Ａ", None]) == ["(1)-,9－Ａ", None]


def test_parens(spark):
    rng = random.Random(1)
    values = ["a(b(c)d)e", "a(b", "a)b", "", "()", ")(", "((((a))))b", "a(b)c(d)e"]
    values += ["".join(rng.choice("()()ab") for _ in range(rng.randrange(40))) for _ in range(500)]
    assert apply(spark, text.strip_parens, values) == [strip_parens(v) for v in values]


def test_unlisted(spark):
    assert apply(spark, text.blank_unlisted, [S.UNLISTED_TOWN, "a" + S.UNLISTED_TOWN]) == [
        "",
        "a" + S.UNLISTED_TOWN,
    ]


def test_normalise(spark):
    values = ["  ｼﾝ ｼﾞｭｸ  ", "１２３　４", "a b c\u0085d", "abc", None, "㍿", "が"]
    want = [
        None if v is None else "".join(c for c in unicodedata.normalize("NFKC", v) if not c.isspace())
        for v in values
    ]
    got = apply(spark, text.normalize_keyword, values)
    assert got == want and got[:2] == ["シンジュク", "1234"]


def test_nfkc_takes_few_values_at_a_time(spark):
    values = [None, "abc", "ＡＢＣ　１", "é e\u0301", "㍿", "ｶﾞ", "ﬁ①", "😀𠮷", "\uff21" * 5000, "a\u0323\u0307b"] * 30
    want = [None if v is None else unicodedata.normalize("NFKC", v) for v in values]
    assert apply(spark, text.nfkc, values) == want
    plan = spark.createDataFrame([("é",)], "v string").select(text.nfkc(F.col("v")))
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in shown and "ArrowEvalPython" not in shown


def test_kana(spark):
    assert apply(spark, text.to_katakana, ["しんじゅく", "ゔ", "ー新a"]) == ["シンジュク", "ヴ", "ー新a"]
    assert apply(spark, text.to_hiragana, ["シンジュク", "ヴ", "ーヷ"]) == ["しんじゅく", "ゔ", "ーヷ"]


def test_candidates(spark):
    got = apply(spark, text.search_candidates, ["しんじゅく", "新宿", "", "シんー"])
    assert got == [
        ["しんじゅく", "シンジュク"],
        ["新宿"],
        [],
        ["シんー", "シンー", "しんー"],
    ]
    folded = apply(spark, lambda c: text.search_candidates(c, True), ["センター"])
    assert folded == [["センター", "せんたー", "センタ-"]]


@pytest.mark.parametrize(
    ("mode", "want"), [("exact", "新宿"), ("prefix", "新宿%"), ("partial", "%新宿%")]
)
def test_pattern(spark, mode, want):
    assert apply(spark, lambda c: text.search_pattern(c, mode), ["新宿"]) == [want]


def test_limit(spark):
    assert apply(spark, text.clamp_limit, [None, 0, 1000, 7], "int") == [50, 1, 200, 7]
    client = apply(spark, lambda c: text.clamp_limit(c, True), [None, 0.0, 7.9, -3.0], "double")
    assert client == [50, 50, 7, 1]


def test_zip(spark):
    values = ["〒100-0001x9", "12", "1000001", "１００", ""]
    assert apply(spark, text.normalize_zip, values) == ["1000001", "12", "1000001", "", ""]
    assert apply(spark, lambda c: text.normalize_zip(c, True), ["１００-０００１"]) == ["1000001"]
    assert apply(spark, text.format_zip, values) == ["100-0001", "12", "100-0001", "", ""]
    assert apply(spark, text.format_zip, ["123", "1234"]) == ["123", "123-4"]


def test_version(spark):
    ts = datetime(2026, 2, 12, 21, 37, 5, 123000, tzinfo=UTC)
    assert version_id(ts) == "v20260212213705123"
    got = apply(spark, text.data_version, [ts], "timestamp")
    assert got == ["v20260212213705123"]
    assert apply(spark, lambda c: F.date_format(text.batch_second(c), "ss.SSS"), [ts], "timestamp") == [
        "05.000"
    ]


def test_ratio(spark):
    df = spark.createDataFrame([(1, 4), (0, 0)], "a long, b long")
    got = [r[0] for r in df.select(text.safe_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [0.25, 0.0]


@settings(max_examples=15, deadline=None)
@given(values=st.lists(st.text(alphabet="()（）あa1１ 　ｱ", max_size=30), min_size=1, max_size=40))
def test_any_text(spark, values):
    folded = [v.translate(str.maketrans(S.WIDE_CHARS, S.NARROW_CHARS)) for v in values]
    got = apply(spark, lambda c: text.strip_parens(text.fold_width(c)), values)
    assert got == [strip_parens(v) for v in folded]
