from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from postlake import schema as S
from postlake.operators import catalogue, lookup, search
from postlake.operators.skew import spread_join

G1 = [
    ("1000001", 13, "13101", "東京都", "千代田区", "千代田"),
    ("1500002", 13, "13113", "東京都", "渋谷区", "渋谷"),
    ("1600023", 13, "13104", "東京都", "新宿区", "西新宿"),
    ("5300001", 27, "27127", "大阪府", "大阪市北区", "梅田"),
    ("0600001", 1, "01101", "北海道", "札幌市中央区", "北一条西"),
]
REQUEST = "request_id long, address string, mode string, limit int"


@pytest.fixture(scope="module")
def addresses(spark):
    return spark.createDataFrame(G1, S.ADDRESS).cache()


def hits(df):
    out = {}
    for r in df.orderBy("request_id", "position").collect():
        out.setdefault(r.request_id, []).append(r.zip_code)
    return out


def test_sample_searches(spark, addresses):
    asked = [
        (1, "新宿", "partial", None),
        (2, "西", "prefix", None),
        (3, "東京都", "exact", None),
        (4, "%", "partial", None),
        (5, "\\", "partial", None),
        (6, " 　", "partial", None),
        (7, "東京都新宿", None, None),
        (8, "東京_", "prefix", 2),
        (9, "%", "exact", None),
        (10, "新宿", "fuzzy", None),
    ]
    requests = spark.createDataFrame(asked, REQUEST)
    every = ["0600001", "1000001", "1500002", "1600023", "5300001"]
    want = {
        1: ["1600023"],
        2: ["1600023"],
        3: ["1000001", "1500002", "1600023"],
        4: every,
        8: ["1000001", "1500002"],
    }
    assert hits(search.search_addresses(requests, addresses)) == want
    kept = search.search_addresses(requests, addresses, keep_all=True)
    status = {r.request_id: r.status for r in kept.collect()}
    assert status == {
        **dict.fromkeys((1, 2, 3, 4, 8), "ok"),
        **dict.fromkeys((5, 7, 9), "not_found"),
        6: "empty",
        10: "invalid_mode",
    }
    index = search.column_index(addresses)
    assert hits(search.search_addresses(requests, addresses, index=index)) == want
    assert hits(search.search_concat(requests, addresses)) == {
        1: ["1600023"],
        2: ["0600001", "1600023"],
        3: ["1000001", "1500002", "1600023"],
        7: ["1600023"],
        10: ["1600023"],
    }


def test_control_characters_are_literal(spark):
    rows = spark.createDataFrame([("1", 1, "1", "a\u0001b", "c\\\\d", "t")], S.ADDRESS)
    words = ["a\u0001_", "%\u0001b", "\u0001%c", "c\\\\_", "\\\\d%"]
    asked = [(i, w, "partial", None) for i, w in enumerate(words)]
    got = hits(search.search_addresses(spark.createDataFrame(asked, REQUEST), rows))
    assert sorted(got) == [0, 1, 3, 4]


def test_no_requests(spark, addresses):
    empty = spark.createDataFrame([], REQUEST)
    assert search.search_addresses(empty, addresses).count() == 0


def like(pattern: str, value: str) -> bool:
    parts = {"%": ".*", "_": "."}
    return re.fullmatch("".join(parts.get(c, re.escape(c)) for c in pattern), value, re.S) is not None


def brute_force(requests, rows):
    """Each request on its own, spelling by spelling."""
    kata = str.maketrans(S.HIRAGANA, S.KATAKANA)
    hira = str.maketrans(S.KATAKANA, S.HIRAGANA)
    order = sorted(set(rows), key=lambda r: (r[0], r[1], r[2], r[4], r[5], r[3]))
    out = {}
    for request_id, address, mode, limit in requests:
        word = "".join(c for c in unicodedata.normalize("NFKC", address) if not c.isspace())
        limit = max(1, min(200, 50 if limit is None else limit))
        found = []
        for spelling in dict.fromkeys([word, word.translate(kata), word.translate(hira)]):
            if not spelling:
                continue
            pattern = {"prefix": spelling + "%", "partial": f"%{spelling}%"}.get(mode)
            for r in order:
                columns = (r[3], r[4], r[5])
                ok = spelling in columns if mode == "exact" else any(like(pattern, c) for c in columns)
                if ok and r not in found:
                    found.append(r)
        if found:
            out[request_id] = [r[0] for r in found[:limit]]
    return out


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0, "hot_rows": 5}, {"broadcast_rows": 0}])
def test_random_searches_against_brute_force(spark, limits):
    rng = random.Random(3)

    def word(n):
        return "".join(rng.choice("アイあい1京_%") for _ in range(rng.randrange(n)))

    rows = [
        (f"{i:07d}", 1, "1", rng.choice(["京ア", "あ", "イ"]), word(4), word(6)) for i in range(400)
    ]
    asked = [
        (i, rng.choice([word(4), "ｱ", "あ い", "%", "_", "__%", "アイ"]), mode, rng.choice([None, 3, 999]))
        for i, mode in enumerate(rng.choices(["exact", "prefix", "partial"], k=300))
    ]
    requests = spark.createDataFrame(asked, REQUEST)
    got = hits(search.search_addresses(requests, spark.createDataFrame(rows, S.ADDRESS), **limits))
    assert got == brute_force(asked, rows)


def test_popular_token_keeps_the_first_records(spark):
    rows = spark.range(3000).select(
        F.format_string("%07d", 2999 - F.col("id")).alias("zip_code"),
        F.lit(1).cast("smallint").alias("prefecture_id"),
        F.lit("1").alias("city_id"),
        F.lit("北海道").alias("prefecture"),
        F.lit("市").alias("city"),
        F.format_string("町%d", F.col("id")).alias("town"),
    )
    asked = [(i, w, m, 500) for i, (w, m) in enumerate([("北海", "prefix"), ("町", "partial"), ("市", "exact")])]
    got = hits(search.search_addresses(spark.createDataFrame(asked, REQUEST), rows))
    assert got == {i: [f"{n:07d}" for n in range(200)] for i in range(3)}


def test_fold_search_width(spark):
    rows = spark.createDataFrame([("1050001", 13, "13103", "東京都", "港区", "センタ-町")], S.ADDRESS)
    asked = spark.createDataFrame([(1, "センター", "partial", None)], REQUEST)
    assert hits(search.search_addresses(asked, rows)) == {}
    assert hits(search.search_addresses(asked, rows, fold_search_width=True)) == {1: ["1050001"]}


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0, "hot_rows": 2}])
def test_zip_lookup(spark, addresses, limits):
    rows = addresses.union(spark.createDataFrame([(*G1[0][:5], "二")], S.ADDRESS))
    asked = [(1, "〒100-0001"), (2, "9999999"), (3, "12"), (4, None), (5, "1000001"), (6, "1000001")]
    requests = spark.createDataFrame(asked, "request_id long, zip string")
    got = lookup.lookup_zip(requests, rows, **limits).collect()
    assert sorted((r.request_id, r.status, r.town or "") for r in got) == [
        (1, "ok", "二"),
        (1, "ok", "千代田"),
        (2, "not_found", ""),
        (3, "invalid", ""),
        (4, "invalid", ""),
        (5, "ok", "二"),
        (5, "ok", "千代田"),
        (6, "ok", "二"),
        (6, "ok", "千代田"),
    ]
    one = lookup.lookup_zip_one(rows, "100-0001").collect()
    assert {r.town for r in one} == {"千代田", "二"}


def test_autofill_and_cascade(spark, addresses):
    rows = addresses.union(
        spark.createDataFrame([("1000001", 13, "13100", "東京都", "別区", "い")], S.ADDRESS)
    )
    form = spark.createDataFrame(
        [(1, "100-0001", "x", "y"), (2, "999-9999", "x", "y"), (3, "1", "x", "y")],
        "id long, zip_code string, prefecture string, town string",
    )
    got = lookup.enrich_addresses(form, rows).orderBy("id").collect()
    assert [tuple(r[c] for c in ("zip_code", "prefecture", "city", "town", "candidate_count", "status")) for r in got] == [
        ("1000001", "東京都", "別区", "い", 2, "ok"),
        ("999-9999", "x", None, "y", 0, "not_found"),
        ("1", "x", None, "y", 0, "invalid"),
    ]
    asked = spark.createDataFrame([(1, "1600023"), (2, "0")], "request_id long, zip string")
    options = lookup.zip_city_options(asked, rows).orderBy("city_id").collect()
    assert [(r.request_id, r.city_id, r.selected) for r in options] == [
        (1, "13100", False),
        (1, "13101", False),
        (1, "13104", True),
        (1, "13113", False),
    ]


def test_catalogue(spark, addresses):
    assert [tuple(r) for r in catalogue.prefectures(addresses).collect()] == [
        (1, "北海道"),
        (13, "東京都"),
        (27, "大阪府"),
    ]
    assert [r.city_id for r in catalogue.cities(addresses, 13).collect()] == ["13101", "13104", "13113"]
    some = spark.createDataFrame([(1,), (27,), (1,)], "prefecture_id smallint")
    assert [r.city_id for r in catalogue.cities(addresses, prefecture_ids=some).collect()] == ["01101", "27127"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_join(spark, how):
    left = spark.range(2000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 != 0, F.col("id") % 50).alias("k")
    )
    right = spark.createDataFrame([(0, "a"), (0, "b"), (4, "c"), (None, "d")], "k long, v string")
    spread = spread_join(left, right, ["k"], how, F.col("id"), hot_rows=30)
    plain = left.join(right, ["k"], how)
    assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))


def test_hot_key_is_split_over_tasks(spark):
    """A third of the rows share one key; no task gets much more than its share."""
    n, tasks = 6000, 8
    left = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    settings = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": str(tasks),
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = spread_join(left, right, ["k"], "inner", F.col("id"), hot_rows=50)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(sizes) == n and max(sizes) < 1.6 * n / tasks


def test_parts_meet_through_their_rarest_gram(spark):
    addresses = spark.createDataFrame(
        [(f"{k:07d}", 1, "c", "東京都", "いろはいろは市", f"いろは{k % 7}ににほ{k}") for k in range(60)]
        + [("9000000", 2, "c", "😀𠮷", "市", "ab%c_d"), ("9000001", 2, "c", "", "", "")],
        S.ADDRESS,
    )
    asked = ["いろはい", "ろはいろは", "にほ59", "ににほ1", "に", "にほ", "𠮷", "😀𠮷", "b%c", "c_d", "存在しない", "いろは3に", "%いろは市", "はいろはい"]
    requests = spark.createDataFrame([(i, a, "partial", 200) for i, a in enumerate(asked)], S.SEARCH_REQUEST)
    rows = addresses.collect()

    def like(pattern, value):
        return re.fullmatch(re.escape(pattern).replace("%", ".*").replace("_", "."), value, re.S) is not None

    want = set()
    for i, a in enumerate(asked):
        for r in rows:
            if any(like(f"%{x}%", v) for x in {a, *text_forms(a)} for v in (r.prefecture, r.city, r.town)):
                want.add((i, r.zip_code))
    for small in (None, 0):  # broadcast, and shuffled with spread keys
        sizes = {} if small is None else {"broadcast_rows": 0, "hot_rows": 2}
        got = search.search_addresses(requests, addresses, **sizes)
        assert {(r.request_id, r.zip_code) for r in got.collect()} == want


def text_forms(keyword):
    """The keyword in katakana and in hiragana."""
    to_katakana = str.maketrans(S.HIRAGANA, S.KATAKANA)
    return keyword.translate(to_katakana), keyword.translate(str.maketrans(S.KATAKANA, S.HIRAGANA))


def test_a_term_looks_at_no_more_tokens_than_its_rarest_gram(spark):
    addresses = spark.createDataFrame([(f"{k:07d}", 1, "c", "p", "common", f"common{k:03d}") for k in range(300)], S.ADDRESS)
    index = search.column_index(addresses)
    terms = spark.createDataFrame([("common123",), ("common",), ("xyz",)], "key string")
    found = {r.key: r.gram for r in search._rarest(terms, index.grams).collect()}
    held = dict(index.grams.groupBy("gram").count().collect())
    assert set(found) == {"common123", "common"} and held[found["common123"]] == 1


def test_long_terms_look_at_few_tokens_however_small_the_alphabet(spark):
    numbers = [f"丁{k * 7919 * 104729 % 10**9:09d}" for k in range(2000)]
    addresses = spark.createDataFrame([(f"{k:07d}", 1, "c", "p", "city", x) for k, x in enumerate(numbers)], S.ADDRESS)
    index = search.column_index(addresses)
    found = search._rarest(spark.createDataFrame([(x,) for x in numbers], "key string"), index.grams).collect()
    held = dict(index.grams.groupBy("gram").count().collect())
    assert {r.key for r in found} == set(numbers) and sum(held[r.gram] for r in found) < 1.1 * len(numbers)


@pytest.mark.parametrize("popular", [0, 4])
def test_many_terms_meet_popular_and_rare_grams(spark, monkeypatch, popular):
    monkeypatch.setattr(search, "POPULAR", popular, raising=False)
    rows = [(f"{k:07d}", 1, "c", "県", f"HOUSEHOLD-{k % 3}", f"丁{k:09d}丁{k:09d}") for k in range(60)]
    addresses = spark.createDataFrame([*rows, ("9", 2, "c", "県", "HOUSEHOLD-1", "")], S.ADDRESS)
    words = ["県", "県H", "HOUSEHOLD-1", "LD-2丁0000", "丁000000031丁", "000000007", "0000000", "1丁", "none", "HOUSEHOLDS", "59丁000000059"]
    requests = spark.createDataFrame([(i, w, "partial", 200) for i, w in enumerate(words)], REQUEST)
    town = {r[0]: "".join(r[3:6]) for r in rows} | {"9": "県HOUSEHOLD-1"}
    want = {i: sorted(z for z, x in town.items() if w in x) for i, w in enumerate(words)}
    got = hits(search.search_concat(requests, addresses, broadcast_rows=0, hot_rows=3))
    assert got == {i: z for i, z in want.items() if z}
