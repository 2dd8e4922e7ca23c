from __future__ import annotations

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from postlake import schema as S
from postlake.operators.runs import dedup_first, merge_split_rows
from postlake.plans.clean import prepare_feed
from postlake.sources.archives import archive_lines, write_archives
from postlake.sources.feed import prefecture_dimension, read_feed, read_zipped_feed
from tests import feed_rules

SAMPLE = [
    ("01101", "0600000", "北海道", "札幌市中央区", "以下に掲載がない場合", "0"),
    ("13101", "1000001", "東京都", "千代田区", "千代田", "0"),
    ("13102", "1040061", "東京都", "中央区", "銀座（１丁目）", "0"),
    ("01224", "0660005", "北海道", "千歳市", "協和（８８－２、２７１－１０、", "0"),
    ("01224", "0660005", "北海道", "千歳市", "４２７－３番地）", "0"),
    ("23233", "4520961", "愛知県", "清須市", "春日一番割", "1"),
    ("23233", "4520961", "愛知県", "清須市", "春日江先", "1"),
    ("23233", "4520961", "愛知県", "清須市", "春日桑", "0"),
    ("13103", "1050001", "東京都", "港区", "センター町", "0"),
    ("13101", "1000001", "東京都", "千代田区", "千代田", "0"),
    ("99999", "9990001", "不明県", "不明市", "あ（い（う）え）お", "0"),
    ("26104", "6040000", "京都府", "中京区", "以下に掲載がない場合", "0"),
    ("26104", "6040000", "京都府", "中京区", "丸太町、竹屋町", "0"),
    ("26104", "6040001", "京都府", "中京区", "閉）だけ", "0"),
    ("26104", "6040000", "京都府", "中京区", "二条", "0"),
    ("13999", "1000001", "東京都", "千代田区", "千代田", "0"),
    None,
    ("13101", "1000002", "東京都", "千代田区", "皇居外苑（以下", "0"),
    ("13101", "1000002", "東京都", "千代田区", "続き", "0"),
]
EXPECTED = [
    ("0600000", 1, "01101", "北海道", "札幌市中央区", ""),
    ("1000001", 13, "13101", "東京都", "千代田区", "千代田"),
    ("1040061", 13, "13102", "東京都", "中央区", "銀座"),
    ("0660005", 1, "01224", "北海道", "千歳市", "協和427－3番地"),
    ("4520961", 23, "23233", "愛知県", "清須市", "春日一番割"),
    ("4520961", 23, "23233", "愛知県", "清須市", "春日江先"),
    ("4520961", 23, "23233", "愛知県", "清須市", "春日桑"),
    ("1050001", 13, "13103", "東京都", "港区", "センタ-町"),
    ("9990001", 0, "99999", "不明県", "不明市", "あお"),
    ("6040000", 26, "26104", "京都府", "中京区", "丸太町,竹屋町"),
    ("6040001", 26, "26104", "京都府", "中京区", "閉だけ"),
    ("6040000", 26, "26104", "京都府", "中京区", "二条"),
    ("1000002", 13, "13101", "東京都", "千代田区", "皇居外苑続き"),
]


def line_of(row) -> list[str]:
    if row is None:
        return ["broken"]
    city_id, zip_code, pref, city, town, flag = row
    fields = [""] * S.FEED_WIDTH
    for i, v in zip((0, 2, 6, 7, 8, 12), (city_id, zip_code, pref, city, town, flag), strict=True):
        fields[i] = v
    return fields


def csv_text(lines: list[list[str]]) -> str:
    return "".join(",".join(f'"{v}"' for v in line) + "\r\n" for line in lines)


def rows(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("moved", [False, True])
def test_sample_feed(spark, tmp_path, moved):
    lines = [line_of(r) for r in SAMPLE]
    if moved:  # a malformed line between two rows does not keep them apart
        lines = lines[:16] + [lines[17], lines[16], lines[18]]
    (tmp_path / "feed.csv").write_bytes(csv_text(lines).encode("cp932"))
    good, quarantine = read_feed(spark, str(tmp_path))
    assert rows(prepare_feed(good, prefecture_dimension(spark))) == sorted(EXPECTED)
    assert [r.line for r in quarantine.collect()] == ['"broken"']


def test_merge_before_strip(spark, tmp_path):
    lines = [line_of(r) for r in SAMPLE]
    (tmp_path / "feed.csv").write_bytes(csv_text(lines).encode("cp932"))
    good, _ = read_feed(spark, str(tmp_path))
    got = rows(prepare_feed(good, prefecture_dimension(spark), merge_before_strip=True))
    assert got == sorted(feed_rules.addresses(lines, merge_before_strip=True))
    assert ("0660005", 1, "01224", "北海道", "千歳市", "協和") in got


@pytest.mark.parametrize("zipped", [False, True])
def test_width_of_the_first_record(spark, tmp_path, zipped):
    lines = [line[:11] for line in (line_of(r) for r in SAMPLE[:3])] + [["short"]]
    data = csv_text(lines).encode("cp932")
    if zipped:
        with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
            z.writestr("feed.csv", data)
    else:
        (tmp_path / "feed.csv").write_bytes(data)
    read = read_zipped_feed if zipped else read_feed
    good, bad = read(spark, str(tmp_path))
    assert (good.count(), bad.select("feed_file", "line").count()) == (0, 4)
    good, bad = read(spark, str(tmp_path), width=None)
    got = good.select("zip_code", "town", "flag").collect()
    assert sorted((r.zip_code, r.flag) for r in got) == sorted((s[1], False) for s in SAMPLE[:3])
    assert bad.select("feed_file", "line").count() == 1


def test_line_break_inside_quotes(spark, tmp_path):
    line = line_of(("13101", "1000001", "東京都", "千代田区", "千代\n田", "0"))
    (tmp_path / "feed.csv").write_text(csv_text([line, line]), encoding="utf-8", newline="")
    good, bad = read_feed(spark, str(tmp_path), encoding="utf-8", multi_line=True)
    assert [r.town for r in good.collect()] == ["千代\n田"] * 2
    assert bad.select("feed_file", "line").count() == 0


def random_lines(rng: random.Random, n: int) -> list[list[str]]:
    towns = ["あ", "い（ろ", "は）に", "１番（東（西）北）", "以下に掲載がない場合", "", "セー、"]
    out = []
    while len(out) < n:
        zip_code, city = f"{rng.randrange(40):07d}", f"{rng.randrange(2):05d}"
        pref = rng.choice(["東京都", "大阪府", "？県"])
        for _ in range(rng.choice([1, 1, 1, 2, 3, 9])):
            flag = rng.choice("0001")
            line = line_of((city, zip_code, pref, "市", rng.choice(towns), flag))
            out.append(line[: rng.randrange(1, 15)] if rng.random() < 0.02 else line)
    return out


@pytest.mark.parametrize("block_rows", [7, 64, 100_000])
def test_random_feed_over_many_splits(spark, tmp_path, block_rows):
    lines = random_lines(random.Random(5), 4000)
    (tmp_path / "feed.csv").write_text(csv_text(lines), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        good, quarantine = read_feed(spark, str(tmp_path), encoding="utf-8")
        assert good.rdd.getNumPartitions() >= 3
        got = rows(prepare_feed(good, prefecture_dimension(spark), block_rows=block_rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(feed_rules.addresses(lines))
    bad = sum(len(x) != S.FEED_WIDTH for x in lines)
    assert quarantine.select("feed_file", "line").count() == bad


def test_one_key_holding_everything_merges_across_blocks(spark):
    n = 500
    df = spark.range(n).select(
        F.lit("f").alias("feed_file"),
        F.col("id").alias("line_no"),
        F.lit("1").alias("k"),
        F.format_string("%03d", F.col("id")).alias("town"),
        (F.col("id") == 250).alias("flag"),
    )
    got = merge_split_rows(df, ["k"], "town", "flag", block_rows=16).orderBy("line_no").collect()
    assert [r.line_no for r in got] == [0, 250, 251]
    assert got[0].town == "".join(f"{i:03d}" for i in range(250))
    assert got[2].town == "".join(f"{i:03d}" for i in range(251, n))


def test_gap_in_line_numbers_ends_a_run(spark):
    df = spark.createDataFrame(
        [("f", 0, "a", "x", False), ("f", 2, "a", "y", False), ("f", 3, "a", "z", False)],
        "feed_file string, line_no long, k string, town string, flag boolean",
    )
    got = merge_split_rows(df, ["k"], "town", "flag", block_rows=2).orderBy("line_no").collect()
    assert [(r.line_no, r.town) for r in got] == [(0, "x"), (2, "yz")]


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("m", 3, None)], "k string, n int, v string")
    assert rows(dedup_first(df, ["k"], ["n"]).fillna("-")) == [("k", 1, "a"), ("m", 3, "-")]


def test_zip_archives(spark, tmp_path):
    lines = [line_of(r) for r in SAMPLE] + [line_of(("1", "0000001", "①県", "町", "①", "0"))]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("feed.csv", csv_text(lines).encode("cp932"))
        z.writestr("second.csv", csv_text([line_of(("9", "9", "9", "9", "9", "0"))]))
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    (tmp_path / "junk.zip").write_bytes(b"nothing")
    good, quarantine = read_zipped_feed(spark, str(tmp_path))
    expected = EXPECTED + [("0000001", 0, "1", "①県", "町", "①")]
    assert rows(prepare_feed(good, prefecture_dimension(spark))) == sorted(expected)
    found = sorted(r.line.split(":")[0] for r in quarantine.collect())
    assert found == ['"broken"', "archive has no entry", "unreadable archive"]


def test_header_is_skipped(spark, tmp_path):
    lines = [[f"h{i}" for i in range(S.FEED_WIDTH)]] + [line_of(r) for r in SAMPLE]
    for name in ("x", "y"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("feed.csv", csv_text(lines).encode("cp932"))
    good, _ = read_zipped_feed(spark, str(tmp_path), header=True)
    assert rows(prepare_feed(good, prefecture_dimension(spark))) == sorted(EXPECTED)


def test_charset_needs_the_switch(spark, tmp_path):
    spark.conf.set("spark.sql.legacy.javaCharsets", "false")
    try:
        with pytest.raises(ValueError, match="javaCharsets"):
            read_feed(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def test_prefecture_dimension_from_json(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"id": 1, "label": "北海道"}]', encoding="utf-8")
    assert rows(prefecture_dimension(spark, str(tmp_path / "p.json"))) == [(1, "北海道")]
    assert prefecture_dimension(spark).count() == 48


def test_joined_files_are_one_feed(spark, tmp_path):
    lines = [line_of(r) for r in SAMPLE]
    for name, part in (("a", lines[:4]), ("b", lines[4:18]), ("c", lines[18:])):
        (tmp_path / f"{name}.csv").write_bytes(csv_text(part).encode("cp932"))
    good, _ = read_feed(spark, str(tmp_path), joined=True)
    assert rows(prepare_feed(good, prefecture_dimension(spark))) == sorted(EXPECTED)
    assert sorted(r.line_no for r in good.collect()) == list(range(18))


def test_joined_parts_are_ordered_by_number(spark, tmp_path):
    line = '01101,"060","0600001","a","b","c","北海道","札幌市",{},0,0,0,0,0,0'
    for number, town in ((99_999, "前"), (100_000, "後")):
        row = line.format('"' + town + '"')
        (tmp_path / f"part-{number:05d}-x.csv").write_text(row + "\n", encoding="utf-8")
    good, _ = read_feed(spark, str(tmp_path), encoding="utf-8", joined=True)
    assert [r.town for r in good.orderBy("line_no").collect()] == ["前", "後"]


def test_damaged_archive_gives_one_quarantine_row(spark, tmp_path):
    text = "\n".join(f'01101,"060","{n:07d}","a","b","c","p","c","t",0,0,0,0,0,0' for n in range(5000))
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", text)
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 1
    path.write_bytes(bytes(data))
    good, bad = read_zipped_feed(spark, str(tmp_path), encoding="utf-8")
    assert good.count() == 0
    assert [r.line.startswith("unreadable archive") for r in bad.collect()] == [True]


def test_every_number_in_a_name_counts(spark, tmp_path):
    order = ["2024-9/a_1.csv", "2024-10/a_1.csv", "2025/utf8_1_part-99999.csv", "2025/utf8_1_part-100000.csv"]
    order += ["2025/utf8_1_part-100000b.csv", "2025/utf8_02_part-3.csv", "2025/utf8_10_part-1.csv", "2026/x.csv"]
    for k, name in enumerate(order):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(csv_text([line_of(("01101", f"{k:07d}", "北海道", "市", "T", "0"))]))
    paths = [str(tmp_path / n) for n in reversed(order)]
    good, _ = read_feed(spark, paths, encoding="utf-8", joined=True)
    assert [r.zip_code for r in good.orderBy("line_no").collect()] == [f"{k:07d}" for k in range(len(order))]


def archive(path, text, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        z.writestr("a.csv", text)
    return path


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_archives_of_each_method_and_their_damage(spark, tmp_path, method):
    text = csv_text([line_of(("01101", f"{n:07d}", "北海道", "市", f"T{n}", "0")) for n in range(3000)])
    archive(tmp_path / "good.zip", text.encode("cp932"), method)
    data = bytearray(archive(tmp_path / "bad.zip", text.encode("cp932"), method).read_bytes())
    data[len(data) // 2] ^= 0xFF
    (tmp_path / "bad.zip").write_bytes(bytes(data))
    (tmp_path / "cut.zip").write_bytes(bytes(data[: len(data) // 2]))
    good, bad = read_zipped_feed(spark, str(tmp_path))
    assert good.select("feed_file").distinct().count() == 1 and good.count() == 3000
    found = {r.feed_file.rsplit("/", 1)[1]: r.line[:18] for r in bad.collect()}
    assert found == {"bad.zip": "unreadable archive", "cut.zip": "unreadable archive"}


def test_encrypted_and_unknown_archives(spark, tmp_path):
    text = csv_text([line_of(SAMPLE[0])])
    data = archive(tmp_path / "x.zip", text.encode("cp932")).read_bytes()
    at = data.index(b"PK\x01\x02")
    locked, unknown = bytearray(data), bytearray(data)
    locked[6] |= 1
    locked[at + 8] |= 1
    unknown[8], unknown[at + 10] = 99, 99
    (tmp_path / "locked.zip").write_bytes(bytes(locked))
    (tmp_path / "unknown.zip").write_bytes(bytes(unknown))
    good, bad = read_zipped_feed(spark, str(tmp_path))
    assert good.count() == 1
    found = {r.feed_file.rsplit("/", 1)[1]: r.line for r in bad.collect()}
    assert set(found) == {"locked.zip", "unknown.zip"} and "encrypted" in found["locked.zip"]


def test_archives_are_not_held_whole(spark, tmp_path):
    """Spark refuses to load a file beyond this length; only its path is asked for."""
    lines = [line_of(r) for r in SAMPLE]
    archive(tmp_path / "a b.zip", csv_text(lines).encode("cp932"))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "10")
    try:
        good, _ = read_zipped_feed(spark, str(tmp_path))
        assert rows(prepare_feed(good, prefecture_dimension(spark))) == sorted(EXPECTED)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_line_breaks_inside_quotes_of_archives(spark, tmp_path):
    broken = line_of(("01101", "0600001", "北海道", "市", "上\n下", "0"))
    text = csv_text([line_of(SAMPLE[0]), broken, line_of(SAMPLE[1])])
    archive(tmp_path / "a.zip", text.encode("cp932"))
    good, bad = read_zipped_feed(spark, str(tmp_path), multi_line=True)
    assert good.count() == 3 and bad.count() == 0
    assert [r.town for r in good.filter("zip_code = '0600001' AND city = '市'").collect()] == ["上\n下"]


def test_written_archives_are_read_back(spark, tmp_path):
    lines = spark.range(0, 1000, 1, 4).selectExpr("CASE WHEN id % 10 < 9 THEN concat('行,', id) END AS line", "id")
    out = str(tmp_path / "out")
    assert write_archives(lines.filter("id < 500"), out, "lzma") == 2  # two partitions are empty
    got = archive_lines(spark, out).collect()
    assert [r.line for r in sorted(got, key=lambda r: r.feed_file)] == [f"行,{n}" for n in range(500) if n % 10 < 9]
    assert write_archives(lines.filter("id < 0"), str(tmp_path / "none")) == 0
