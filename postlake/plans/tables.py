"""Postal-shaped views of the given tables, in Spark and in plain SQL.

Every view reads whole tables.  Addresses come from customers, requests and feed lines
from orders, request logs from events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake import schema as S

DIGITS = "0123456789"
KANA_DIGITS = "アイウエオカキクケコ"
HALF_KANA_DIGITS = "ｱｲｳｴｵｶｷｸｹｺ"
HIRA_DIGITS = "あいうえおかきくけこ"
_LABELS = S.PREFECTURES[1:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def pad(c: Column, n: int) -> Column:
    return F.lpad(_text(c), n, "0")


def kana(c: Column, digits: str = KANA_DIGITS) -> Column:
    return F.translate(c, DIGITS, digits)


def prefecture_label(prefecture_id: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in _LABELS]), prefecture_id - 1)


# ---- addresses -----------------------------------------------------------------------

_LABEL_LIST = "[" + ", ".join(f"'{x}'" for x in _LABELS) + "]"


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address per customer; three customers share a zip."""
    key, nation = F.col("c_custkey"), F.col("n_nationkey") + 1
    rows = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return rows.select(
        "c_custkey",
        "c_acctbal",
        pad(F.expr("c_custkey div 3"), 7).alias("zip_code"),
        nation.cast("smallint").alias("prefecture_id"),
        pad(nation * 1000 + key % 40, 5).alias("city_id"),
        prefecture_label(nation).alias("prefecture"),
        F.concat("c_mktsegment", F.lit("-"), _text(key % 40)).alias("city"),
        F.concat(F.lit("丁"), kana(F.substring("c_name", 10, 9))).alias("town"),
    )


ADDR_SQL = f"""
addr_all AS (
  SELECT c_custkey, c_acctbal,
         lpad(CAST(c_custkey // 3 AS VARCHAR), 7, '0') AS zip_code,
         CAST(n_nationkey + 1 AS INTEGER) AS prefecture_id,
         lpad(CAST((n_nationkey + 1) * 1000 + c_custkey % 40 AS VARCHAR), 5, '0') AS city_id,
         ({_LABEL_LIST})[n_nationkey + 1] AS prefecture,
         c_mktsegment || '-' || CAST(c_custkey % 40 AS VARCHAR) AS city,
         '丁' || translate(substr(c_name, 10, 9), '{DIGITS}', '{KANA_DIGITS}') AS town
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
addr AS (
  SELECT zip_code, prefecture_id, city_id, prefecture, city, town FROM addr_all
)"""


def next_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed after that: customers who ever ordered stay, those in debt move to another
    city id, and suppliers are new."""
    orders = table(spark, sf_dir, "orders")
    ordered = orders.select(F.col("o_custkey").alias("c_custkey")).distinct()
    stay = (
        addresses(spark, sf_dir)
        .join(ordered, "c_custkey", "left_semi")
        .withColumn("city_id", F.when(F.col("c_acctbal") < 0, "99999").otherwise(F.col("city_id")))
        .select(*S.ADDRESS_COLUMNS)
    )
    nation = F.col("s_nationkey") + 1
    new = table(spark, sf_dir, "supplier").select(
        pad(F.col("s_suppkey") + 9_000_000, 7).alias("zip_code"),
        nation.cast("smallint").alias("prefecture_id"),
        pad(nation * 1000, 5).alias("city_id"),
        prefecture_label(nation).alias("prefecture"),
        F.lit("SUPPLIER").alias("city"),
        F.col("s_name").alias("town"),
    )
    return stay.unionByName(new)


NEXT_SQL = f"""{ADDR_SQL},
next_addr AS (
  SELECT zip_code, prefecture_id, CASE WHEN c_acctbal < 0 THEN '99999' ELSE city_id END AS city_id,
         prefecture, city, town
  FROM addr_all WHERE c_custkey IN (SELECT o_custkey FROM orders)
  UNION ALL
  SELECT lpad(CAST(s_suppkey + 9000000 AS VARCHAR), 7, '0'), CAST(s_nationkey + 1 AS INTEGER),
         lpad(CAST((s_nationkey + 1) * 1000 AS VARCHAR), 5, '0'),
         ({_LABEL_LIST})[s_nationkey + 1], 'SUPPLIER', s_name
  FROM supplier
)"""

# ---- requests ------------------------------------------------------------------------


def zip_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order: most hit, some miss, some are malformed."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    digits = pad(F.expr("o_custkey div 3"), 7)
    written = F.concat(
        F.lit("〒"), F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 4)
    )
    zip_input = (
        F.when(key % 10 == 0, "12")
        .when(key % 10 == 1, pad(customer + 8_000_000, 7))
        .otherwise(written)
    )
    return table(spark, sf_dir, "orders").select(key.alias("request_id"), zip_input.alias("zip"))


ZIP_REQUESTS_SQL = """
zip_req AS (
  SELECT o_orderkey AS request_id,
         CASE WHEN o_orderkey % 10 = 0 THEN '12'
              WHEN o_orderkey % 10 = 1 THEN lpad(CAST(o_custkey + 8000000 AS VARCHAR), 7, '0')
              ELSE '〒' || substr(lpad(CAST(o_custkey // 3 AS VARCHAR), 7, '0'), 1, 3) || '-'
                   || substr(lpad(CAST(o_custkey // 3 AS VARCHAR), 7, '0'), 4, 4) END AS zip
  FROM orders
),
zip_norm AS (
  SELECT request_id, zip, substr(regexp_replace(zip, '[^0-9]', '', 'g'), 1, 7) AS z FROM zip_req
)"""


def _keyword_cases(mode: str) -> tuple[str, str, str]:
    """Which part of the nine kana digits a request in this mode spells: Spark and SQL agree
    on ``substr``."""
    return {
        "exact": ("1", "9", "丁"),
        "prefix": ("1", "7", "丁"),
        "partial": ("5", "4", ""),
    }[mode]


def _keyword_sql(mode: str) -> str:
    """The keyword of each order, valid in Spark and DuckDB alike: a town in katakana,
    hiragana or half-width kana with blanks, a prefecture, a city, a wildcard, nothing."""
    start, size, head = _keyword_cases(mode)
    digits = f"substr(lpad(CAST(o_custkey AS VARCHAR(20)), 9, '0'), {start}, {size})"
    label = "CASE o_custkey % 5 " + " ".join(
        f"WHEN {i} THEN '{x}'" for i, x in enumerate(("北海道", "青森", "県", "東京都", "京"))
    )
    return f"""CASE o_orderkey % 8
        WHEN 0 THEN concat('{head}', translate({digits}, '{DIGITS}', '{KANA_DIGITS}'))
        WHEN 1 THEN concat('{head}', translate({digits}, '{DIGITS}', '{HIRA_DIGITS}'))
        WHEN 2 THEN concat(' {head}　', translate({digits}, '{DIGITS}', '{HALF_KANA_DIGITS}'), ' ')
        WHEN 3 THEN {label} END
        WHEN 4 THEN concat('BUILDING-', CAST(o_custkey % 40 AS VARCHAR(20)))
        WHEN 5 THEN concat('丁', '_', '%', translate(CAST(o_custkey % 100 AS VARCHAR(20)), '{DIGITS}', '{KANA_DIGITS}'))
        WHEN 6 THEN ' 　'
        ELSE concat('none', CAST(o_custkey AS VARCHAR(20))) END"""


_LIMIT_SQL = """CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 3 WHEN 2 THEN 1000
                WHEN 3 THEN 0 ELSE 10 END"""


def search_requests(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """One search per order, all in one mode."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.expr(_keyword_sql(mode)).alias("address"),
        F.lit(mode).alias("mode"),
        F.expr(_LIMIT_SQL).cast("int").alias("limit"),
    )


def search_sql(mode: str) -> str:
    """The same searches, one LIKE at a time."""
    pattern = {"exact": "t", "prefix": "t || '%'", "partial": "'%' || t || '%'"}[mode]
    test = "= t" if mode == "exact" else f"LIKE {pattern}"
    return f"""WITH {ADDR_SQL},
req AS (
  SELECT o_orderkey AS request_id, {_keyword_sql(mode)} AS address, {_LIMIT_SQL} AS lim FROM orders
),
norm AS (
  SELECT request_id,
         regexp_replace(translate(address, '{HALF_KANA_DIGITS}', '{KANA_DIGITS}'), '[ 　]', '', 'g') AS word,
         greatest(1, least(200, coalesce(lim, 50))) AS lim
  FROM req
),
words AS (SELECT DISTINCT word FROM norm WHERE word <> ''),
cand AS (
  SELECT word, 0 AS r, word AS t FROM words
  UNION ALL SELECT word, 1, translate(word, '{S.HIRAGANA}', '{S.KATAKANA}') FROM words
  UNION ALL SELECT word, 2, translate(word, '{S.KATAKANA}', '{S.HIRAGANA}') FROM words
),
hit AS (
  SELECT word, min(r) AS r, zip_code, prefecture_id, city_id, prefecture, city, town
  FROM cand JOIN addr ON prefecture {test} OR city {test} OR town {test}
  GROUP BY ALL
),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY word ORDER BY r, zip_code, prefecture_id, city_id, city, town, prefecture
  ) AS position FROM hit
)
SELECT request_id, CAST(position AS INTEGER) AS position, zip_code, prefecture_id, city_id,
       prefecture, city, town
FROM norm JOIN ranked USING (word) WHERE position <= lim"""


def _span_sql() -> str:
    """Keywords that run from the city's end into the town."""
    digits = "substr(lpad(CAST(o_custkey AS VARCHAR(20)), 9, '0'), 1, 9)"
    return f"""CASE o_orderkey % 4
        WHEN 0 THEN concat('-', CAST(o_custkey % 40 AS VARCHAR(20)), ' 丁', translate({digits}, '{DIGITS}', '{KANA_DIGITS}'))
        WHEN 1 THEN concat('県', 'HOUSEHOLD', '-', CAST(o_custkey % 40 AS VARCHAR(20)), '丁')
        WHEN 2 THEN '%' ELSE ' ' END"""


def span_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.expr(_span_sql()).alias("address"),
        F.expr(_LIMIT_SQL).cast("int").alias("limit"),
    )


SPAN_SQL = f"""WITH {ADDR_SQL},
norm AS (
  SELECT o_orderkey AS request_id, replace({_span_sql()}, ' ', '') AS word,
         greatest(1, least(200, coalesce({_LIMIT_SQL}, 50))) AS lim
  FROM orders
),
hit AS (
  SELECT word, addr.* FROM (SELECT DISTINCT word FROM norm WHERE word <> '') w
  JOIN addr ON contains(prefecture || city || town, word)
),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY word ORDER BY zip_code, prefecture_id, city_id, city, town, prefecture
  ) AS position FROM hit
)
SELECT request_id, CAST(position AS INTEGER) AS position, zip_code, prefecture_id, city_id,
       prefecture, city, town
FROM norm JOIN ranked USING (word) WHERE position <= lim"""

# ---- feeds ---------------------------------------------------------------------------


def lineitem_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_returnflag",
        F.lit("lineitem").alias("feed_file"),
        pad(F.expr("l_orderkey div 2"), 7).alias("zip_code"),
        pad(F.col("l_suppkey") % 3, 5).alias("city_id"),
        F.concat(F.lit("T"), _text(F.col("l_partkey") % 5)).alias("town"),
        (F.col("l_returnflag") == "R").alias("flag"),
    )


LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
LINEITEM_FEED_SQL = f"""
feed AS (
  SELECT row_number() OVER (ORDER BY {", ".join(LINEITEM_ORDER)}) AS line_no,
         lpad(CAST(l_orderkey // 2 AS VARCHAR), 7, '0') AS zip_code,
         lpad(CAST(l_suppkey % 3 AS VARCHAR), 5, '0') AS city_id,
         'T' || CAST(l_partkey % 5 AS VARCHAR) AS town, l_returnflag = 'R' AS flag
  FROM lineitem
)"""

# Order rows as feed fields, valid in Spark and DuckDB alike.
FEED_TOWN = (
    "CASE WHEN o_orderpriority = '3-MEDIUM' THEN '以下に掲載がない場合' "
    "WHEN o_orderpriority = '5-LOW' THEN concat('町（', CAST(o_custkey % 10 AS VARCHAR(20)), '（内）外）ー') "
    "WHEN o_orderpriority = '2-HIGH' THEN '続き）' WHEN o_orderpriority = '1-URGENT' THEN '丘（未' ELSE concat('字', translate("
    "CAST(o_custkey % 100 AS VARCHAR(20)), '0123456789', '０１２３４５６７８９'), '、') END"
)
FEED_PREF = "CASE o_custkey % 4 WHEN 0 THEN '北海道' WHEN 1 THEN '東京都' WHEN 2 THEN '大阪府' ELSE '不明（県）' END"
FEED_FLAG = "CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END"
FEED_BAD = "o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'"
FEED_ZIP = "lpad(CAST({div} AS VARCHAR(20)), 7, '0')"


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines of a feed with one line per order, some of them malformed; ``zip_code``
    and ``o_orderkey`` give the order to write them in."""
    zip_code = FEED_ZIP.format(div="o_custkey div 3")
    line = f"""CASE WHEN {FEED_BAD} THEN concat('broken,', zip_code) ELSE concat_ws(',',
        lpad(CAST(o_custkey % 3 AS STRING), 5, '0'), '', zip_code, '', '', '', {FEED_PREF},
        concat('"市ー', o_orderstatus, '"'), {FEED_TOWN}, '', '', '', {FEED_FLAG}, '', '') END"""
    orders = table(spark, sf_dir, "orders").withColumn("zip_code", F.expr(zip_code))
    return orders.select("zip_code", "o_orderkey", F.expr(line).alias("line"))


def feed_files_sql(merge_before_strip: bool) -> str:
    """The cleaned feed.  Towns are nested at most three deep here, so a few replacements
    strip them."""

    def stripped(c: str) -> str:
        for _ in range(4):
            c = f"regexp_replace({c}, '\\([^()]*\\)', '', 'g')"
        c = f"replace(regexp_replace({c}, '\\(.*', ''), ')', '')"
        return f"CASE {c} WHEN '{S.UNLISTED_TOWN}' THEN '' ELSE {c} END"

    early, late = ("t0", stripped("town")) if merge_before_strip else (stripped("t0"), "town")
    return f"""WITH
raw AS (
  SELECT o_orderkey, {FEED_ZIP.format(div="o_custkey // 3")} AS zip_code,
         lpad(CAST(o_custkey % 3 AS VARCHAR), 5, '0') AS city_id,
         translate({FEED_PREF}, '{S.WIDE_CHARS}', '{S.NARROW_CHARS}') AS prefecture,
         translate('市ー' || o_orderstatus, '{S.WIDE_CHARS}', '{S.NARROW_CHARS}') AS city,
         translate({FEED_TOWN}, '{S.WIDE_CHARS}', '{S.NARROW_CHARS}') AS t0,
         {FEED_FLAG} = '1' AS flag
  FROM orders WHERE NOT ({FEED_BAD})
),
clean AS (
  SELECT row_number() OVER (ORDER BY zip_code, o_orderkey) AS n, zip_code, city_id, prefecture, city, flag,
         CASE prefecture WHEN '北海道' THEN 1 WHEN '東京都' THEN 13 WHEN '大阪府' THEN 27 ELSE 0 END AS prefecture_id,
         {early} AS town
  FROM raw
),
marked AS (
  SELECT *, CASE WHEN lag(zip_code) OVER w = zip_code AND lag(city_id) OVER w = city_id
                  AND NOT lag(flag) OVER w AND NOT flag THEN 0 ELSE 1 END AS b
  FROM clean WINDOW w AS (ORDER BY n)
),
runs AS (SELECT *, sum(b) OVER (ORDER BY n) AS run FROM marked),
merged AS (
  SELECT min(n) AS n, zip_code, city_id, arg_min(prefecture_id, n) AS prefecture_id,
         arg_min(prefecture, n) AS prefecture, arg_min(city, n) AS city, string_agg(town, '' ORDER BY n) AS town
  FROM runs GROUP BY run, zip_code, city_id
),
final AS (SELECT n, zip_code, prefecture_id, city_id, prefecture, city, {late} AS town FROM merged)
SELECT zip_code, prefecture_id, city_id, prefecture, city, town FROM final
QUALIFY row_number() OVER (PARTITION BY zip_code, prefecture_id, city, town ORDER BY n) = 1"""


# ---- logs ----------------------------------------------------------------------------

LOG_STATUS = "CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END"
_PATH = (
    "CASE event_type WHEN 'click' THEN '/ready' "
    "ELSE concat('/postal_codes/', CAST(user_id AS VARCHAR(20))) END"
)


def request_log(events: DataFrame) -> DataFrame:
    """Events as request-log records; works on streams too."""
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "user_id",
        F.lit("GET").alias("method"),
        F.expr(_PATH).alias("path"),
        F.expr(LOG_STATUS).alias("status"),
        F.floor(F.col("value") * 10).cast("long").alias("latency_ms"),
    )


LOG_SQL = f"""
log AS (
  SELECT event_id, ts, event_type, user_id, 'GET' AS method, {_PATH} AS path, {LOG_STATUS} AS status,
         CAST(floor(value * 10) AS BIGINT) AS latency_ms FROM events
)"""


#: A quarter of the orders are readiness probes.
_ORDER_PATH = "CASE WHEN o_custkey % 4 = 0 THEN '/ready' ELSE '/postal_codes/1000001' END"


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as request-log records, which cover many months."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.lit("GET").alias("method"),
        F.expr(_ORDER_PATH).alias("path"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'P' THEN 404 ELSE 500 END").alias("status"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("latency_ms"),
    )


ORDER_LOG_SQL = f"""
log AS (
  SELECT o_orderdate AS ts, {_ORDER_PATH} AS path,
         CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'P' THEN 404 ELSE 500 END AS status,
         CAST(floor(o_totalprice / 1000) AS BIGINT) AS latency_ms FROM orders
)"""


#: Times at which the freshness of the update runs is asked.
FRESHNESS_AT = [
    "1996-03-10 05:00:00",
    "1997-11-02 13:30:00",
    "1999-05-05 12:00:00",
    "1998-12-31 00:00:00",
    "2024-01-31 00:00:00",
]


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One update run per day with orders; days with few orders failed."""
    day = F.date_trunc("day", F.col("o_orderdate").cast("timestamp"))
    n = F.count(F.lit(1))
    return (
        table(spark, sf_dir, "orders")
        .groupBy(day.alias("run_finished_at"))
        .agg(
            n.alias("total_count"),
            F.when(F.count_if(F.col("o_orderstatus") == "F") > 0, "success").otherwise("failed").alias("status"),
        )
        .select(
            F.date_format("run_finished_at", "'v'yyyyMMdd").alias("data_version"),
            F.col("run_finished_at").alias("run_started_at"),
            "run_finished_at",
            F.col("run_finished_at").alias("created_at"),
            F.lit("orders").alias("source_url"),
            "total_count",
            "status",
        )
    )


ORDER_RUNS_SQL = """
runs AS (
  SELECT date_trunc('day', o_orderdate) AS run_finished_at, count(*) AS total_count,
         CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'success' ELSE 'failed' END AS status
  FROM orders GROUP BY 1
)"""
