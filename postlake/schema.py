"""Table schemas and the fixed values the rules refer to."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


_S, _TS, _L, _I, _H = (
    T.StringType(),
    T.TimestampType(),
    T.LongType(),
    T.IntegerType(),
    T.ShortType(),
)

ADDRESS = _struct(
    ("zip_code", _S, False),
    ("prefecture_id", _H, False),
    ("city_id", _S, False),
    ("prefecture", _S, False),
    ("city", _S, False),
    ("town", _S, False),
)
ADDRESS_COLUMNS = ADDRESS.fieldNames()
ADDRESS_KEY = ["zip_code", "prefecture_id", "city", "town"]
# One total order for every "first record" / "first n records" rule.
ADDRESS_ORDER = ["zip_code", "prefecture_id", "city_id", "city", "town", "prefecture"]

ADDRESS_VERSIONED = T.StructType(
    ADDRESS.fields
    + [T.StructField("created_at", _TS, False), T.StructField("updated_at", _TS, False)]
)

AUDIT = _struct(
    ("data_version", _S, False),
    ("content_version", _S, True),
    ("source_url", _S, False),
    ("run_started_at", _TS, False),
    ("run_finished_at", _TS, False),
    ("batch_timestamp", _TS, False),
    ("records_in_feed", _L, False),
    ("inserted_count", _L, False),
    ("updated_count", _L, False),
    ("deleted_count", _L, False),
    ("total_count", _L, False),
    ("status", _S, False),
    ("error_message", _S, True),
    ("created_at", _TS, False),
)

# What a publish refused: address rows, or malformed lines of a feed file.
QUARANTINE = T.StructType(
    [T.StructField(n, _S, True) for n in ("kind", "feed_file", "line")]
    + [T.StructField(f.name, f.dataType, True) for f in ADDRESS.fields]
    + [T.StructField("broken_rules", T.ArrayType(_S), True), T.StructField("rows", _L, True)]
)

# A feed line has 15 positional fields unless told otherwise; the last column keeps unparsable lines.
FEED_WIDTH = 15
CORRUPT = "_corrupt_record"


def feed_line(width: int = FEED_WIDTH) -> T.StructType:
    fields = [T.StructField(f"_c{i}", _S, True) for i in range(width)]
    return T.StructType([*fields, T.StructField(CORRUPT, _S, True)])


# Positions of the feed fields that are used.
FEED_FIELDS = {
    "city_id": 0,
    "zip_code": 2,
    "prefecture": 6,
    "city": 7,
    "town": 8,
    "flag": 12,
}

SEARCH_REQUEST = _struct(
    ("request_id", _L, False), ("address", _S, True), ("mode", _S, True), ("limit", _I, True)
)
ZIP_REQUEST = _struct(("request_id", _L, False), ("zip", _S, True))

# Payload of one request-log line; the collector adds the event time ``ts``.
REQUEST_EVENT = _struct(
    ("event", _S, True),
    ("method", _S, True),
    ("path", _S, True),
    ("status", _I, True),
    ("latency_ms", _L, True),
)

# ---- fixed values -------------------------------------------------------------------

# Full-width characters of the feed and what they are stored as.
WIDE_CHARS = "（）ー、０１２３４５６７８９"
NARROW_CHARS = "()-,0123456789"

# Town text that means "no town listed".
UNLISTED_TOWN = "以下に掲載がない場合"

# Kana blocks: hiragana U+3041..U+3096 and katakana U+30A1..U+30F6, 0x60 apart.
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))

# Prefecture labels by id; id 0 is the placeholder entry.
PREFECTURES = [
    "都道府県を選択",
    "北海道", "青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県",
    "茨城県", "栃木県", "群馬県", "埼玉県", "千葉県", "東京都", "神奈川県",
    "新潟県", "富山県", "石川県", "福井県", "山梨県", "長野県",
    "岐阜県", "静岡県", "愛知県", "三重県",
    "滋賀県", "京都府", "大阪府", "兵庫県", "奈良県", "和歌山県",
    "鳥取県", "島根県", "岡山県", "広島県", "山口県",
    "徳島県", "香川県", "愛媛県", "高知県",
    "福岡県", "佐賀県", "長崎県", "熊本県", "大分県", "宮崎県", "鹿児島県", "沖縄県",
]

# Result limits of a search request.
SEARCH_LIMIT_DEFAULT, SEARCH_LIMIT_MAX = 50, 200
SEARCH_MODES = ("exact", "prefix", "partial")

# Column length limits of the address table.
ADDRESS_LENGTHS = {"city_id": 10, "prefecture": 32, "city": 50, "town": 500}

# Service levels.
SLO_AVAILABILITY = 0.999
SLO_ERROR_RATE = 0.01
SLO_P95_MS = 300
SLO_FRESHNESS_HOURS = 24
P1_ERROR_RATE = 0.03
P2_ERROR_RATE = 0.01
P3_FRESHNESS_HOURS = 12
READY_BREACH_MINUTES = 10
LATENCY_BREACH_MINUTES = 15
BUDGET_FREEZE_RATIO = 0.5
BUDGET_STOP_RATIO = 0.8

# Paths that need no login unless told otherwise.
ANONYMOUS_PATHS = "/health,/ready,/openapi.json,/docs"
