"""Zip lookups for whole tables of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake import schema as S
from postlake.functions import text
from postlake.operators.skew import lookup_join


def _records(addresses: DataFrame) -> DataFrame:
    return addresses.select(
        *[F.coalesce("town", F.lit("")).alias(c) if c == "town" else c for c in S.ADDRESS_COLUMNS]
    )


def lookup_zip_one(addresses: DataFrame, zip_input: str) -> DataFrame:
    """All records of one zip; the equality reaches the Parquet scan."""
    zip_code = "".join(ch for ch in zip_input if ch in "0123456789")[:7]
    return _records(addresses).filter(F.col("zip_code") == zip_code)


def lookup_zip(
    requests: DataFrame,
    addresses: DataFrame,
    zip_col: str = "zip",
    fold_width: bool = False,
    **join: int,
) -> DataFrame:
    """Every request with every record of its zip.

    ``status`` is ``ok``, ``not_found`` or ``invalid``.  Invalid zips get a null key, so
    they never probe the table; an unknown zip keeps one row with null address columns.
    """
    records = _records(addresses)
    wanted = text.normalize_zip(F.col(zip_col), fold_width)
    asked = requests.withColumn("zip_code", F.when(text.is_valid_zip(wanted), wanted))
    out = lookup_join(
        asked, records.withColumn("_hit", F.lit(True)), ["zip_code"], "left", **join
    )
    status = (
        F.when(F.col("zip_code").isNull(), "invalid")
        .when(F.col("_hit").isNull(), "not_found")
        .otherwise("ok")
    )
    return out.withColumn("status", status).select(
        *requests.columns, "status", *S.ADDRESS_COLUMNS
    )


def first_per_zip(addresses: DataFrame) -> DataFrame:
    """One row per zip: the first record by (city_id, town) and the number of records.

    A plain aggregate, so a zip holding many records is combined before the shuffle.
    """
    payload = ["city_id", "town", "city", "prefecture_id", "prefecture"]
    return (
        _records(addresses)
        .groupBy("zip_code")
        .agg(
            F.count(F.lit(1)).alias("candidate_count"),
            F.min(F.struct(*payload)).alias("_first"),
        )
        .select("zip_code", "candidate_count", *[F.col(f"_first.{c}") for c in payload])
    )


def enrich_addresses(
    rows: DataFrame,
    addresses: DataFrame,
    zip_col: str = "zip_code",
    targets: dict[str, str] | None = None,
    **join: int,
) -> DataFrame:
    """Fill a table's address columns from its zip.

    On a hit the first record's zip, prefecture, city and town replace the row's values;
    on a miss the row stays as it is.  ``targets`` names the row's columns where they
    differ from ``prefecture``/``city``/``town``; missing ones are added.
    """
    names = {"prefecture": "prefecture", "city": "city", "town": "town", **(targets or {})}
    first = first_per_zip(addresses).select(
        F.col("zip_code").alias("_zip"),
        F.col("candidate_count").alias("_count"),
        *[F.col(c).alias(f"_{c}") for c in names],
    )
    wanted = text.normalize_zip(F.col(zip_col))
    keyed = rows.withColumn("_zip", F.when(text.is_valid_zip(wanted), wanted))
    out = lookup_join(keyed, first, ["_zip"], "left", bound=addresses, **join)
    hit = F.col("_count").isNotNull()
    filled = {zip_col: F.when(hit, F.col("_zip")).otherwise(F.col(zip_col))}
    for source, target in names.items():
        before = F.col(target) if target in rows.columns else F.lit(None).cast("string")
        filled[target] = F.when(hit, F.col(f"_{source}")).otherwise(before)
    filled["candidate_count"] = F.coalesce("_count", F.lit(0))
    filled["status"] = (
        F.when(F.col("_zip").isNull(), "invalid").when(hit, "ok").otherwise("not_found")
    )
    kept = [c for c in rows.columns if c not in filled]
    return out.select(*kept, *[v.alias(k) for k, v in filled.items()])


def zip_city_options(
    requests: DataFrame, addresses: DataFrame, zip_col: str = "zip", **join: int
) -> DataFrame:
    """The city choices of each request's prefecture, one row per choice, with the city of
    the looked-up record marked ``selected``.  Requests without a hit yield no row."""
    first = first_per_zip(addresses).select(
        "zip_code", "prefecture_id", F.col("city_id").alias("_city_id")
    )
    wanted = text.normalize_zip(F.col(zip_col))
    asked = requests.withColumn("zip_code", F.when(text.is_valid_zip(wanted), wanted)).filter(
        F.col("zip_code").isNotNull()
    )
    found = lookup_join(asked, first, ["zip_code"], "inner", bound=addresses, **join)
    options = addresses.select("prefecture_id", "city_id", "city").distinct()
    return lookup_join(
        found, options, ["prefecture_id"], "inner", bound=addresses, **join
    ).select(
        *requests.columns,
        "prefecture_id",
        "city_id",
        "city",
        (F.col("city_id") == F.col("_city_id")).alias("selected"),
    )
