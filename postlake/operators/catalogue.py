"""Prefecture and city lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefectures(addresses: DataFrame) -> DataFrame:
    return addresses.select("prefecture_id", "prefecture").distinct().orderBy("prefecture_id")


def cities(
    addresses: DataFrame,
    prefecture_id: int | None = None,
    prefecture_ids: DataFrame | None = None,
) -> DataFrame:
    """Distinct cities: of one prefecture, of each prefecture in ``prefecture_ids``, or of
    all.  The batch forms keep ``prefecture_id``."""
    if prefecture_id is not None:
        return (
            addresses.filter(F.col("prefecture_id") == prefecture_id)
            .select("city_id", "city")
            .distinct()
            .orderBy("city_id", "city")
        )
    rows = addresses.select("prefecture_id", "city_id", "city").distinct()
    if prefecture_ids is not None:
        rows = rows.join(
            prefecture_ids.select("prefecture_id").distinct(), "prefecture_id", "left_semi"
        )
    return rows.orderBy("prefecture_id", "city_id", "city")
