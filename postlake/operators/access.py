"""Which requests an address allowlist and the login rule would let through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import schema as S
from postlake.functions import network as N
from postlake.functions.text import trim_unicode
from postlake.operators.skew import lookup_join
from postlake.session import materialise


def match_networks(
    requests: DataFrame, networks: DataFrame, ip_col: str = "ip", **join: int
) -> DataFrame:
    """Add ``allowed``: whether the address lies in any network of a table of rules.

    ``networks`` has a ``cidr`` column.  Each distinct address is cut to every prefix
    length that occurs (there are at most 162) and looked up by equality, so no range join
    is needed and an address asking often is matched once.
    """
    rules = networks.select("cidr", N.network_bits(trim_unicode(F.col("cidr"))).alias("bits"))
    width = F.when(F.col("cidr").contains(":"), 128).otherwise(32)
    facts = rules.agg(
        F.first(F.when(F.col("bits").isNull(), F.col("cidr")), ignorenulls=True).alias("bad"),
        F.sort_array(F.collect_set(F.struct(width.alias("width"), F.length("bits").alias("n")))).alias(
            "sizes"
        ),
    ).first()
    if facts.bad is not None:
        raise ValueError(f"invalid network rule: {facts.bad}")
    if not facts.sizes:
        raise ValueError("the network list is empty")

    prefixes = rules.select(width.alias("width"), "bits").distinct()
    sizes = F.array(*[F.struct(F.lit(s.width).alias("w"), F.lit(s.n).alias("n")) for s in facts.sizes])
    bits = N.ip_bits(F.col(ip_col))
    cuts = (
        requests.select(ip_col)
        .distinct()
        .select(ip_col, bits.alias("_bits"))
        # The outer form keeps Spark from testing the bits before the distinct.
        .withColumn("_s", F.explode_outer(F.filter(sizes, lambda s: s["w"] == F.length("_bits"))))
        .filter(F.col("_s").isNotNull())
        .select(
            ip_col,
            F.col("_s.w").alias("width"),
            F.substring("_bits", F.lit(1), F.col("_s.n")).alias("bits"),
        )
    )
    matched = (
        lookup_join(cuts, prefixes, ["width", "bits"], "left_semi", **join)
        .select(ip_col)
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    matched = materialise(matched, "networks")
    out = lookup_join(requests, matched, [ip_col], "left", **join)
    return out.withColumn("allowed", F.col("_hit").isNotNull()).select(*requests.columns, "allowed")


def access_audit(
    requests: DataFrame,
    networks: list[N.Network] | None = None,
    trust_proxy_headers: bool = False,
    login_required: bool = False,
    anonymous_paths: str = S.ANONYMOUS_PATHS,
) -> DataFrame:
    """Add ``client_ip`` and ``outcome``: 403 outside the allowlist, then 401 without a
    user on a path that needs one, else 200.  No list allows every address.

    Reads columns ``ip``, ``forwarded_for``, ``real_ip``, ``path`` and ``user``.
    """
    ip = N.client_ip(F.col("forwarded_for"), F.col("real_ip"), F.col("ip"), trust_proxy_headers)
    known: Column = F.lit(True)
    if networks is not None:
        known = N.in_networks(F.col("_bits"), networks)
    named = F.coalesce(trim_unicode(F.col("user")), F.lit("")) != ""
    free = N.path_matches(F.col("path"), N.path_prefixes(F.lit(anonymous_paths)))
    may = F.lit(not login_required) | free | named
    outcome = F.when(~known, 403).when(~F.coalesce(may, F.lit(False)), 401).otherwise(200)
    return (
        requests.withColumn("client_ip", ip)
        .withColumn("_bits", N.ip_bits(F.col("client_ip")))
        .withColumn("outcome", outcome)
        .drop("_bits")
    )


def access_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy("outcome").agg(F.count(F.lit(1)).alias("requests"))
