"""IP addresses, networks and request paths as Column expressions.

An address becomes its bits as text (32 or 128 characters), so that lying in a network is
having the same first characters.
"""

from __future__ import annotations

import ipaddress
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.bind import let
from postlake.functions.text import trim_unicode

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"


def _v4_bits(c: Column) -> Column:
    octets = F.split(c, r"\.")
    value = F.lit(0).cast("long")
    for i in range(4):
        value = value * 256 + F.get(octets, F.lit(i)).try_cast("long")
    return F.lpad(F.conv(value.cast("string"), 10, 2), 32, "0")


def _dotted_tail_as_hex(c: Column) -> Column:
    """Rewrite an IPv4 tail of an IPv6 address as its two groups."""

    def rewritten(tail: Column) -> Column:
        def group(start: int) -> Column:
            return F.conv(F.substring(tail, start, 16), 2, 16)

        return F.concat(
            F.regexp_replace(c, f"{_V4}$", ""), group(1), F.lit(":"), group(17)
        )

    tail = _v4_bits(F.regexp_extract(c, f":({_V4})$", 1))
    return F.when(c.rlike(f":{_V4}$"), let(tail, rewritten)).otherwise(c)


def _v6_bits(c: Column) -> Column:
    """Null unless ``c`` is an IPv6 address; an IPv4 tail and one ``::`` are allowed."""

    def groups(half: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.when(F.coalesce(half, F.lit("")) == "", none).otherwise(F.split(half, ":"))

    def both_sides(halves: Column) -> Column:
        return F.struct(
            F.size(halves).alias("halves"),
            groups(F.get(halves, F.lit(0))).alias("left"),
            groups(F.get(halves, F.lit(1))).alias("right"),
        )

    def bits(a: Column) -> Column:
        left, right = a["left"], a["right"]
        count = F.size(left) + F.size(right)
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - count, F.lit(0)))
        valid = (((a["halves"] == 2) & (count <= 7)) | ((a["halves"] == 1) & (count == 8))) & F.forall(
            F.concat(left, right), lambda g: g.rlike("^[0-9a-fA-F]{1,4}$")
        )
        full = F.concat(left, zeros, right)
        return F.when(
            valid, F.array_join(F.transform(full, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
        )

    halves = F.split(_dotted_tail_as_hex(c), "::")
    return let(let(halves, both_sides), bits)


def ip_bits(c: Column) -> Column:
    """Bits of an IPv4 or IPv6 address, null if it is neither."""
    return F.when(c.rlike(f"^{_V4}$"), _v4_bits(c)).when(c.contains(":"), _v6_bits(c))


def network_bits(cidr: Column) -> Column:
    """Bits a CIDR rule fixes; a bare address fixes all; null if the rule is invalid."""
    parts = F.split(cidr, "/")
    size = F.get(parts, F.lit(1))
    length = F.when(size.rlike("^[0-9]{1,3}$"), size.try_cast("int"))

    def fixed(bits: Column) -> Column:
        return F.when(F.size(parts) == 1, bits).when(
            (F.size(parts) == 2) & (length <= F.length(bits)), F.substring(bits, F.lit(1), length)
        )

    return let(ip_bits(F.get(parts, F.lit(0))), fixed)


def is_ip(c: Column) -> Column:
    v6 = F.when(c.contains(":"), _v6_bits(c).isNotNull()).otherwise(False)
    return F.coalesce(c.rlike(f"^{_V4}$") | v6, F.lit(False))


class Network(NamedTuple):
    width: int
    bits: str


def parse_networks(rules: str) -> list[Network]:
    """Rules of a comma-separated allowlist; an empty or invalid list is an error."""
    networks = []
    for rule in (r.strip() for r in rules.split(",")):
        if not rule:
            continue
        _, slash, size = rule.partition("/")
        if "%" in rule or (slash and not (size.isascii() and size.isdigit())):
            raise ValueError(f"invalid network rule: {rule}")
        try:
            net = ipaddress.ip_network(rule, strict=False)
        except ValueError as e:
            raise ValueError(f"invalid network rule: {rule}") from e
        width = net.max_prefixlen
        networks.append(Network(width, f"{int(net.network_address):0{width}b}"[: net.prefixlen]))
    if not networks:
        raise ValueError("the network list is empty")
    return networks


def in_networks(bits: Column, networks: list[Network]) -> Column:
    """Whether an address, given as its bits, lies in any network of a configured list.

    A hash-set test per distinct prefix length: no join, no shuffle.
    """
    by_size: dict[tuple[int, int], set[str]] = defaultdict(set)
    for net in networks:
        by_size[net.width, len(net.bits)].add(net.bits)
    hit = F.lit(False)
    for (width, size), prefixes in sorted(by_size.items()):
        same = F.substring(bits, 1, size).isin(*sorted(prefixes))
        hit = hit | ((F.length(bits) == width) & same)
    return F.coalesce(hit, F.lit(False))


def ip_allowed(ip: Column, networks: list[Network]) -> Column:
    return let(ip_bits(ip), lambda bits: in_networks(bits, networks))


def client_ip(
    forwarded_for: Column, real_ip: Column, peer: Column, trust_proxy_headers: bool
) -> Column:
    """The first forwarded address, else the real-ip header, else the peer.  Headers count
    only if proxies are trusted, and only if they hold an address."""
    if not trust_proxy_headers:
        return peer

    def address(c: Column) -> Column:
        trimmed = trim_unicode(c)
        return F.when(is_ip(trimmed), trimmed)

    first = F.get(F.split(forwarded_for, ","), F.lit(0))
    return F.coalesce(address(first), address(real_ip), peer)


def path_prefixes(rules: Column) -> Column:
    """Unique prefixes of a comma-separated list, each with a leading slash."""
    entries = F.filter(F.transform(F.split(rules, ","), trim_unicode), lambda e: e != "")
    slashed = F.transform(
        entries, lambda e: F.when(e.startswith("/"), e).otherwise(F.concat(F.lit("/"), e))
    )
    return F.array_distinct(slashed)


def path_matches(path: Column, prefixes: Column) -> Column:
    """Whether a path equals a prefix or lies below it; ``/`` covers everything."""
    return F.exists(
        prefixes,
        lambda p: (p == "/") | (path == p) | path.startswith(F.concat(p, F.lit("/"))),
    )
