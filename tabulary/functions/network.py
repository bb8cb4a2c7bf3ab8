"""IP address expressions: client address, quota key, log prefix, loopback test."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: one decimal octet without leading zeros, and a dotted quad of them.
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"

INVALID_PREFIX = "_invalid"
UNKNOWN_KEY = "_unknown"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is_v4(ip: Column) -> Column:
    return F.rlike(ip, F.lit(rf"^{_QUAD}\z"))


def _unmixed(ip: Column) -> Column:
    """An IPv6 text whose last part is a dotted quad, with that part as two groups."""
    tail = rf":{_QUAD}\z"

    def octet(n: int) -> Column:
        return F.regexp_extract(ip, tail, n).cast("int")

    mixed = F.concat(
        F.regexp_replace(ip, rf"{_QUAD}\z", ""),
        F.hex(octet(1) * 256 + octet(2)),
        F.lit(":"),
        F.hex(octet(3) * 256 + octet(4)),
    )
    return F.when(F.rlike(ip, F.lit(tail)), mixed).otherwise(ip)


def _v6_groups(ip: Column) -> Column:
    """The eight lower-case groups of an IPv6 address, or null if it is not one."""

    def groups(half: Column) -> Column:
        empty = F.array().cast("array<string>")
        return F.when(F.coalesce(half, F.lit("")) == "", empty).otherwise(F.split(half, ":", -1))

    def is_group(g: Column) -> Column:
        return F.rlike(g, F.lit(r"^[0-9A-Fa-f]{1,4}\z"))

    def spread(sides: Column) -> Column:
        left, right = sides["left"], sides["right"]
        count = F.size(left) + F.size(right)
        fits = F.when(sides["gaps"] == 0, count == 8).otherwise(
            (sides["gaps"] == 1) & (count <= 7)
        )
        padded = F.concat(left, F.array_repeat(F.lit("0"), 8 - count), right)
        return F.when(
            fits & F.forall(left, is_group) & F.forall(right, is_group),
            F.transform(padded, lambda g: F.lower(F.regexp_replace(g, "^0+(?=.)", ""))),
        )

    def sides(halves: Column) -> Column:
        return F.struct(
            groups(F.get(halves, F.lit(0))).alias("left"),
            groups(F.get(halves, F.lit(1))).alias("right"),
            (F.size(halves) - 1).alias("gaps"),
        )

    body = _unmixed(F.regexp_replace(ip, r"%[^%]+\z", ""))
    return _let(_let(F.split(body, "::", -1), sides), spread)


def _v6_prefix(groups: Column) -> Column:
    """Canonical text of the /48 network: the zero tail is always the compressed run."""

    def g(i: int) -> Column:
        return F.get(groups, F.lit(i))

    return (
        F.when(g(2) != "0", F.concat(g(0), F.lit(":"), g(1), F.lit(":"), g(2), F.lit("::")))
        .when(g(1) != "0", F.concat(g(0), F.lit(":"), g(1), F.lit("::")))
        .when(g(0) != "0", F.concat(g(0), F.lit("::")))
        .when(groups.isNotNull(), F.lit("::"))
    )


def ip_prefix(ip: Column) -> Column:
    """First three octets (IPv4), /48 base (IPv6), ``_invalid`` for anything else."""
    return (
        F.when(F.coalesce(ip, F.lit("")) == "", F.lit(""))
        .when(_is_v4(ip), F.regexp_replace(ip, r"\.[0-9]+\z", ""))
        .when(~F.contains(ip, F.lit(":")), F.lit(INVALID_PREFIX))
        .otherwise(F.coalesce(_let(_v6_groups(ip), _v6_prefix), F.lit(INVALID_PREFIX)))
    )


def client_ip(forwarded_for: Column, peer: Column, trusted_hops: int = 1) -> Column:
    """The client behind ``trusted_hops`` proxies, read right to left; ports are dropped."""

    def bare(entry: Column) -> Column:
        closed = entry.startswith("[") & entry.contains("]")
        return (
            F.when(closed, F.regexp_extract(entry, r"^\[([^\]]*)\]", 1))
            .when(entry.startswith("["), entry)
            .otherwise(F.regexp_replace(entry, r":[^:]*\z", ""))
        )

    entries = F.transform(
        F.split(forwarded_for, ","), lambda p: F.regexp_replace(p, r"^\s+|\s+\z", "")
    )
    hops = F.transform(F.filter(entries, lambda p: p != ""), bare)
    return (
        F.when(F.coalesce(forwarded_for, F.lit("")) == "", F.coalesce(peer, F.lit("")))
        .when(F.size(hops) == 0, F.lit(""))
        .when(F.size(hops) <= trusted_hops, F.get(hops, F.lit(0)))
        .otherwise(F.get(hops, F.size(hops) - (trusted_hops + 1)))
    )


def ip_key(ip: Column) -> Column:
    """Quota key: brackets off, empty becomes ``_unknown``."""
    bare = F.regexp_replace(ip, r"^\[(.*)\]\z", "$1")
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit(UNKNOWN_KEY)).otherwise(bare)


def is_loopback(ip: Column) -> Column:
    """127.0.0.0/8, also mapped into IPv6, and every spelling of ::1."""
    v6 = F.concat_ws(":", _v6_groups(ip))
    v6_own = v6.rlike("^0:0:0:0:0:(0:0:1|ffff:7f[0-9a-f]{2}:[0-9a-f]+)$")
    return F.coalesce((_is_v4(ip) & ip.startswith("127.")) | v6_own, F.lit(False))
