"""IP address scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.bind import let

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = f"^{_OCTET}(?:[.]{_OCTET}){{3}}$"


_GROUPS = "(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)"
IPV6 = f"^(?:{_GROUPS}|{_GROUPS}?::{_GROUPS}?)$"


def _without_dots(address: Column) -> Column:
    """A dotted tail as two groups of hex digits."""
    tail = F.regexp_extract(address, f"^.*:({IPV4[1:-1]})$", 1)
    number = ipv4_number(tail)
    group = lambda n: F.lower(F.conv(n.cast("string"), 10, 16))
    hexed = F.concat(F.regexp_replace(address, "[^:]*$", ""), group(F.shiftright(number, 16)), F.lit(":"), group(number.bitwiseAND(0xFFFF)))
    return F.when(tail == "", address).otherwise(hexed)


def _groups(address: Column) -> Column:
    """Eight groups without leading zeros, NULL when there are not as many."""
    listed = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    left, right = listed(F.substring_index(address, "::", 1)), listed(F.substring_index(address, "::", -1))
    missing = 8 - F.size(left) - F.size(right)
    whole = F.when(~F.contains(address, F.lit("::")), listed(address)).when(missing > 0, F.concat(left, F.array_repeat(F.lit("0"), missing), right))
    return let(F.transform(whole, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), lambda g: F.when(F.size(g) == 8, g))


def ipv6_groups(col: Column) -> Column:
    """The eight groups of an IPv6 address without zone, NULL when it does not parse."""
    return let(_without_dots(F.lower(F.regexp_replace(col, "%[^%]+$", ""))), lambda a: F.when(a.rlike(IPV6), _groups(a)))


def _shown(groups: Column) -> Column:
    """Text of eight groups: the first longest run of zeros as ``::``, mapped IPv4 with dots."""
    flags = F.array_join(F.transform(groups, lambda g: F.when(g == "0", "0").otherwise("x")), "")

    def short(f: Column) -> Column:
        out = F.array_join(groups, ":")
        for n in range(2, 9):
            at = F.instr(f, F.lit("0" * n))
            cut = F.concat(F.array_join(F.slice(groups, F.lit(1), at - 1), ":"), F.lit("::"), F.array_join(F.slice(groups, at + n, F.lit(8)), ":"))
            out = F.when(at > 0, cut).otherwise(out)
        low = [F.conv(F.element_at(groups, i), 16, 10).cast("int") for i in (7, 8)]
        octets = [o.cast("string") for n in low for o in (F.shiftright(n, 8), n.bitwiseAND(255))]
        mapped = f.startswith("00000") & (F.element_at(groups, 6) == "ffff")
        return F.when(mapped, F.concat(F.lit("::ffff:"), F.concat_ws(".", *octets))).otherwise(out)

    return let(flags, short)


def canonical_ip(col: Column, ipv6: bool = True) -> Column:
    """Canonical text of an IP address, NULL when it does not parse; column expressions only."""
    v4 = F.when(col.rlike(IPV4), col)
    if not ipv6:
        return v4
    zone = F.regexp_extract(col, "(%[^%]+)$", 1)
    v6 = let(ipv6_groups(col), lambda g: F.when(g.isNotNull(), F.concat(_shown(g), zone)))
    return F.coalesce(v4, F.when(F.contains(col, F.lit(":")), v6))


def ipv6_key(col: Column) -> Column:
    """The 128 bits of an IPv6 address as 32 hex digits, which sort as numbers; NULL for anything else."""
    digits = F.transform(ipv6_groups(col), lambda g: F.lpad(g, 4, "0"))
    return F.when(F.contains(col, F.lit(":")), F.array_join(digits, ""))


def client_ip(forwarded_for: Column, peer: Column, ipv6: bool = True) -> Column:
    """First forwarded entry if it parses, else the peer address (canonical where it parses)."""
    from parley.functions.text import strip_ws

    first = strip_ws(F.element_at(F.split(F.coalesce(forwarded_for, F.lit("")), ","), 1))
    fallback = F.nullif(peer, F.lit(""))
    return F.coalesce(canonical_ip(first, ipv6), canonical_ip(fallback, ipv6), fallback)


def ipv4_number(col: Column) -> Column:
    """IPv4 text as an unsigned 32-bit number; NULL for anything else."""
    octets = F.split(F.when(col.rlike(IPV4), col), "[.]")
    return F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o.cast("bigint"))
