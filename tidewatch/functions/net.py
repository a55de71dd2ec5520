"""Addresses, ports and flow hashes as column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
INTERNAL = ("192.168.0.0/24",)  # fixed value: the networks counted as internal
PROTOCOLS = {"TCP": 6, "UDP": 17, "SCTP": 132}  # fixed values: protocol numbers


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def ipv4_number(ip: Column) -> Column:
    """A dotted quad as a number; null for anything else."""
    parts = F.split(F.when(ip.rlike(IPV4), ip), r"\.")
    return sum(F.get(parts, F.lit(k)).cast("long") * 256 ** (3 - k) for k in range(4))


def is_internal(ip: Column, networks=INTERNAL) -> Column:
    """Membership in any network; false for null, empty, invalid and IPv6 addresses."""
    number, found = ipv4_number(ip), F.lit(False)
    for n in map(ipaddress.ip_network, networks):
        shift = 32 - n.prefixlen
        found = found | (F.shiftright(number, shift) == (int(n.network_address) >> shift))
    return F.coalesce(found, F.lit(False))


def inbound(src: Column, dest: Column, networks=INTERNAL) -> Column:
    return ~is_internal(src, networks) & is_internal(dest, networks)


def _groups(text: Column) -> Column:
    """The groups of one side of an IPv6 address, a dotted quad as two groups; junk stays and is found by length or form."""
    tail = F.lower(F.hex(ipv4_number(F.substring_index(text, ":", -1))))
    quad = F.lpad(tail, 8, "0")
    whole = F.when(text.contains("."), F.concat(F.left(text, F.length(text) - F.length(F.substring_index(text, ":", -1))), F.left(quad, F.lit(4)), F.lit(":"), F.right(quad, F.lit(4)))).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(whole, ":", -1))


def ipv6_bytes(ip: Column) -> Column:
    """Sixteen bytes of an IPv6 address in any of its text forms, without a zone; null for anything else."""
    sides = F.split(F.when(ip.contains(":"), F.lower(ip)), "::", -1)

    def made(x: Column) -> Column:
        n = F.size(x["l"]) + F.size(x["r"])
        fill = F.array_repeat(F.lit("0"), F.when(x["gap"], 8 - n).otherwise(0))
        every = F.concat(x["l"], fill, x["r"])
        ok = F.when(x["gap"], n <= 7).otherwise(n == 8) & F.forall(F.concat(x["l"], x["r"]), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(ok, F.unhex(F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), "")))

    gap = F.size(sides) == 2
    return F.when(F.size(sides).isin(1, 2), let(F.struct(gap.alias("gap"), _groups(F.get(sides, F.lit(0))).alias("l"), F.when(gap, _groups(F.get(sides, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("r")), made))


def packed(ip: Column, ipv6: bool = False) -> Column:
    """Network-order bytes of an address."""
    v4 = F.unhex(F.lpad(F.hex(ipv4_number(ip)), 8, "0"))
    return F.coalesce(v4, ipv6_bytes(ip)) if ipv6 else v4


def community_id(src_ip: Column, src_port: Column, dest_ip: Column, dest_port: Column, proto: Column, seed: int = 0, ipv6: bool = False) -> Column:
    """Community ID version 1; null unless TCP, UDP or SCTP with both addresses and ports.

    One flat expression, so that it is compiled and its repeated parts are computed once.
    """
    two = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 4, "0"))
    name = F.upper(proto)
    number = F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in PROTOCOLS.items()])
    a, b, p, q = packed(src_ip, ipv6), packed(dest_ip, ipv6), src_port, dest_port
    # bytes compare as unsigned
    first = (a < b) | (a == b) & (p <= q)
    pick = lambda x, y: F.when(first, x).otherwise(y)
    ok = number.isNotNull() & (F.length(a) == F.length(b)) & p.isNotNull() & q.isNotNull()
    whole = F.concat(two(F.lit(seed)), pick(a, b), pick(b, a), two(number * 256), two(pick(p, q)), two(pick(q, p)))
    return F.when(ok, F.concat(F.lit("1:"), F.base64(F.unhex(F.sha1(whole)))))
