"""IP addresses as strings of bits, so that networks are prefixes."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.operators.shared import let

#: Networks that are not public, with those inside them that are.
PRIVATE_4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "240.0.0.0/4", "255.255.255.255/32",
)
PUBLIC_4 = ("192.0.0.9/32", "192.0.0.10/32")
SHARED_4, MULTICAST_4 = ("100.64.0.0/10",), ("224.0.0.0/4",)
PRIVATE_6 = ("::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10")
PUBLIC_6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
MULTICAST_6, MAPPED = ("ff00::/8",), "::ffff:0.0.0.0/96"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_GROUPS = "(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?"


def _bits_4(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, r"\."), lambda x: F.lpad(F.conv(x, 10, 2), 8, "0")), "")


def _bits_6(text: Column) -> Column:
    """Bits of an IPv6 address without dots; null if it is none."""

    def whole(sides: Column) -> Column:
        size = lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, ":")))
        digits = lambda x: F.array_join(F.transform(F.split(x, ":"), lambda g: F.when(g == "", "").otherwise(F.lpad(g, 4, "0"))), "")
        left, right = F.get(sides, F.lit(0)), F.coalesce(F.get(sides, F.lit(1)), F.lit(""))
        n = size(left) + size(right)
        fits = F.when(F.size(sides) == 2, n < 8).otherwise((F.size(sides) == 1) & (n == 8))
        return F.when(fits, F.concat(digits(left), F.repeat(F.lit("0000"), 8 - n), digits(right)))

    half = lambda x: F.lpad(F.conv(x, 16, 2), 64, "0")
    found = F.when(text.rlike(f"^{_GROUPS}(?:::{_GROUPS})?$"), let(F.split(text, "::", -1), whole))
    return let(found, lambda h: F.concat(half(F.left(h, F.lit(16))), half(F.right(h, F.lit(16)))))


def bits(address: Column) -> Column:
    """``4`` and 32 bits or ``6`` and 128 bits as a string; null if the text is no address.

    A scope after ``%`` is left out; an IPv6 address may end with an IPv4 one.
    """
    bare = F.when(address.rlike(r"^[^%/]*(?:%[^%/]+)?$"), F.regexp_extract(address, "^([^%]*)", 1))

    def six(x: Column) -> Column:
        head, tail = F.regexp_extract(x, "^(.*:)[^:]*$", 1), F.regexp_extract(x, "([^:]*)$", 1)
        dotted = let(F.lpad(F.conv(_bits_4(tail), 2, 16), 8, "0"), lambda h: F.concat(head, F.left(h, F.lit(4)), F.lit(":"), F.right(h, F.lit(4))))
        return F.when(~F.contains(x, F.lit(".")), x).when(tail.rlike(f"^{IPV4}$"), dotted)

    four = F.when(address.rlike(rf"^{IPV4}\z"), F.concat(F.lit("4"), _bits_4(address)))
    return F.coalesce(four, F.when(F.contains(address, F.lit(":")), F.concat(F.lit("6"), let(let(bare, six), _bits_6))))


def network_bits(network: str) -> str:
    """The bits that all addresses of a network begin with."""
    found = ipaddress.ip_network(network)
    size = found.max_prefixlen
    return f"{found.version}{int(found.network_address):0{size}b}"[: 1 + found.prefixlen]


def within(found: Column, networks: tuple[str, ...]) -> Column:
    """Whether bits lie in one of a few networks."""
    return F.exists(F.array(*[F.lit(network_bits(n)) for n in networks]), lambda p: F.startswith(found, p))


def is_public(address: Column) -> Column:
    """Whether an address is global and not multicast; false for other texts, null for null."""

    def judged(b: Column) -> Column:
        inner = F.concat(F.lit("4"), F.substr(b, F.lit(98)))
        private_4 = lambda x: within(x, PRIVATE_4) & ~within(x, PUBLIC_4)
        private_6 = within(b, PRIVATE_6) & ~within(b, PUBLIC_6)
        four = ~private_4(b) & ~within(b, SHARED_4) & ~within(b, MULTICAST_4)
        six = F.when(within(b, (MAPPED,)), ~private_4(inner)).otherwise(~private_6 & ~within(b, MULTICAST_6))
        return F.when(b.isNull(), False).when(F.startswith(b, F.lit("4")), four).otherwise(six)

    return F.when(address.isNotNull(), let(bits(address), judged))


def listed_in(rows: DataFrame, blocks: DataFrame, *, address: str = "address", block: str = "block") -> DataFrame:
    """Add ``block``, the longest of the networks ``blocks`` (such as ``10.0.0.0/8``) that holds the address, or null.

    A network is the bits that its addresses begin with, so an address meets the table once
    for each length of a network that is there (162 at most), by equal keys: no range
    join, and no list whose size matters. Each distinct address is looked up once. Texts
    that are no network, and networks with bits beyond their length, list nothing.
    """
    size = F.nullif(F.regexp_extract(block, r"/([0-9]{1,3})$", 1), F.lit("")).cast("int")
    parsed = blocks.select(F.col(block).alias("_block"), bits(F.regexp_extract(block, "^([^/]*)", 1)).alias("_b"), size.alias("_n"), F.contains(block, F.lit("/")).alias("_has"))
    parsed = parsed.withColumn("_n", F.when(F.col("_has"), F.col("_n")).otherwise(F.length("_b") - 1)).where("_n < length(_b)")
    nets = parsed.where("NOT contains(substr(_b, _n + 2), '1')").select(F.expr("left(_b, _n + 1)").alias("_key"), "_block").groupBy("_key").agg(F.min("_block").alias("_block"))
    lengths = sorted(r[0] for r in nets.select(F.length("_key")).distinct().collect())  # 162 at most
    found = rows.select(F.col(address).alias("_a")).where("_a IS NOT NULL").distinct().withColumn("_b", bits(F.col("_a")))
    keys = F.explode(F.filter(F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: F.when(F.length("_b") >= n, F.left("_b", n))), lambda k: k.isNotNull()))
    best = found.withColumn("_key", keys).join(nets, "_key").groupBy("_a").agg(F.max_by("_block", F.length("_key")).alias("block"))
    return rows.join(best, F.col(address) == F.col("_a"), "left").drop("_a")
