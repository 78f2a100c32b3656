"""Filters on findings; each is a boolean column."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let
from .text import count_of, wrapped_context

# Public resolvers that are no finding, and what the name of a tag or a line says.
DNS_SERVERS = (
    "8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "76.76.19.19", "76.223.122.150", "9.9.9.9", "149.112.112.112",
    "208.67.222.222", "208.67.220.220", "8.26.56.26", "8.20.247.20", "94.140.14.14", "94.140.15.15",
)
DROPPED_TAGS = ("AMBIGUOUS", "USERNAME")
HASH_WORDS = ("sha", "md5", "hash", "byte")
HASH_LENGTHS = (32, 40, 64)
HASH_SHARE = 0.02
# Private IPv4 networks, and the two addresses in one of them that are not.
PRIVATE_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
NOT_PRIVATE = ("192.0.0.9", "192.0.0.10")
# The same for IPv6. An address that stands for an IPv4 one (MAPPED) is what that one is.
PRIVATE_V6 = ("::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10")
NOT_PRIVATE_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
MAPPED = "::ffff:0:0/96"


def has_digit(value: Column) -> Column:
    return value.rlike(r"(?U)\d")


def looks_like_date(value: Column) -> Column:
    """dd.dd.dd. at the start, as day, month and year; no other date shape can begin an address."""
    return value.rlike(r"^[0-3]\d\.[0-3]\d\.\d\d\.")


def looks_like_version(value: Column, around: Column) -> Column:
    """Four one-digit numbers, unless the text around them speaks of servers."""
    lowered = F.lower(around)
    dots = F.length(value) - F.length(F.replace(value, F.lit("."), F.lit("")))
    return (F.length(value) == 7) & (dots == 3) & ~(F.contains(lowered, F.lit("dns")) | F.contains(lowered, F.lit("server")))


def _is_v6(value: Column) -> Column:
    return F.contains(value, F.lit(":"))


def _valid_v4(value: Column) -> Column:
    octet = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
    return value.rlike(rf"^(?:{octet}\.){{3}}{octet}$")


def _number(value: Column) -> Column:
    return F.aggregate(F.split(value, "[.]"), F.lit(0).cast("long"), lambda a, x: a * 256 + x.try_cast("long"))


def _digits(network: str) -> tuple[str, str]:
    """First and last address of an IPv6 network as 32 hexadecimal digits."""
    found = ipaddress.ip_network(network)
    return f"{int(found[0]):032x}", f"{int(found[-1]):032x}"


def _v6_digits(value: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, or null if it is none."""
    bare = F.lower(F.substring_index(value, "%", 1))
    tail = F.substring_index(bare, ":", -1)
    with_v4 = F.contains(tail, F.lit("."))
    number = _number(tail)
    pair = F.concat_ws(":", F.conv(F.shiftright(number, 16).cast("string"), 10, 16), F.conv(number.bitwiseAND(0xFFFF).cast("string"), 10, 16))
    plain = F.when(~with_v4, bare).when(_valid_v4(tail), F.concat(F.substring(bare, F.lit(1), F.length(bare) - F.length(tail)), F.lower(pair)))

    def padded(sides: Column) -> Column:
        groups = lambda i: F.when(F.get(sides, i) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(sides, i), ":"))
        left, right = groups(F.lit(0)), F.when(F.size(sides) == 2, groups(F.lit(1))).otherwise(F.array().cast("array<string>"))
        missing = 8 - F.size(left) - F.size(right)
        fits = F.when(F.size(sides) == 1, missing == 0).otherwise((F.size(sides) == 2) & (missing >= 1))
        well = F.forall(sides, lambda x: x.rlike("^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?$"))
        return F.when(well & fits, F.array_join(F.transform(F.concat(left, F.array_repeat(F.lit("0"), missing), right), lambda x: F.lpad(x, 4, "0")), ""))

    return let(F.split(plain, "::", -1), padded)


def _v6_kind(digits: Column) -> Column:
    inside = lambda networks: _any(digits.between(*_digits(x)) for x in networks)
    low = F.conv(F.substring(digits, 25, 8), 16, 10).cast("long")
    private = F.when(digits.between(*_digits(MAPPED)), _private_number(low)).otherwise(inside(PRIVATE_V6) & ~inside(NOT_PRIVATE_V6))
    return F.when(digits.isNull(), "invalid").when(private, "private").otherwise("public")


def _any(conditions) -> Column:
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found


def _private_number(number: Column) -> Column:
    inside = _any(number.between(int(x[0]), int(x[-1])) for x in map(ipaddress.ip_network, PRIVATE_NETWORKS))
    return inside & ~number.isin(*(int(ipaddress.ip_address(x)) for x in NOT_PRIVATE))


def address_kind(value: Column) -> Column:
    """invalid, private or public."""
    v4 = F.when(~_valid_v4(value), "invalid").when(let(_number(value), _private_number), "private").otherwise("public")
    return F.when(F.contains(value, F.lit(":")), let(_v6_digits(value), _v6_kind)).otherwise(v4)


def not_an_address(value: Column, v6: bool = True) -> Column:
    """v6: else no IPv6 address is taken for one."""
    return F.when(_is_v6(value), address_kind(value) == "invalid" if v6 else F.lit(True)).otherwise(~_valid_v4(value))


def excluded_address(value: Column, v6: bool = True) -> Column:
    """No address, a private one, or a public resolver."""
    kept = address_kind(value) == "public"
    return ~(kept if v6 else kept & ~_is_v6(value)) | value.isin(*DNS_SERVERS)


def on_hash_line(text: Column, value: Column) -> Column:
    """A value of a digest's length whose first occurrence follows a word on hashes in its line."""
    before = F.lower(F.substring_index(F.substring(text, F.lit(1), F.instr(text, value) - 1), "\n", -1))
    named = F.lit(False)
    for word in HASH_WORDS:
        named = named | F.contains(before, F.lit(word))
    return F.length(value).isin(*HASH_LENGTHS) & named


def dense_in_hashes(text: Column, share: float = HASH_SHARE) -> Column:
    """More mentions of sha, or of hash, than share of the newlines."""
    limit = F.floor(count_of(text, "\n") * F.lit(share))
    lowered = F.lower(text)
    return (count_of(lowered, "sha") > limit) | (count_of(lowered, "hash") > limit)


def is_address_finding(text: Column, x: Column, v6: bool = True) -> Column:
    """The filters of a regex IP finding x (a span)."""
    return has_digit(x["value"]) & ~looks_like_date(x["value"]) & ~looks_like_version(x["value"], wrapped_context(text, x["start"], x["end"])) & ~not_an_address(x["value"], v6)


def keep_entity(tag: Column, value: Column, gibberish: Callable[[Column], Column]) -> Column:
    """Whether a model's entity is reported."""
    words = F.size(F.array_remove(F.split(value, r"(?U)[\s\x1c-\x1f]+"), ""))
    by_tag = F.when(tag == "IP_ADDRESS", ~excluded_address(value)).when(tag == "KEY", (F.length(value) > 8) & gibberish(F.lower(value))).when(tag == "NAME", words > 1).otherwise(True)
    return F.when(tag.isin(*DROPPED_TAGS) | (F.length(value) <= 3), False).otherwise(by_tag)
