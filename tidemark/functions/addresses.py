"""Internet addresses as numbers, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"{OCTET}(?:\.{OCTET}){{3}}"
GROUP = "^[0-9a-f]{1,4}$"


def _dotted(text: Column) -> Column:
    return F.aggregate(F.split(text, r"\."), F.lit(0).cast("long"), lambda n, o: F.shiftleft(n, 8).bitwiseOR(o.try_cast("long")))


def _groups_of(half: Column) -> Column:
    return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))


def address(ip: Column) -> Column:
    """(v6, at) of an address's text, or null where it is none.

    at is an IPv4 address's number, or the first 64 bits of an IPv6 address. IPv6 forms of IPv4 addresses count as
    IPv4. Zones and ports make no address.
    """
    text = F.lower(ip)
    tail = F.regexp_extract(text, rf":({DOTTED})$", 1)
    low = _dotted(F.when(tail != "", tail).otherwise("0.0.0.0"))
    as_groups = F.concat(F.regexp_replace(text, rf"{DOTTED}$", ""), F.lower(F.hex(F.shiftright(low, 16))), F.lit(":"), F.lower(F.hex(low.bitwiseAND(F.lit(0xFFFF)))))
    halves = F.split(F.when(tail != "", as_groups).otherwise(text), "::", -1)
    left, right = _groups_of(halves[0]), _groups_of(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    short = F.size(halves) == 2
    given = F.size(left) + F.size(right)
    groups = F.when(short, F.concat(left, F.array_repeat(F.lit("0"), 8 - given), right)).otherwise(left)
    valid = (F.size(halves) <= 2) & (F.size(groups) == 8) & (~short | (given <= 7)) & F.forall(groups, lambda g: g.rlike(GROUP))
    numbers = F.transform(groups, lambda g: F.conv(g, 16, 10).try_cast("long"))

    def joined(first: int, n: int) -> Column:
        return F.aggregate(F.slice(numbers, first, n), F.lit(0).cast("long"), lambda a, g: F.shiftleft(a, 16).bitwiseOR(g))

    mapped = (joined(1, 4) == 0) & (joined(5, 2) == 0xFFFF)
    v6 = F.when(mapped, F.struct(F.lit(False).alias("v6"), joined(7, 2).alias("at"))).otherwise(F.struct(F.lit(True).alias("v6"), joined(1, 4).alias("at")))
    return F.when(text.rlike(f"^{DOTTED}$"), F.struct(F.lit(False).alias("v6"), _dotted(F.when(text.rlike(f"^{DOTTED}$"), text)).alias("at"))).when(valid, v6)
