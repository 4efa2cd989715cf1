"""Internet addresses as columns: 128 bits in two longs, parsed without Python, and blocks of them.

An address is struct(v, hi, lo): v is 4 or 6, and the bits begin at the top of ``hi``.  IPv4 addresses that
are mapped into IPv6 are IPv4 addresses.
"""

from __future__ import annotations

import functools
import ipaddress
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions.contents import bound
from heddle.functions.text import col, strip

ADDRESS = "struct<v:int,hi:bigint,lo:bigint>"
_OCTET = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
_DOTTED = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


_WORD = (1 << 64) - 1


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def _of_dotted(text: Column) -> Column:
    return F.aggregate(F.split(text, r"\."), F.lit(0).cast("bigint"), lambda n, x: n * 256 + x.cast("bigint"))


def _long(groups: Column, first: int) -> Column:
    """Four groups of sixteen bits as a long."""
    return F.conv(F.array_join(F.transform(F.slice(groups, first, 4), lambda g: F.lpad(g, 4, "0")), ""), 16, -10).cast("bigint")


def _v6(text: Column) -> Column:
    """struct(hi, lo) of an IPv6 text in lower case, null for what is none."""

    def groups_of(half: Column) -> Column:
        return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    def whole(halves: Column) -> Column:
        left, right = groups_of(halves[0]), F.when(F.size(halves) == 2, groups_of(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        return bound(F.struct(left.alias("left"), right.alias("right"), F.size(halves).alias("n")), filled)

    def filled(x: Column) -> Column:
        missing = 8 - F.size(x["left"]) - F.size(x["right"])
        every = F.forall(F.concat(x["left"], x["right"]), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        fits = every & F.when(x["n"] == 1, missing == 0).otherwise((x["n"] == 2) & (missing >= 1))
        groups = F.concat(x["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), x["right"])
        return F.when(fits, bound(groups, lambda g: F.struct(_long(g, 1).alias("hi"), _long(g, 5).alias("lo"))))

    # a dotted end is two groups
    def spelt(tail: Column) -> Column:
        hexed = lambda n: F.concat(F.substr(text, F.lit(1), F.length(text) - F.length(tail)), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF)))))
        return F.when(tail == "", text).otherwise(bound(_of_dotted(tail), hexed))

    return bound(F.split(bound(F.regexp_extract(text, rf":({_DOTTED})$", 1), spelt), "::", -1), whole)


def parse(text: Column | str) -> Column:
    """An address text, of IPv6 also with a zone; null for what is none."""

    def of_four(n: Column) -> Column:
        return F.struct(F.lit(4).alias("v"), F.shiftleft(n, 32).alias("hi"), F.lit(0).cast("bigint").alias("lo"))

    def of_six(x: Column) -> Column:
        mapped = (x["hi"] == 0) & (F.shiftrightunsigned(x["lo"], 32) == 0xFFFF)
        own = F.struct(F.lit(6).alias("v"), x["hi"].alias("hi"), x["lo"].alias("lo"))
        return F.when(mapped, of_four(x["lo"].bitwiseAND(F.lit(0xFFFFFFFF)))).when(x.isNotNull(), own)

    one = lambda t: F.when(t.rlike(f"^{_DOTTED}$"), of_four(_of_dotted(t))).when(t.contains(":"), bound(_v6(t), of_six))
    return bound(F.lower(strip(F.regexp_replace(col(text), "%.*$", ""))), one)


def head(address: Column, bits: int | Column) -> Column:
    """The address with all but its first ``bits`` bits cleared."""
    masked = lambda hi, lo: F.struct(address["v"].alias("v"), address["hi"].bitwiseAND(hi).alias("hi"), address["lo"].bitwiseAND(lo).alias("lo"))
    if isinstance(bits, int):
        mask = ((1 << bits) - 1) << (128 - bits)
        return masked(F.lit(_signed(mask >> 64)).cast("bigint"), F.lit(_signed(mask & _WORD)).cast("bigint"))
    n = bits
    # shifts count modulo 64, so none and all bits are cases of their own
    ones = lambda k: F.when(k <= 0, F.lit(0).cast("bigint")).when(k >= 64, F.lit(-1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("bigint"), (64 - k).cast("int")))
    return masked(ones(n), ones(n - 64))


def block(text: Column | str) -> Column:
    """struct(v, hi, lo, bits) of a block like ``10.0.0.0/8``; null for what is none."""
    t = col(text)
    bits = F.regexp_extract(t, r"/(\d{1,3})$", 1)
    most = lambda a: F.when(a["v"] == 4, 32).otherwise(128)
    whole = lambda x: F.when(x["bits"] <= most(x["a"]), F.struct(x["a"]["v"].alias("v"), head(x["a"], x["bits"])["hi"].alias("hi"), head(x["a"], x["bits"])["lo"].alias("lo"), x["bits"].alias("bits")))
    return F.when(bits != "", bound(F.struct(parse(F.regexp_replace(t, "/.*$", "")).alias("a"), bits.cast("int").alias("bits")), whole))


def is_in(address: Column, blocks: Sequence[str]) -> Column:
    """Whether an address is in one of a few constant blocks; null for a null one."""
    hits = []
    for b in map(ipaddress.ip_network, blocks):
        wide = int(b[0]) << (96 if b.version == 4 else 0)
        same = head(address, b.prefixlen)
        hits.append((same["v"] == b.version) & (same["hi"] == _signed(wide >> 64)) & (same["lo"] == _signed(wide & _WORD)))
    return functools.reduce(lambda x, y: x | y, hits)
