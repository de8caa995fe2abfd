"""Admission: who may ask, and which requests are errors, as Columns."""

from __future__ import annotations

import ipaddress
import logging
from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import let

log = logging.getLogger(__name__)

MAX_BYTES = 8 * 1024 * 1024
#: A list that is one of these lets everyone in.
EVERYONE = ("", "*", "all", "0.0.0.0/0", "::/0")


def parse_networks(entries: str | Iterable[str]) -> list[ipaddress.IPv4Network | ipaddress.IPv6Network]:
    """Networks of the entries (a list, or one string with commas) that are valid; others are skipped with a word in the log. None: everyone may ask."""
    entries = [e.strip() for e in (entries.split(",") if isinstance(entries, str) else entries)]
    if ",".join(entries).lower() in EVERYONE:
        return []
    found = []
    for entry in filter(None, entries):
        try:
            found.append(ipaddress.ip_network(entry, strict=False))
        except ValueError:
            log.warning("no network: %s", entry)
    return found


def ipv4_number(host: Column) -> Column:
    """An IPv4 address as a long; null for all else, numbers with leading zeros too."""
    parts = F.split(host, r"\.")
    fits = host.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\z")
    return F.when(fits, reduce(lambda a, i: a * 256 + F.try_element_at(parts, F.lit(i)).try_cast("long"), (2, 3, 4), F.try_element_at(parts, F.lit(1)).try_cast("long")))


_GROUPS = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})"


def ipv6_halves(host: Column) -> Column:
    """An IPv6 address as struct<hi, lo> of its upper and lower 64 bits; null for all else.

    Any spelling: capitals, one run of zeros left out, an IPv4 address at the end, a zone after %.
    """

    def plain(address: Column) -> Column:
        """With the IPv4 address at the end as two groups; null where it is none."""
        tail = F.regexp_extract(address, r"[0-9]+\.[0-9.]*\z", 0)
        four = ipv4_number(tail)
        groups = F.concat_ws(":", F.lower(F.hex(F.shiftright(four, 16))), F.lower(F.hex(four.bitwiseAND(F.lit(0xFFFF)))))
        return F.when(tail == "", address).when(four.isNotNull(), F.concat(F.substring(address, F.lit(1), F.length(address) - F.length(tail)), groups))

    def count(groups: Column) -> Column:
        return F.when(groups == "", 0).otherwise(F.length(groups) - F.length(F.replace(groups, F.lit(":"), F.lit(""))) + 1)

    def whole(address: Column) -> Column:
        """All eight groups; null where there are not as many."""
        short = F.contains(address, F.lit("::"))
        left, right = F.substring_index(address, "::", 1), F.substring_index(address, "::", -1)
        missing = F.lit(8) - count(left) - count(right)
        filled = F.concat_ws(":", F.nullif(left, F.lit("")), F.rtrim(F.repeat(F.lit("0:"), missing), F.lit(":")), F.nullif(right, F.lit("")))
        fits = address.rlike(rf"^(?:{_GROUPS}{{7}}|(?:{_GROUPS}*)?::(?:{_GROUPS}*)?)\z")
        return F.when(fits & ~short, address).when(fits & (missing >= 1), filled)

    def half(groups: Column, first: int) -> Column:
        four = [F.conv(F.split_part(groups, F.lit(":"), F.lit(first + i)), 16, 10).cast("long") for i in range(4)]
        return reduce(lambda a, b: F.shiftleft(a, 16).bitwiseOR(b), four)

    zone = F.regexp_replace(F.lower(host), r"^([^%]+)%[^%]+\z", "$1")
    both = let(whole(plain(zone)), lambda g: F.when(g.isNotNull(), F.struct(half(g, 1).alias("hi"), half(g, 5).alias("lo"))))
    return F.when(F.contains(host, F.lit(":")), both)


def _among(value: Column, values: Iterable[int | str]) -> Column:
    """value IN (...): a hash set, however many there are."""
    return value.isin(sorted(set(values)))


def ip_allowed(host: Column, networks: str | Iterable[str]) -> Column:
    """No networks allow all; a host that is no address is let through, a null one too.

    A network is a prefix. For each length that networks have, the host's own prefix of that length is
    looked up among theirs: as many terms as there are lengths, and no Python, for either family.
    """
    nets = parse_networks(networks)
    if not nets:
        return F.lit(True)
    by_length: dict[tuple[int, int], list[int]] = defaultdict(list)
    for n in (m for v in (4, 6) for m in ipaddress.collapse_addresses(x for x in nets if x.version == v)):
        by_length[n.version, n.prefixlen].append(int(n.network_address) >> (n.max_prefixlen - n.prefixlen) if n.prefixlen else 0)
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def inside(four: Column, six: Column) -> Column:
        tests = []
        for (version, length), prefixes in by_length.items():
            if version == 4:
                tests.append(_among(F.shiftright(four, 32 - length), prefixes) if length else four.isNotNull())
            elif length == 0:
                tests.append(six.isNotNull())
            elif length <= 64:
                tests.append(_among(F.shiftrightunsigned(six["hi"], 64 - length), prefixes if length < 64 else map(signed, prefixes)))
            else:  # both halves, as one string
                low = F.shiftrightunsigned(six["lo"], 128 - length)
                wanted = [f"{signed(p >> (length - 64))}:{(signed if length == 128 else int)(p & ((1 << (length - 64)) - 1))}" for p in prefixes]
                tests.append(_among(F.concat_ws(":", six["hi"].cast("string"), low.cast("string")), wanted))
        return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])

    def decide(address: Column) -> Column:
        return F.when(address["four"].isNotNull() | address["six"].isNotNull(), inside(address["four"], address["six"])).otherwise(True)

    return let(F.struct(ipv4_number(host).alias("four"), ipv6_halves(host).alias("six")), decide)


def admitted(requests: DataFrame, networks: Iterable[str], host: str = "host") -> DataFrame:
    """Only requests from allowed hosts: filtered before anything is decoded."""
    return requests.where(ip_allowed(F.col(host), networks))


def error_code(api_key: Column, wanted_key: str | None, hint: Column, size: Column, hints: Iterable[str], max_bytes: int = MAX_BYTES) -> Column:
    """The first thing wrong with a request, or null: 401, then 400, then 413."""
    key_bad = F.lit(False) if wanted_key is None else F.coalesce(api_key != wanted_key, F.lit(True))
    hint_bad = F.coalesce((hint != "") & ~hint.isin(*hints), F.lit(False))
    empty = F.coalesce(size == 0, F.lit(True))
    return F.when(key_bad, "unauthorized").when(hint_bad | empty, "invalid_request").when(size > max_bytes, "image_too_large")


def known_hints(types: DataFrame) -> DataFrame:
    """Types and families that a hint may name, each once."""
    return types.select(F.col("doc_type").alias("hint")).union(types.where("family is not null").select("family")).distinct()


def flag(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "yes")


def returned_image(option: Column) -> Column:
    """What image a request wants back; anything unknown is none."""
    return F.when(option.isin("rectified", "annotated"), option).otherwise("none")
