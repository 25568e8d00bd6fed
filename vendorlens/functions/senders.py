"""Sender, date and header parsing as columns. Headers are ``array<struct<name,value>>``."""

from pyspark.sql import Column, functions as F

from ..dims import domains as dims
from ..dims.patterns import WHITE_SPACE
from .let import let
from .text import js_trim

EPOCH_2000_MS = 946684800000

_NAMED = rf"\A(.+?)[{WHITE_SPACE}]*<([^>]+)>\z"
_BARE = r"\A<([^>]+)>\z"
_ADDRESS = rf"[^{WHITE_SPACE}<>]+@[^{WHITE_SPACE}<>]+"


def parse_sender(raw: Column) -> Column:
    """``struct<name, email>`` of a From value: named, bare ``<address>`` or free text."""
    return let(F.coalesce(raw, F.lit("")), _sender_parts)


def _sender_parts(raw: Column) -> Column:
    def named(email):
        name = F.regexp_replace(F.regexp_extract(raw, _NAMED, 1), r"""\A["']|["']\z""", "")
        return F.struct(js_trim(name).alias("name"), F.lower(email).alias("email"))

    def unnamed(email):
        return F.struct(F.lit("").alias("name"), F.lower(email).alias("email"))

    free = let(F.regexp_extract(raw, _ADDRESS, 0), lambda found: unnamed(
        F.when(found != "", found).otherwise(js_trim(raw))))
    bare = let(F.regexp_extract(raw, _BARE, 1), lambda email: F.when(email != "", unnamed(email)).otherwise(free))
    return let(F.regexp_extract(raw, _NAMED, 2), lambda email: F.when(email != "", named(email)).otherwise(bare))


def header_date_ms(text: Column) -> Column:
    """Epoch milliseconds of a mail date header (RFC 5322 or ISO), null if unreadable."""
    bare = F.regexp_replace(F.trim(text), r"\A[A-Za-z]{3},\s*|\s*\([^)]*\)\s*\z", "")
    zoned = F.regexp_replace(bare, r"\s+(GMT|UTC|UT|Z)\z", " +0000")
    return F.unix_millis(let(zoned, lambda date: F.coalesce(
        F.try_to_timestamp(date, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(date, F.lit("d MMM yyyy HH:mm Z")),
        date.try_cast("timestamp"))))


def message_date_ms(header_ms: Column, ingest_ms: Column) -> Column:
    """Header date when it lies after 2000-01-01 UTC, else the time of ingest."""
    return F.coalesce(let(header_ms, lambda ms: F.when(ms > EPOCH_2000_MS, ms)), ingest_ms)


def header_value(headers: Column, name: str) -> Column:
    """First value of a header, whatever its spelling; null when absent or empty."""
    hit = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return let(F.try_element_at(hit, F.lit(1))["value"], lambda v: F.when(v != "", v))


def lower_names(headers: Column) -> Column:
    """Names of a header list in lower case: bound to a column once, it serves :func:`named_value` for any number of names."""
    return F.transform(headers, lambda h: F.lower(h["name"]))


def named_value(headers: Column, names: Column, name: str) -> Column:
    """:func:`header_value` from the list and its lower-case names."""
    at = F.nullif(F.array_position(names, name.lower()), F.lit(0)).cast("int")
    return F.nullif(F.try_element_at(headers, at)["value"], F.lit(""))


def _first_of_each_name(headers: Column) -> Column:
    return let(headers, lambda hs: let(
        F.transform(hs, lambda h: h["name"]),
        lambda names: F.filter(hs, lambda h, i: F.array_position(names, h["name"]) == i + 1)))


def headers_map(headers: Column, policy: str = "last") -> Column:
    """Header list to map inside the row, without a shuffle.

    ``first``: names lower-cased, blank values dropped, first value wins (mailbox protocol).
    ``last``: spelling kept, last value wins, names stay in order of first use (web interfaces).
    """
    headers = F.coalesce(headers, F.expr("array()").cast("array<struct<name:string,value:string>>"))
    if policy == "first":
        clean = F.transform(headers, lambda h: F.struct(
            F.lower(h["name"]).alias("name"), js_trim(h["value"]).alias("value")))
        kept = _first_of_each_name(F.filter(clean, lambda h: h["value"] != ""))
    elif policy == "last":
        merged = let(headers, lambda hs: F.transform(_first_of_each_name(hs), lambda h: F.struct(
            h["name"].alias("name"),
            F.element_at(F.filter(hs, lambda g: g["name"] == h["name"]), -1)["value"].alias("value"))))
        # Most lists name each header once; they are the map already.
        once = F.size(F.array_compact(F.array_distinct(headers["name"]))) == F.size(headers)
        kept = F.when(once, headers).otherwise(merged)
    else:
        raise ValueError(f"unknown header policy: {policy}")
    return F.map_from_entries(kept)


def has_bulk_headers(headers: Column) -> Column:
    """True when a header map marks bulk mail. Automatic replies never count."""
    headers = F.coalesce(headers, F.expr("map()").cast("map<string,string>"))
    spelled = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))
    marks = F.array(*[F.lit(n) for n in (*dims.LIST_HEADERS, "precedence", *dims.SENDER_PLATFORM_HEADERS)])
    # Maps without any of the names that can mark bulk mail aren't looked at one name after the other.
    names = F.split(F.lower(F.array_join(F.map_keys(headers), "\n")), "\n")
    return F.when(F.arrays_overlap(names, marks), let(F.filter(spelled, lambda e: e["value"].isNotNull()), _marks_bulk)).otherwise(False)


def _marks_bulk(entries: Column) -> Column:
    def value(name):
        last = F.try_element_at(F.filter(entries, lambda e: e["name"] == name), F.lit(-1))
        return let(last["value"], lambda v: F.when(v != "", v))

    auto = F.lower(F.coalesce(value("auto-submitted"), value("x-auto-submitted"), F.lit("")))
    listed = F.coalesce(*[value(n) for n in dims.LIST_HEADERS]).isNotNull()
    precedence = F.coalesce(F.lower(value("precedence")).isin(dims.BULK_PRECEDENCE), F.lit(False))
    platform = F.exists(entries, lambda e: e["name"].isin(dims.SENDER_PLATFORM_HEADERS))
    return ~F.startswith(auto, F.lit("auto-")) & (listed | precedence | platform)
