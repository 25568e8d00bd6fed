"""Columns for fine records: amounts, countries, slugs, regulators."""

from pyspark.sql import Column, functions as F

from ..dims import patterns
from ..dims.domains import COUNTRY_SLUG_SUFFIXES
from ..dims.regulators import FINE_COUNTRY_ALIASES, LETTER_LANGUAGES, REGULATORS
from .addresses import top_level
from .let import let
from .text import capitalized, strip_tags

_LEGAL = patterns.java_any([r"\b(?:" + "|".join(patterns.LEGAL_FORMS) + r")\b"])
_REGION = patterns.java_any([r"\b(?:" + "|".join(patterns.REGION_WORDS) + r")\b"])


def fine_eur(text: Column) -> Column:
    """Last whole number of the text without thousands commas; null when unknown or only intended."""
    lower = F.lower(text)
    digits = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(?s)([0-9]+)[^0-9]*\z", 1)
    return F.when(
        ~lower.contains("unknown") & ~lower.contains("only intention"),
        F.nullif(digits, F.lit("")).try_cast("bigint"))


def country_name(cell: Column) -> Column:
    return capitalized(strip_tags(cell))


def _slug(text: Column) -> Column:
    plain = F.lower(F.regexp_replace(text, r"[,.&+]", " "))
    return F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "-"), r"\A-+|-+\z", "")


def name_slug(name: Column) -> Column:
    """Company name without brackets and legal forms, hyphenated. Country words stay."""
    bare = F.regexp_replace(name, r"\(.*?\)", "")
    return _slug(F.regexp_replace(bare, _LEGAL, " "))


def controller_slug(name: Column) -> Column:
    """As :func:`name_slug`, country words dropped too."""
    bare = F.regexp_replace(name, r"\(.*?\)", "")
    bare = F.regexp_replace(bare, _LEGAL, " ")
    return _slug(F.regexp_replace(bare, _REGION, " "))


def is_country_slug(slug: Column) -> Column:
    """A hyphenated slug that ends in a country code."""
    return (F.instr(slug, "-") > 0) & F.substring_index(slug, "-", -1).isin(COUNTRY_SLUG_SUFFIXES)


def hyphen_prefixes(slug: Column) -> Column:
    """``a-b-c`` -> ``[a, a-b, a-b-c]``: turns a prefix match into an equality join."""
    parts = F.split(slug, "-")
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "-"))


def _of(mapping: dict, key: Column) -> Column:
    """Value of a small constant map; null when the key is absent."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def regulator_of_country(country: Column) -> Column:
    """Regulator country of a fine, null when there is none in the list."""
    key = F.lower(F.trim(country))
    names = {**{r.country.lower(): r.country for r in REGULATORS}, **FINE_COUNTRY_ALIASES}
    return _of(names, key)


def _squeezed(text: Column) -> Column:
    spaces = f"[{patterns.WHITE_SPACE}]+"
    flat = F.regexp_replace(F.lower(text), r"[.,;]", " ")
    return F.trim(F.regexp_replace(flat, spaces, " "))


def regulator_by_address(address: Column, country_or_iso: Column = None) -> Column:
    """Regulator country: by ISO code or country name when given, else by the end of the address.

    The list has eighteen constant rows, so the lookup is a column and needs no join.
    """
    lines = F.filter(
        F.transform(F.split(address, "\n"), lambda x: F.trim(F.regexp_replace(x, f"[{patterns.WHITE_SPACE}]+", " "))),
        lambda x: x != "")
    ends = F.struct(
        _squeezed(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))).alias("last"),
        _squeezed(address).alias("whole"))

    def first_match(e):
        country = F
        for r in REGULATORS:
            words = "|".join(patterns.escape(n) for n in r.names)
            country = country.when(
                e["last"].rlike(rf"(?:\A| )(?:{words})\z") | e["whole"].rlike(rf" (?:{words})\z"), r.country)
        return country

    by_address = let(ends, first_match)
    if country_or_iso is None:
        return by_address
    codes = {code: r.country for r in REGULATORS for code in (r.iso.lower(), r.country.lower())}
    return F.coalesce(_of(codes, F.lower(F.trim(country_or_iso))), by_address)


def regulator_by_tld(domain: Column) -> Column:
    """Regulator country of a domain's top level, null when there is none."""
    return _of({r.tld: r.country for r in REGULATORS}, top_level(domain))


def regulator_language(country: Column) -> Column:
    return _of({r.country: r.language for r in REGULATORS}, country)


REGULATOR_FACTS = ("name", "email", "phone", "address", "complaint_url", "website", "english_ok", "warning")


def regulator_struct(country: Column) -> Column:
    """The contact facts of a regulator country as a struct; its fields are null where there is none."""
    return let(country, lambda c: F.struct(*[
        _of({r.country: getattr(r, field) for r in REGULATORS}, c).alias(field) for field in REGULATOR_FACTS]))


def language_of_domain(domain: Column) -> Column:
    """Letter language of a top-level domain, English when it is not one of the known ones."""
    return let(top_level(domain), lambda tld: F.when(
        tld.isin([c for c in LETTER_LANGUAGES if c != "en"]), tld).otherwise("en"))
