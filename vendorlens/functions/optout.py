"""Opt-out links: list header, one-click, footer of the body."""

from pyspark.sql import Column, functions as F

from ..dims import patterns
from .let import let
from .senders import header_value
from .text import js_trim

_SPACE = patterns.WHITE_SPACE
_ANCHOR = rf"""(?is)<a[{_SPACE}][^>]*?href[{_SPACE}]*=[{_SPACE}]*["']([^"']+)["'][^>]*>(.*?)</a>"""
_TEXT = patterns.java_any(patterns.OPT_OUT_TEXT)
_URL = patterns.java_any([patterns.escape(p) for p in patterns.OPT_OUT_URL])
_ONE_CLICK = rf"(?i)List-Unsubscribe[{_SPACE}]*=[{_SPACE}]*One-Click"
_FORWARDED = rf"(?i)\A[{_SPACE}]*(?:{'|'.join(patterns.FORWARDED_PREFIXES)})[{_SPACE}]*:"


def list_unsubscribe_url(header: Column) -> Column:
    """Best URL of a list header: https, then http, then mailto; null when none."""
    return let(header, lambda raw: let(
        F.regexp_extract_all(raw, F.lit("<([^>]+)>"), F.lit(1)),
        lambda found: let(F.when(F.size(found) > 0, found).otherwise(F.array(raw)), _best_url)))


def _best_url(urls: Column) -> Column:
    def first(prefix):
        return F.try_element_at(F.filter(urls, lambda u: F.startswith(u, F.lit(prefix))), F.lit(1))

    return F.coalesce(first("https://"), first("http://"), first("mailto:"))


def is_one_click(list_header: Column, post_header: Column) -> Column:
    """The post header asks for one-click and the chosen URL is https."""
    return F.coalesce(
        post_header.rlike(_ONE_CLICK)
        & F.startswith(list_unsubscribe_url(list_header), F.lit("https://")),
        F.lit(False))


def footer_unsubscribe_url(html: Column) -> Column:
    """First opt-out link of the last fifth of the HTML; link text goes before URL."""
    footer = F.substr(html, F.floor(F.length(html) * F.lit(0.8)).cast("int") + 1)
    anchors = F.regexp_extract_all(footer, F.lit(_ANCHOR), F.lit(0))
    links = F.filter(
        F.transform(anchors, lambda a: F.struct(
            F.regexp_extract(a, _ANCHOR, 1).alias("href"),
            F.regexp_extract(a, _ANCHOR, 2).alias("text"))),
        lambda a: F.startswith(a["href"], F.lit("http")))
    return let(links, _opt_out_link)


def _opt_out_link(links: Column) -> Column:
    by_text = F.filter(
        links, lambda a: js_trim(F.regexp_replace(a["text"], "<[^>]*>", "")).rlike(_TEXT))
    by_url = F.filter(links, lambda a: a["href"].rlike(_URL))
    return F.coalesce(
        F.try_element_at(by_text, F.lit(1))["href"], F.try_element_at(by_url, F.lit(1))["href"])


def is_forwarded(subject: Column) -> Column:
    return F.coalesce(subject.rlike(_FORWARDED), F.lit(False))


def resolve_unsubscribe(list_header: Column, post_header: Column, html: Column, subject: Column) -> Column:
    """``struct<method, url>`` by priority: one-click, list header, footer, none."""
    wants_post = F.coalesce(post_header.rlike(_ONE_CLICK), F.lit(False))
    footer = F.when(~is_forwarded(subject), footer_unsubscribe_url(html))
    return let(list_unsubscribe_url(list_header), lambda listed: F.when(
        listed.isNotNull(),
        F.struct(
            F.when(wants_post & F.startswith(listed, F.lit("https://")), "rfc8058")
            .otherwise("list-unsubscribe").alias("method"),
            listed.alias("url"))
    ).otherwise(let(footer, lambda url: F.struct(
        F.when(url.isNotNull(), "footer").otherwise("none").alias("method"), url.alias("url")))))


def resolve_from_headers(headers: Column, html: Column, subject: Column) -> Column:
    """Same, from a header list."""
    return resolve_unsubscribe(
        header_value(headers, "list-unsubscribe"), header_value(headers, "list-unsubscribe-post"),
        html, subject)
