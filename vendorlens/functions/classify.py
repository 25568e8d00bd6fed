"""Message type and category columns."""

from pyspark.sql import Column, functions as F

from ..dims import patterns
from ..dims.categories import CATEGORIES, RISK_ORDER, by_risk, source_map
from .let import let
from .senders import has_bulk_headers

_ORDER = patterns.java_any(patterns.ORDER)
_TRANSACTIONAL = patterns.java_any(patterns.TRANSACTIONAL)


def message_type(subject: Column, preview: Column, method: Column, url: Column, headers: Column) -> Column:
    """order, transactional, bulk or personal, in that order of precedence.

    Order and account wording goes first, because platforms put list headers on receipts too.
    """
    text = F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(preview, F.lit("")))
    has_url = F.coalesce((url != "") & (method != "") & (method != "none"), F.lit(False))
    return let(text, lambda words: (
        F.when(words.rlike(_ORDER), "order")
        .when(words.rlike(_TRANSACTIONAL), "transactional")
        .when(has_url | has_bulk_headers(headers), "bulk")
        .otherwise("personal")))


def _map_literal(mapping):
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def map_categories(sources: Column, categories=CATEGORIES) -> Column:
    """Source categories to app categories, distinct, in first-seen order; null stays empty."""
    lookup = _map_literal(source_map(categories))
    mapped = F.transform(sources, lambda s: F.try_element_at(lookup, s))
    none = F.expr("array()").cast("array<string>")
    return F.coalesce(F.array_distinct(F.filter(mapped, lambda c: c.isNotNull())), none)


def riskiest_category(company_categories: Column, categories=CATEGORIES, app_categories=False) -> Column:
    """``struct<prio, rank, category, risk>`` of the highest-risk known category; first wins ties.

    Companies keep app categories while the lookup knows source categories, so by default only
    names that are both ("financial", "healthcare", "government", "entertainment") count.
    ``app_categories=True`` accepts either kind.
    """
    known = {}
    for c in categories:
        for name in (*c.sources, *((c.name,) if app_categories else ())):
            known[name.lower()] = c
    name_of = _map_literal({n: c.name for n, c in known.items()})
    risk_of = _map_literal({n: c.risk for n, c in known.items()})
    prio_of = _map_literal({n: RISK_ORDER[c.risk] for n, c in known.items()})
    ranked = F.transform(company_categories, lambda s, i: F.struct(
        F.try_element_at(prio_of, F.lower(s)).alias("prio"),
        (-i).alias("rank"),
        F.try_element_at(name_of, F.lower(s)).alias("category"),
        F.try_element_at(risk_of, F.lower(s)).alias("risk")))
    return F.array_max(F.filter(ranked, lambda r: r["prio"].isNotNull()))


def keyword_category(haystack: Column, categories=CATEGORIES) -> Column:
    """``struct<category, risk>`` of the first category, from high to low risk, with a keyword in the text."""
    def first_hit(text):
        category = F
        for c in by_risk(categories):
            hit = text.rlike("|".join(patterns.escape(k.lower()) for k in c.keywords))
            category = category.when(hit, c.name)
        return category.otherwise("unknown")

    risk_of = _map_literal({**{c.name: c.risk for c in categories}, "unknown": "unknown"})
    return let(let(F.lower(haystack), first_hit), lambda category: F.struct(
        category.alias("category"), F.try_element_at(risk_of, category).alias("risk")))


def category_label(category: Column, categories=CATEGORIES) -> Column:
    return F.try_element_at(_map_literal({c.name: c.label for c in categories}), category)


def category_icon(category: Column, categories=CATEGORIES) -> Column:
    return F.try_element_at(_map_literal({c.name: c.icon for c in categories}), category)


def effective_category(category: Column, has_orders: Column, has_account: Column) -> Column:
    """Unknown shows as shopping when there are orders, as services when there is an account."""
    category = F.coalesce(category, F.lit("unknown"))
    return (
        F.when(category != "unknown", category)
        .when(has_orders, "shopping")
        .when(has_account, "services")
        .otherwise(category))
