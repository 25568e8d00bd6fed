"""The vendor list query: filters become columns, folded over the feature table."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import signals
from ..functions.text import ascii_lower
from ..functions.dates import DAY_MS
from ..functions.signals import SENSITIVE
from ..operators import breaches as breach_ops
from ..operators.topk import page_of

# Days since last seen and message counts of the named filters, both ends included.
ACTIVITY = {"recent": (0, 90), "active": (90, 365), "inactive": (365, 730), "stale": (730, None), "dead": (1825, None)}
VOLUME = {"oneoff": (0, 5), "low": (6, 25), "medium": (26, 100), "high": (101, None)}
SORTS = ["message_count", "last_seen", "name", "vendor_key", "risk"]


@dataclass(frozen=True)
class VendorQuery:
    page: int = 1
    limit: int = 50
    sort_by: str = "message_count"
    sort_dir: str = "DESC"
    search: str = None
    category: str = None
    risk: str = None
    show_reviewed: bool = False
    has_account: bool = False
    filter: str = None            # all | lists | accounts
    activity: str = None
    data_type: str = None         # has_orders | has_account | marketing_only
    volume: str = None
    max_messages: int = None
    on_breach_list: bool = False
    active_subscriptions: bool = False
    show_whitelisted: bool = False

    def __post_init__(self):
        if not 1 <= self.page <= 1_000_000:
            raise ValueError("page out of range")
        if not 1 <= self.limit <= 500:
            raise ValueError("limit out of range")


# Saved filter sets of the account and mail lists.
PRESETS = {
    "highrisk": dict(filter="accounts", risk="high"),
    "onetime": dict(filter="accounts", data_type="has_orders", volume="oneoff"),
    "breached": dict(filter="accounts", on_breach_list=True, sort_by="risk", sort_dir="ASC"),
    "oldaccounts": dict(filter="accounts", risk="high", activity="stale"),
    "oldorders": dict(filter="accounts", data_type="has_orders", activity="stale"),
    "mail_whitelisted": dict(filter="lists", show_whitelisted=True),
    "mail_priorities": dict(filter="lists", active_subscriptions=True),
    "mail_breached": dict(filter="lists", on_breach_list=True),
}


def preset(name: str, **changes) -> VendorQuery:
    return VendorQuery(**{**PRESETS[name], **changes})


def risk_predicate(level: str) -> Column:
    """Risk filter. It leaves out vendors of unknown category, which the computed risk calls medium;
    a value that is no level selects everything."""
    category, account = F.col("category_id"), F.col("has_account")
    high = F.col("has_orders") | (category.isin(SENSITIVE) & account)
    soft = category.isin("social", "marketing")
    if level == "high":
        found = high
    elif level == "medium":
        found = ~high & (category.isin(*SENSITIVE, "shopping", "communication", "services") | (soft & account))
    elif level == "low":
        found = ~high & ((category == "entertainment") | (soft & ~account))
    else:
        return F.lit(True)
    return F.coalesce(found, F.lit(False))


def _within(value: Column, bounds) -> Column:
    low, high = bounds
    inside = value >= low if high is None else value.between(low, high)
    return F.coalesce(inside, F.lit(False))


def activity_predicate(name: str, as_of_ms: int) -> Column:
    if name not in ACTIVITY:
        return F.lit(True)
    return _within((F.lit(as_of_ms) - F.col("last_seen")) / float(DAY_MS), ACTIVITY[name])


def volume_predicate(name: str) -> Column:
    return _within(F.col("message_count"), VOLUME[name]) if name in VOLUME else F.lit(True)


def datatype_predicate(name: str) -> Column:
    if name == "has_orders":
        return F.col("has_orders")
    if name == "has_account":
        return F.col("has_account")
    if name == "marketing_only":
        return F.col("has_marketing") & ~F.col("has_account")
    return F.lit(True)


def search_predicate(term: str) -> Column:
    """ASCII case-insensitive substring of name or key; ``%`` and ``_`` are plain characters."""
    needle = ascii_lower(F.lit(term.strip()))
    return F.coalesce(F.contains(ascii_lower(F.col("name")), needle), F.lit(False)) | F.contains(
        ascii_lower(F.col("vendor_key")), needle)


def active_subscriptions() -> Column:
    """Recent bulk mail with an opt-out method, not acted on and not whitelisted."""
    return F.col("has_actionable_recent_bulk")


def _reviewed() -> Column:
    return F.coalesce(F.col("status") == "reviewed", F.lit(False))


def whitelist_view(show: bool, breach_bypass: bool = False) -> Column:
    """``show``: only vendors whose every sender is whitelisted and that were not acted on.
    Otherwise vendors with a sender that is not, or that were acted on."""
    if show:
        return ~F.col("has_unwhitelisted") & ~_reviewed() & ~F.col("has_action")
    return F.col("has_unwhitelisted") | _actioned(breach_bypass)


def _actioned(breach_bypass: bool) -> Column:
    acted = _reviewed() | F.col("has_action")
    return acted | F.col("on_breach_list") if breach_bypass else acted


def predicates(q: VendorQuery, as_of_ms: int):
    """Only the conditions the query asks for, plus the ones that always hold."""
    found = [_reviewed() if q.show_reviewed else ~_reviewed()]
    if q.category:
        found.append(F.coalesce(F.col("category_id") == q.category, F.lit(False)))
    if q.risk:
        found.append(risk_predicate(q.risk))
    if q.search and q.search.strip():
        found.append(search_predicate(q.search))
    if q.has_account or q.filter == "accounts":
        found.append(F.col("has_account") | F.col("on_breach_list"))
    if q.filter == "lists":
        found += [F.col("has_marketing"), F.col("has_active_bulk")]
    if q.activity:
        found.append(activity_predicate(q.activity, as_of_ms))
    if q.data_type:
        found.append(datatype_predicate(q.data_type))
    if q.volume:
        found.append(volume_predicate(q.volume))
    if q.max_messages is not None:
        found.append(F.col("message_count") <= q.max_messages)
    if q.on_breach_list:
        found.append(F.col("on_breach_list"))
    if q.active_subscriptions:
        found.append(active_subscriptions())
    found.append(~F.col("is_personal"))
    found.append(F.col("has_nonpersonal") | _actioned(q.on_breach_list))
    found.append(whitelist_view(q.show_whitelisted, q.on_breach_list))
    return found


def select_vendors(vendors: DataFrame, q: VendorQuery, as_of_ms: int) -> DataFrame:
    """All vendors the query selects, with computed risk."""
    risk = signals.computed_risk(F.col("category_id"), F.col("has_orders"), F.col("has_account"))
    return vendors.filter(reduce(lambda a, b: a & b, predicates(q, as_of_ms))).withColumn("risk_level", risk)


def sort_columns(q: VendorQuery):
    """Sort of the page, as pairs (column, falling). The vendor key settles ties, so pages do not overlap."""
    by = q.sort_by if q.sort_by in SORTS else "message_count"
    down = q.sort_dir != "ASC"
    if by == "risk":
        rank = signals.risk_rank(F.col("category_id"), F.col("has_orders"), F.col("has_account"))
        return [(rank, down), ("message_count", True), ("vendor_key", False)]
    return [(by, down)] if by == "vendor_key" else [(by, down), ("vendor_key", False)]


def vendor_page(vendors: DataFrame, q: VendorQuery) -> DataFrame:
    """One page per account. The rank filter lets Spark drop rows before the shuffle."""
    return page_of(vendors, ["account_id"], sort_columns(q), q.page, q.limit)


def vendor_query(vendors: DataFrame, q: VendorQuery, as_of_ms: int) -> DataFrame:
    """Page of the selected vendors with the account's ``total``."""
    selected = select_vendors(vendors, q, as_of_ms)
    total = selected.groupBy("account_id").agg(F.count(F.lit(1)).alias("total"))
    return vendor_page(selected, q).join(total, "account_id")


def page_breaches(page: DataFrame, breaches: DataFrame) -> DataFrame:
    """The breaches of a page's vendors, a row each, with ``likely_affected``. One join instead of a
    query per vendor; rows rather than lists, because the breaches of one domain have no bound."""
    info = breach_ops.breach_info(
        page.select("account_id", "vendor_key", "first_seen"), breaches.withColumnRenamed("name", "breach_name"))
    return info.select(
        "account_id", "vendor_key", "breach_name", "domain", "breach_date", "pwn_count", "data_classes", "likely_affected")
