"""The vendor table: keys, companies, names, categories, user status, features."""

from pyspark.sql import DataFrame, functions as F

from ..dims.domains import PERSONAL_DOMAINS
from ..operators import breaches as breach_ops, matching, rollups
from ..operators.rollups import VENDOR

FEATURE_FLAGS = [
    *rollups.FLAGS, "has_unwhitelisted", "has_unwhitelisted_bulk", "has_action",
    "has_unsubscribed_action", "has_actionable_recent_bulk"]
FEATURE_COUNTS = ["message_count", "sender_count", "bulk_count"]


def build_vendors(messages: DataFrame, companies: DataFrame, status: DataFrame = None, senders: DataFrame = None, matched: DataFrame = None) -> DataFrame:
    """Vendor entity from messages: company by domain, name, company by name, category and risk.

    ``senders``: the sender rollup, ``matched``: its :func:`matched_vendors`, both best read from a stored table. Messages themselves are read for
    the subjects of vendors without a company only.
    """
    senders = rollups.sender_rollup(messages) if senders is None else senders
    matched = matched_vendors(senders, companies) if matched is None else matched
    categorized = matching.categorize_unmatched(matched, messages)
    if status is None:
        return categorized.withColumn("status", F.lit(None).cast("string"))
    return categorized.join(status.select(*VENDOR, "status"), VENDOR, "left")


def named_vendors(senders: DataFrame, companies: DataFrame) -> DataFrame:
    """Vendors of the sender rollup with the company of their domain and with their name."""
    names = rollups.names_of(senders)
    base = matching.initial_vendors(names, companies).join(names, VENDOR)
    return base.withColumn(
        "name", F.when(F.col("company_slug").isNull(), F.coalesce("sender_name", "name")).otherwise(F.col("name"))
    ).drop("sender_name")


def matched_vendors(senders: DataFrame, companies: DataFrame, named: DataFrame = None, by_name: DataFrame = None) -> DataFrame:
    """Vendors of the sender rollup with company, name, and the category of the company. ``named``: their :func:`named_vendors`, ``by_name``: the
    :func:`matching.name_matches` of these, both best read from a stored table: the match uses them several times."""
    named = named_vendors(senders, companies) if named is None else named
    return matching.categorize_matched(matching.match_companies(named, companies, by_name), companies)


def with_features(vendors: DataFrame, features: DataFrame, actions: DataFrame) -> DataFrame:
    """Vendors with their features. A vendor that lost all mail keeps its row, cleared, and the
    actions taken on it still count."""
    action_flags = ["has_action", "has_unsubscribed_action"]
    taken = rollups.vendor_actions(actions)
    joined = vendors.join(features.drop(*action_flags), VENDOR, "left").join(taken, VENDOR, "left")
    return joined.fillna(
        {**{f: False for f in FEATURE_FLAGS}, **{c: 0 for c in FEATURE_COUNTS}}
    ).withColumn("is_personal", F.col("vendor_key").isin(PERSONAL_DOMAINS))


def feature_vendors(messages, companies, whitelist, actions, breaches, as_of_ms, status=None, senders=None) -> DataFrame:
    """Everything the vendor queries and the dashboard need, one row per vendor."""
    senders = rollups.sender_rollup(messages) if senders is None else senders
    vendors = build_vendors(messages, companies, status, senders)
    return with_lists(vendors, senders, whitelist, actions, breaches, as_of_ms)


def with_lists(vendors, senders, whitelist, actions, breaches, as_of_ms) -> DataFrame:
    """Vendors with their features and ``on_breach_list``."""
    full = with_features(vendors, rollups.features_of(senders, whitelist, actions, as_of_ms), actions)
    if breaches is None:
        return full.withColumn("on_breach_list", F.lit(False))
    return breach_ops.on_breach_list(full, breaches)
