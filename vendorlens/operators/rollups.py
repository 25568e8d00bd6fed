"""Vendor rollups. Messages are read once and reduced to one row per sender; whitelist coverage
and every flag are decided on that small table, then summed up per vendor."""

from pyspark.sql import DataFrame, functions as F

from .whitelist import with_coverage

VENDOR = ["account_id", "vendor_key"]
RECENT_MS = 63_115_200_000  # 2 x 365.25 days

FLAGS = ["has_marketing", "has_account", "has_orders", "has_nonpersonal", "has_rfc8058", "has_active_bulk"]


def sender_rollup(messages: DataFrame) -> DataFrame:
    """One row per account, vendor and sender. Partial aggregation runs before the only shuffle.

    ``recent_ms`` is the newest bulk message that can still be opted out of, ``named`` the newest
    non-empty sender name, bulk mail first. Rollups of parts of the mail add up: :func:`merged`.
    """
    kind = F.col("type")
    bulk = F.coalesce(kind == "bulk", F.lit(False))
    open_ = F.col("status").isNull() | (F.col("status") != "unsubscribed")
    leavable = bulk & open_ & F.coalesce(F.col("unsubscribe_method") != "none", F.lit(False))
    named = F.struct(bulk.alias("bulk"), "date_ms", "message_id", "sender_name")
    return messages.groupBy(*VENDOR, "sender_email").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.count_if(bulk).alias("bulk_count"),
        F.sum("size_bytes").alias("size_bytes"),
        F.min("date_ms").alias("first_seen"),
        F.max("date_ms").alias("last_seen"),
        F.bool_or(bulk).alias("has_marketing"),
        F.bool_or(F.coalesce(kind.isin("transactional", "order"), F.lit(False))).alias("has_account"),
        F.bool_or(F.coalesce(kind == "order", F.lit(False))).alias("has_orders"),
        F.bool_or(kind.isNull() | (kind != "personal")).alias("has_nonpersonal"),
        F.bool_or(F.coalesce(F.col("unsubscribe_method") == "rfc8058", F.lit(False))).alias("has_rfc8058"),
        F.bool_or(bulk & open_).alias("has_active_bulk"),
        F.max(F.when(leavable, F.col("date_ms"))).alias("recent_ms"),
        F.max(F.when(F.col("sender_name") != "", named)).alias("named"))


def merged(senders: DataFrame) -> DataFrame:
    """Rollups of disjoint sets of messages as one."""
    return senders.groupBy(*VENDOR, "sender_email").agg(
        *[F.sum(c).alias(c) for c in ("message_count", "bulk_count", "size_bytes")],
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        *[F.bool_or(c).alias(c) for c in FLAGS],
        F.max("recent_ms").alias("recent_ms"), F.max("named").alias("named"))


def counts():
    return [
        F.sum("message_count").alias("message_count"),
        F.count(F.lit(1)).alias("sender_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen")]


def on_stored_vendors(rollup: DataFrame, vendors: DataFrame, flags=(), counts=()) -> DataFrame:
    """Rollup laid over the stored vendor keys: a vendor without messages stays, cleared."""
    kept = vendors.select(*VENDOR).distinct().join(rollup, VENDOR, "left")
    return kept.fillna({**{f: False for f in flags}, **{c: 0 for c in counts}})


def vendor_stats(messages: DataFrame, vendors: DataFrame = None) -> DataFrame:
    """Messages, distinct senders, first and last seen per vendor."""
    stats = sender_rollup(messages).groupBy(*VENDOR).agg(*counts())
    if vendors is None:
        return stats
    return on_stored_vendors(stats, vendors, counts=["message_count", "sender_count"])


def vendor_flags(messages: DataFrame, vendors: DataFrame = None) -> DataFrame:
    """Has marketing, has account."""
    names = ["has_marketing", "has_account"]
    flags = sender_rollup(messages).groupBy(*VENDOR).agg(*[F.bool_or(n).alias(n) for n in names])
    return flags if vendors is None else on_stored_vendors(flags, vendors, flags=names)


def vendor_features(messages: DataFrame, whitelist: DataFrame, actions: DataFrame, as_of_ms: int) -> DataFrame:
    """Counts and every yes/no property the vendor queries ask for, in one pass over messages."""
    return features_of(sender_rollup(messages), whitelist, actions, as_of_ms)


def features_of(senders: DataFrame, whitelist: DataFrame, actions: DataFrame, as_of_ms: int) -> DataFrame:
    """:func:`vendor_features` from the sender rollup."""
    flagged = with_coverage(senders.drop("named"), whitelist, [*VENDOR, "sender_email"])
    free = ~F.col("covered")
    recent = F.coalesce(F.col("recent_ms") > as_of_ms - RECENT_MS, F.lit(False))
    vendors = flagged.groupBy(*VENDOR).agg(
        *counts(),
        F.sum("bulk_count").alias("bulk_count"),
        *[F.bool_or(n).alias(n) for n in FLAGS],
        F.bool_or(free).alias("has_unwhitelisted"),
        F.bool_or(free & F.col("has_active_bulk")).alias("has_unwhitelisted_bulk"),
        F.bool_or(free & recent).alias("_recent"))
    taken = vendor_actions(actions)
    return (
        vendors.join(taken, VENDOR, "left")
        .fillna({"has_action": False, "has_unsubscribed_action": False})
        .withColumn("has_actionable_recent_bulk", F.col("_recent") & ~F.col("has_unsubscribed_action"))
        .drop("_recent"))


def vendor_actions(actions: DataFrame) -> DataFrame:
    """One row per vendor with any user action."""
    return actions.groupBy(*VENDOR).agg(
        F.lit(True).alias("has_action"),
        F.bool_or(F.col("action_type") == "unsubscribed").alias("has_unsubscribed_action"))


def vendor_names(messages: DataFrame) -> DataFrame:
    """Newest non-empty sender name per vendor, bulk mail first."""
    return names_of(sender_rollup(messages)).filter("sender_name IS NOT NULL")


def names_of(senders: DataFrame) -> DataFrame:
    """Every vendor of the sender rollup with its name, null where no sender has one."""
    return senders.groupBy(*VENDOR).agg(F.max("named").alias("n")).select(*VENDOR, F.col("n.sender_name").alias("sender_name"))


def sender_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy(*VENDOR, "sender_email", "sender_name").agg(F.count(F.lit(1)).alias("message_count"))


def bulk_count(messages: DataFrame) -> DataFrame:
    return messages.groupBy(*VENDOR).agg(F.count_if(F.col("type") == "bulk").alias("bulk_count"))


def action_volume(messages: DataFrame, types=None, with_url=False) -> DataFrame:
    """Messages and bytes a bulk action on a vendor would touch."""
    hit = messages
    if types:
        hit = hit.filter(F.col("type").isin(list(types)))
    if with_url:
        hit = hit.filter(F.col("unsubscribe_url").isNotNull())
    return hit.groupBy(*VENDOR).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))


def totals(messages: DataFrame) -> DataFrame:
    """Messages and vendors per account."""
    return (
        messages.groupBy(*VENDOR).agg(F.count(F.lit(1)).alias("n"))
        .groupBy("account_id")
        .agg(F.sum("n").alias("message_count"), F.count(F.lit(1)).alias("vendor_count")))


def touched_vendors(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct vendors of a set of (account_id, message_id)."""
    return messages.join(ids.select("account_id", "message_id").distinct(),
                         ["account_id", "message_id"], "left_semi").select(*VENDOR).distinct()


def vendors_by_sender(vendors: DataFrame, messages: DataFrame, emails: DataFrame) -> DataFrame:
    """Vendors that sent mail from one of the listed addresses."""
    hits = messages.select(*VENDOR, "sender_email", "message_id").join(emails.select("sender_email").distinct(), "sender_email", "left_semi")
    return vendors.join(hits.select(*VENDOR).distinct(), VENDOR, "left_semi")
