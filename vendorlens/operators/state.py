"""State changes as table-to-table transforms."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import addresses

ID = ["account_id", "message_id"]
VENDOR = ["account_id", "vendor_key"]


def first_writes(batch: DataFrame, order="arrival") -> DataFrame:
    """First row per message id, by arrival. Copies of one id are cut per partition first."""
    rank = F.row_number().over(Window.partitionBy(*ID).orderBy(order))
    return batch.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def append_new(messages: DataFrame, batch: DataFrame, order="arrival") -> DataFrame:
    """Messages plus the rows of a batch whose id is new; the first write of an id wins."""
    return messages.unionByName(new_rows(messages, batch, order))


def new_rows(messages: DataFrame, batch: DataFrame, order="arrival") -> DataFrame:
    """Rows of a batch whose id is not stored yet.

    The stored ids are first cut to those of the batch, with the batch as the small side, so the
    large table is scanned for two columns and not shuffled for the anti join.
    """
    fresh = first_writes(batch, order).drop(order)
    seen = messages.select(*ID).join(batch.select(*ID).distinct(), ID, "left_semi")
    return fresh.join(seen.distinct(), ID, "left_anti")


def delete_ids(messages: DataFrame, ids: DataFrame) -> DataFrame:
    return messages.join(ids.select(*ID).distinct(), ID, "left_anti")


def delete_by_vendor(messages: DataFrame, keys: DataFrame, types=None):
    """(messages left, removed messages and bytes per vendor)."""
    wanted = keys.select(*VENDOR).distinct().withColumn("_listed", F.lit(True))
    flagged = messages.join(wanted, VENDOR, "left")
    hit = F.col("_listed").isNotNull()
    if types:
        hit = hit & F.coalesce(F.col("type").isin(list(types)), F.lit(False))
    removed = flagged.filter(hit).groupBy(*VENDOR).agg(
        F.count(F.lit(1)).alias("message_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))
    return flagged.filter(~hit).drop("_listed"), removed


def delete_vendors(vendors: DataFrame, messages: DataFrame, actions: DataFrame, keys: DataFrame):
    """Vendors without the listed ones, and messages and actions without theirs."""
    gone = keys.select(*VENDOR).distinct()
    return (
        vendors.join(gone, VENDOR, "left_anti"),
        messages.join(gone, VENDOR, "left_anti"),
        actions.join(gone, VENDOR, "left_anti"))


def mark_unsubscribed(messages: DataFrame, keys: DataFrame, by="vendor_key") -> DataFrame:
    """Sets the status of messages with an opt-out URL, of the listed vendors or senders."""
    on = ["account_id", by]
    listed = keys.select(*on).distinct().withColumn("_listed", F.lit(True))
    hit = F.col("_listed").isNotNull() & F.col("unsubscribe_url").isNotNull()
    return (
        messages.join(listed, on, "left")
        .withColumn("status", F.when(hit, "unsubscribed").otherwise(F.col("status"))).drop("_listed"))


def unsubscribe_actions(messages: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """The log rows of unsubscribing whole vendors: one per vendor with any opt-out URL."""
    listed = keys.select(*VENDOR).distinct()
    hit = messages.filter("unsubscribe_url IS NOT NULL").join(listed, VENDOR, "left_semi")
    return (
        hit.groupBy(*VENDOR).agg(
            F.count(F.lit(1)).alias("message_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))
        .select(
            "account_id", F.concat_ws(":", F.lit("unsub"), F.lit(now_ms), *VENDOR).alias("action_id"),
            "vendor_key", F.lit("unsubscribed").alias("action_type"),
            F.lit(None).cast("string").alias("sender_email"), F.lit(None).cast("string").alias("unsubscribe_url"),
            "message_count", "size_bytes", F.lit(now_ms).cast("bigint").alias("actioned_at")))


def append_actions(actions: DataFrame, rows: DataFrame) -> DataFrame:
    """The log plus new rows, their URL cut to origin and path."""
    trimmed = F.nullif(F.col("unsubscribe_url"), F.lit(""))
    return actions.unionByName(rows.withColumn("unsubscribe_url", addresses.strip_query(trimmed)))


def set_status(df: DataFrame, changes: DataFrame, on) -> DataFrame:
    """Applies user status changes; a listed null clears the status."""
    listed = changes.select(*on, F.col("status").alias("_new")).withColumn("_listed", F.lit(True))
    return (
        df.join(listed, list(on), "left")
        .withColumn("status", F.when(F.col("_listed"), F.col("_new")).otherwise(F.col("status")))
        .drop("_new", "_listed"))


def reset_accounts(tables: dict, accounts: DataFrame) -> dict:
    """Every table without the rows of the listed accounts."""
    gone = accounts.select("account_id").distinct()
    return {name: df.join(gone, "account_id", "left_anti") for name, df in tables.items()}


def net_changes(feed: DataFrame) -> DataFrame:
    """Ordered change feed to its last operation per message id."""
    return feed.groupBy(*ID).agg(F.max(F.struct("seq", "op")).alias("v")).select(*ID, "v.op")


def net_plain_changes(feed: DataFrame) -> DataFrame:
    """Unordered added/deleted feed: adds are applied, then deletes, so a deleted id stays deleted."""
    return feed.groupBy(*ID).agg(
        F.when(F.bool_or(F.col("op") == "delete"), "delete").otherwise("add").alias("op"))
