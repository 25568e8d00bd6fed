"""State changes."""

from pyspark.sql import functions as F

from ..operators import rewrite, state, whitelist
from ..sources.scratch import scratch_path
from ..sources.sinks import write_table
from . import tables as t
from .ctes import sql
from .joins import KEYS
from .registry import register

ID = ["account_id", "message_id"]


def number():
    return F.substring("message_id", 2, 20).cast("bigint")


def listed_vendors(spark, sf):
    """Vendors named by the customers of one market segment."""
    return t.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("a"), F.col("c_custkey") % 3).alias("account_id"),
        F.concat(F.lit("shop"), "c_custkey", F.lit(".com")).alias("vendor_key"))


LISTED = """(SELECT DISTINCT concat('a', c_custkey % 3) AS account_id, concat('shop', c_custkey, '.com') AS vendor_key
  FROM customer WHERE c_mktsegment = 'BUILDING')"""


@register("upsert_messages", sql("messages", """
SELECT account_id, message_id, CASE WHEN type = 'bulk' THEN concat('copy ', event_id) ELSE subject END AS subject FROM messages"""))
def upsert_messages(spark, sf):
    messages = t.messages(spark, sf)
    every = messages.select(*ID, "subject")
    stored = messages.filter("type <> 'bulk'").select(*ID, "subject")
    copies = every.withColumn("subject", F.concat(F.lit("copy "), number())).withColumn("arrival", F.lit(1))
    again = every.withColumn("subject", F.lit("later")).withColumn("arrival", F.lit(2))
    return state.append_new(stored, copies.unionByName(again))


@register("delete_messages", sql("messages", "SELECT account_id, message_id FROM messages WHERE type <> 'order'"))
def delete_messages(spark, sf):
    ids = t.events(spark, sf).filter("event_type = 'purchase'").select(
        t.account().alias("account_id"), F.concat(F.lit("m"), "event_id").alias("message_id"))
    return state.delete_ids(t.messages(spark, sf), ids).select(*ID)


@register("delete_vendor_messages", sql("messages", f"""
SELECT account_id, vendor_key, count(*) FILTER (hit) AS message_count, CAST(coalesce(sum(size_bytes) FILTER (hit), 0) AS BIGINT) AS size_bytes,
  count(*) FILTER (NOT hit) AS kept FROM (SELECT *, type = 'bulk' AND (account_id, vendor_key) IN (SELECT (account_id, vendor_key) FROM {LISTED}) AS hit
  FROM messages) GROUP BY 1, 2"""))
def delete_vendor_messages(spark, sf):
    kept, removed = state.delete_by_vendor(t.messages(spark, sf), listed_vendors(spark, sf), ["bulk"])
    left = kept.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("kept"))
    return left.join(removed, KEYS, "full").fillna(0)


@register("delete_vendor_cascade", sql("vendors actions", f"""
WITH gone AS {LISTED}
SELECT 'vendors' AS name, count(*) AS n FROM vendors WHERE (account_id, vendor_key) NOT IN (SELECT (account_id, vendor_key) FROM gone)
UNION ALL SELECT 'messages', count(*) FROM messages WHERE (account_id, vendor_key) NOT IN (SELECT (account_id, vendor_key) FROM gone)
UNION ALL SELECT 'actions', count(*) FROM actions WHERE (account_id, vendor_key) NOT IN (SELECT (account_id, vendor_key) FROM gone)""").replace(
    ") WITH gone AS", "), gone AS", 1))
def delete_vendor_cascade(spark, sf):
    left = state.delete_vendors(
        t.vendors(spark, sf), t.messages(spark, sf), t.actions(spark, sf), listed_vendors(spark, sf))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
              for name, df in zip(("vendors", "messages", "actions"), left)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register("mark_unsubscribed", sql("messages", f"""
SELECT account_id, message_id, CASE WHEN unsubscribe_url IS NOT NULL AND (account_id, vendor_key) IN (SELECT (account_id, vendor_key) FROM {LISTED})
  THEN 'unsubscribed' ELSE status END AS status, CAST(NULL AS BIGINT) AS message_count, CAST(NULL AS BIGINT) AS size_bytes FROM messages
UNION ALL SELECT account_id, vendor_key, 'action', count(*), CAST(sum(size_bytes) AS BIGINT) FROM messages
WHERE unsubscribe_url IS NOT NULL AND (account_id, vendor_key) IN (SELECT (account_id, vendor_key) FROM {LISTED}) GROUP BY 1, 2"""))
def mark_unsubscribed(spark, sf):
    messages, keys = t.messages(spark, sf), listed_vendors(spark, sf)
    marked = state.mark_unsubscribed(messages, keys).select(*ID, "status")
    logged = state.unsubscribe_actions(messages, keys, t.AS_OF_MS).select(
        "account_id", F.col("vendor_key").alias("message_id"), F.lit("action").alias("status"), "message_count", "size_bytes")
    return marked.unionByName(logged, allowMissingColumns=True)


@register("mark_unsubscribed_senders", sql("messages", """
SELECT account_id, message_id, CASE WHEN unsubscribe_url IS NOT NULL AND sender_email LIKE 'hi@shop%' THEN 'unsubscribed' ELSE status END AS status
FROM messages"""))
def mark_unsubscribed_senders(spark, sf):
    messages = t.messages(spark, sf)
    keys = messages.filter("sender_email LIKE 'hi@shop%'").select("account_id", "sender_email")
    return state.mark_unsubscribed(messages, keys, by="sender_email").select(*ID, "status")


@register("mark_reviewed", sql("vendors", """
SELECT account_id, vendor_key, CASE WHEN has_orders AND message_count % 2 = 0 THEN 'reviewed' WHEN has_orders THEN NULL ELSE status END AS status
FROM vendors"""))
def mark_reviewed(spark, sf):
    vendors = t.vendors(spark, sf)
    changes = vendors.filter("has_orders").select(
        *KEYS, F.when(F.col("message_count") % 2 == 0, "reviewed").alias("status"))
    return state.set_status(vendors, changes, KEYS).select(*KEYS, "status")


@register("append_action", sql("messages actions", """
SELECT action_id, unsubscribe_url FROM (SELECT action_id, NULL AS unsubscribe_url FROM actions
UNION ALL SELECT message_id, split_part(unsubscribe_url, '?', 1) FROM messages WHERE unsubscribe_url IS NOT NULL)"""))
def append_action(spark, sf):
    rows = t.messages(spark, sf).filter("unsubscribe_url IS NOT NULL").select(
        "account_id", F.col("message_id").alias("action_id"), "vendor_key", F.lit("unsubscribed").alias("action_type"),
        "sender_email", "unsubscribe_url", F.lit(1).cast("bigint").alias("message_count"), "size_bytes",
        F.lit(t.AS_OF_MS).alias("actioned_at"))
    return state.append_actions(t.actions(spark, sf), rows).select("action_id", "unsubscribe_url")


@register("edit_whitelist", sql("whitelist messages", """
SELECT account_id, value FROM whitelist WHERE value <> 'zendesk.com'
UNION SELECT account_id, sender_email FROM messages WHERE sender_email LIKE 'info@bank%'"""))
def edit_whitelist(spark, sf):
    entries = t.whitelist(spark, sf)
    add = t.messages(spark, sf).filter("sender_email LIKE 'info@bank%'").select(
        "account_id", F.upper("sender_email").alias("value"), F.timestamp_millis("date_ms").alias("created_at"))
    remove = entries.filter("value = 'zendesk.com'").select("account_id", F.upper("value").alias("value"))
    return whitelist.edit_whitelist(entries, add, remove).select("account_id", "value")


@register("account_reset", sql("vendors", """
SELECT account_id, 'messages' AS name, count(*) AS n FROM messages WHERE account_id <> 'a1' GROUP BY 1
UNION ALL SELECT account_id, 'vendors', count(*) FROM vendors WHERE account_id <> 'a1' GROUP BY 1"""))
def account_reset(spark, sf):
    gone = t.accounts(spark, sf).filter("account_id = 'a1'")
    left = state.reset_accounts(
        {"messages": t.messages(spark, sf), "vendors": t.vendors(spark, sf)}, gone)
    counts = [df.groupBy("account_id").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name)) for name, df in left.items()]
    return counts[0].unionByName(counts[1])


PARTITION = ["bucket", "year"]


def message_table(spark, sf):
    """(path, schema) of the messages in partitions of account and year, to be changed in place."""
    path = scratch_path(spark, "message-table")
    rows = t.messages(spark, sf).select(*ID, "vendor_key", "type", "status", "size_bytes", "unsubscribe_url", "date_ms")
    rows = rows.withColumns({"bucket": F.substring("account_id", 2, 9).cast("int"), "year": F.year(F.timestamp_millis("date_ms"))})
    write_table(rows, path, PARTITION)
    return path, rows.schema


@register("delete_messages_stored", sql("messages", f"""
SELECT account_id, message_id, type FROM messages WHERE type <> 'order' AND NOT (type = 'bulk' AND (account_id, vendor_key) IN (SELECT (account_id, vendor_key) FROM {LISTED}))
  AND account_id <> 'a1'"""))
def delete_messages_stored(spark, sf):
    """Deletions by id and by vendor, and the reset of an account, in place."""
    path, schema = message_table(spark, sf)
    ids = t.events(spark, sf).filter("event_type = 'purchase'").select(
        t.account().alias("account_id"), F.concat(F.lit("m"), "event_id").alias("message_id"))
    rewrite.delete_ids(spark, path, schema, PARTITION, ids)
    rewrite.delete_by_vendor(spark, path, schema, PARTITION, listed_vendors(spark, sf), ["bulk"])
    rewrite.reset_accounts(spark, path, schema, PARTITION, t.accounts(spark, sf).filter("account_id = 'a1'"))
    return spark.read.schema(schema).parquet(path).select(*ID, "type")


@register("mark_messages_stored", sql("messages", f"""
SELECT account_id, message_id, CASE WHEN event_id % 7 = 0 THEN 'seen' WHEN unsubscribe_url IS NOT NULL AND (account_id, vendor_key) IN (SELECT (account_id, vendor_key) FROM {LISTED})
  THEN 'unsubscribed' ELSE status END AS status FROM messages"""))
def mark_messages_stored(spark, sf):
    """Marks by vendor, then statuses by id, in place."""
    path, schema = message_table(spark, sf)
    rewrite.mark_unsubscribed(spark, path, schema, PARTITION, listed_vendors(spark, sf))
    seen = t.messages(spark, sf).filter(number() % 7 == 0).select(*ID, F.lit("seen").alias("status"))
    rewrite.set_status(spark, path, schema, PARTITION, seen, ID)
    return spark.read.schema(schema).parquet(path).select(*ID, "status")
