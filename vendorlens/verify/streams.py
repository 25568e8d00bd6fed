"""Streams, run to their end over landing files derived from the given tables."""

from pyspark.sql import functions as F

from ..functions.senders import header_value, parse_sender
from ..operators import state
from ..operators.state import ID
from ..sources.scratch import scratch_path
from ..streaming import daily, ingest
from . import tables as t
from .ctes import sql
from .registry import register
from .rows import mail_date


@register("stream_changes", """
SELECT 'a0' AS account_id, concat('m', event_id % 500) AS message_id,
  first(CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END ORDER BY event_id DESC) AS op FROM events GROUP BY 2""")
def stream_changes(spark, sf):
    return state.net_changes(t.change_feed(spark, sf))


@register("plain_changes", """
SELECT 'a0' AS account_id, concat('m', event_id % 500) AS message_id,
  CASE WHEN bool_or(event_type = 'error') THEN 'delete' ELSE 'add' END AS op FROM events GROUP BY 2""")
def plain_changes(spark, sf):
    return state.net_plain_changes(t.change_feed(spark, sf))


def sender(raw):
    return parse_sender(header_value(F.col("headers"), "from"))["email"]


def landing(spark, sf, name):
    """Two landing folders: all mail as additions, then deletions of the automatic replies and of one vendor's whole mail."""
    path = scratch_path(spark, name)
    raw = t.raw_messages(spark, sf).withColumns({
        "op": F.lit("add"), "seq": F.substring("id", 2, 20).cast("bigint")})
    reply = header_value(F.col("headers"), "subject") == "Out of office"
    gone = raw.filter(reply | (sender(raw) == "pub2@substack.com")).withColumns({"op": F.lit("delete"), "seq": F.col("seq") + 1_000_000_000})
    raw.write.parquet(f"{path}/adds")
    gone.write.parquet(f"{path}/deletes")
    return path


def store(spark, sf, name):
    """A mail store filled by two streams, additions first and deletions later, then changed by its users."""
    path = landing(spark, sf, name + "-landing")
    tables = ingest.Tables(scratch_path(spark, name), buckets=8)
    companies = t.companies(spark, sf)
    ingest.start_ingest(
        spark, f"{path}/adds", tables, scratch_path(spark, name + "-checkpoint"), companies=companies).awaitTermination()
    ingest.replay_since(
        spark, f"{path}/deletes", tables, scratch_path(spark, name + "-checkpoint"), 0, companies=companies).awaitTermination()
    left = t.messages(spark, sf).filter("status IS NOT NULL").select(*ID, "status")
    ingest.user_changes(spark, tables, marks=left, vendor_status=t.vendor_status(spark, sf))
    return path, tables


LEFT = "subject <> 'Out of office' AND vendor_key <> 'pub2.substack.com'"


@register("stream_ingest", sql("messages", f"""
SELECT account_id, message_id, vendor_key, type, unsubscribe_method, status FROM messages WHERE {LEFT}"""))
def stream_ingest(spark, sf):
    _, tables = store(spark, sf, "stream-ingest")
    return ingest.live_messages(spark, tables).select(*ID, "vendor_key", "type", "unsubscribe_method", "status")


@register("stream_vendor_refresh", sql("vendors", f"""
SELECT v.account_id, v.vendor_key, coalesce(s.message_count, 0) AS message_count, coalesce(s.sender_count, 0) AS sender_count,
  coalesce(s.bulk_count, 0) AS bulk_count, s.first_seen, s.last_seen, coalesce(s.has_marketing, false) AS has_marketing,
  coalesce(s.has_account, false) AS has_account, coalesce(s.has_orders, false) AS has_orders, coalesce(s.has_nonpersonal, false) AS has_nonpersonal,
  coalesce(s.has_rfc8058, false) AS has_rfc8058, coalesce(s.has_active_bulk, false) AS has_active_bulk,
  v.company_slug, v.name, v.category_id, v.risk_level, v.status
FROM vendors v LEFT JOIN (SELECT account_id, vendor_key, count(*) AS message_count, count(DISTINCT sender_email) AS sender_count,
    count(*) FILTER (type = 'bulk') AS bulk_count, min(date_ms) AS first_seen, max(date_ms) AS last_seen, bool_or(type = 'bulk') AS has_marketing,
    bool_or(type IN ('order', 'transactional')) AS has_account, bool_or(type = 'order') AS has_orders, bool_or(type <> 'personal') AS has_nonpersonal,
    bool_or(unsubscribe_method = 'rfc8058') AS has_rfc8058, bool_or(type = 'bulk' AND status IS NULL) AS has_active_bulk
  FROM messages WHERE {LEFT} GROUP BY 1, 2) s ON s.account_id = v.account_id AND s.vendor_key = v.vendor_key"""))
def stream_vendor_refresh(spark, sf):
    _, tables = store(spark, sf, "stream-refresh")
    return ingest.current_vendors(spark, tables).drop("bucket")


@register("stream_expired", sql("messages", """
SELECT account_id, concat(CASE WHEN event_id % 3 = 1 THEN 'imap-' ELSE '' END, message_id) AS message_id, type
FROM messages WHERE subject <> 'Out of office'"""))
def stream_expired(spark, sf):
    """Mail of two shapes, one without a provider date, and deletions that name an id and nothing else."""
    path = scratch_path(spark, "expired-landing")
    n = F.substring("id", 2, 20).cast("bigint")
    imap = n % 3 == 1
    dated = F.array_append("headers", t.header("Date", mail_date(F.timestamp_millis("received_ms"))))
    raw = t.raw_messages(spark, sf).withColumns({"op": F.lit("add"), "seq": n, "at": F.col("received_ms")}).withColumns({
        "headers": F.when(imap, dated).otherwise(F.col("headers")), "source": F.when(imap, "imap").otherwise("gmail"),
        "received_ms": F.when(~imap, F.col("received_ms"))})
    raw.filter("at < 1650000000000").drop("at").write.parquet(f"{path}/older")
    raw.drop("at").write.parquet(f"{path}/all")
    known = ("account_id", "source", "folder", "id", "op", "seq")
    bare = raw.filter(header_value(F.col("headers"), "subject") == "Out of office").withColumns({"op": F.lit("delete"), "seq": F.col("seq") + 1_000_000_000})
    bare.select(*known).write.mode("append").parquet(f"{path}/all")
    tables = ingest.Tables(scratch_path(spark, "expired"), buckets=8)
    ingest.start_ingest(spark, f"{path}/older", tables, scratch_path(spark, "expired-checkpoint")).awaitTermination()
    ingest.replay_since(
        spark, f"{path}/all", tables, scratch_path(spark, "expired-checkpoint"), 1_600_000_000_000).awaitTermination()
    return ingest.live_messages(spark, tables).select(*ID, "type")


@register("stream_daily", sql("messages", """
SELECT account_id, CAST(date_trunc('day', make_timestamp(date_ms * 1000)) AS DATE) AS day, count(*) AS n FROM messages GROUP BY 1, 2"""))
def stream_daily(spark, sf):
    """Three runs under one checkpoint; the oldest mail comes last, as in a backfill."""
    source, out, checkpoint = (scratch_path(spark, f"daily-{x}") for x in ("in", "out", "checkpoint"))
    mail = t.messages(spark, sf)
    for part in ("date_ms >= 1650000000000", "date_ms >= 1600000000000 AND date_ms < 1650000000000", "date_ms < 1600000000000"):
        mail.filter(part).select("account_id", F.timestamp_millis("date_ms").alias("ts")).write.mode("append").parquet(source)
        rows = spark.readStream.schema("account_id string, ts timestamp").parquet(source)
        daily.start_daily(rows, out, checkpoint).awaitTermination()
    return daily.current_days(spark, out)
