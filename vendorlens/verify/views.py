"""Numbers and lists that are kept and changed, held against the same SQL as those that are worked out anew."""

from pyspark.sql import functions as F

from ..operators import deltas, topk_views
from ..operators.state import ID, VENDOR
from ..sources.scratch import kept, scratch_path
from . import tables as t
from .aggregates import DASHBOARD
from .ctes import sql
from .registry import register
from .windows import METHODS


def kept_deltas(spark, sf):
    """Everything counted once; then vendors with orders are reviewed, and an account is reset; the batches come in another order."""
    path = scratch_path(spark, "deltas")
    vendors, messages, actions = t.vendors(spark, sf), t.messages(spark, sf), t.actions(spark, sf)
    before = vendors.filter("has_orders")
    after = before.withColumn("status", F.lit("reviewed"))
    reset = [df.filter("account_id = 'a1'") for df in (before.unionByName(vendors.filter("NOT has_orders")), messages, actions)]
    gone = reset[0].withColumn("status", F.when(F.col("has_orders"), "reviewed").otherwise(F.col("status")))
    counted = deltas.of_messages(reset[1]).union(deltas.of_actions(reset[2]))
    deltas.write_delta(deltas.delta(None, deltas.of_vendors(gone).union(counted)), path, 2)
    deltas.write_delta(deltas.delta(deltas.of_vendors(vendors).union(deltas.of_messages(messages)).union(deltas.of_actions(actions))), path, 0)
    deltas.write_delta(deltas.delta(deltas.of_vendors(after), deltas.of_vendors(before)), path, 1)
    return deltas.read_deltas(spark, path)


REVIEWED = "(SELECT * REPLACE (CASE WHEN has_orders THEN 'reviewed' ELSE status END AS status) FROM risks WHERE account_id <> 'a1')"


@register("dashboard_kept", sql("risks", DASHBOARD.format(REVIEWED)))
def dashboard_kept(spark, sf):
    return deltas.dashboard(kept_deltas(spark, sf))


@register("risk_counts_kept", sql("risks", """
SELECT a.account_id, l.risk_level, count(v.vendor_key) AS vendors FROM (SELECT DISTINCT account_id FROM risks WHERE account_id <> 'a1') a
CROSS JOIN (VALUES ('high'), ('medium'), ('low')) l(risk_level) LEFT JOIN risks v ON v.account_id = a.account_id AND v.computed_risk = l.risk_level GROUP BY 1, 2"""))
def risk_counts_kept(spark, sf):
    return deltas.risk_counts(kept_deltas(spark, sf))


@register("impact_kept", sql("actions", """
SELECT account_id, count(*) FILTER (action_type = 'unsubscribed') AS lists_unsubscribed,
  CAST(sum(CASE WHEN action_type <> 'unsubscribed' THEN message_count ELSE 0 END) AS BIGINT) AS emails_deleted,
  CAST(sum(size_bytes) AS BIGINT) AS bytes_reclaimed FROM actions WHERE account_id <> 'a1' GROUP BY 1"""))
def impact_kept(spark, sf):
    return deltas.impact(kept_deltas(spark, sf))


def changed(spark, sf, spec):
    """(view, base table) after two batches: the orders come later than the rest, and all mail of one sender name in three goes with the newest third of
    the larger vendors, which uses up their reserve."""
    messages = t.messages(spark, sf)
    number = F.substring("message_id", 2, 20).cast("bigint")
    orders, rest = messages.filter("type = 'order'"), messages.filter("type <> 'order' OR type IS NULL")
    view, _ = spec.apply(kept(spec.build(rest), "view"), orders, messages.limit(0), messages)
    gone = messages.filter((number % 3 == 1) | (F.col("date_ms") > 1_690_000_000_000))
    left = messages.join(gone.select(*ID), ID, "left_anti")
    view, _ = spec.apply(kept(view, "view"), messages.limit(0), gone, left)
    return view


LEFT = "FROM messages WHERE event_id % 3 <> 1 AND date_ms <= 1690000000000"


@register("latest_messages_kept", sql("messages", f"""
SELECT account_id, vendor_key, message_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY account_id, vendor_key
  ORDER BY date_ms DESC, message_id DESC) AS rank {LEFT}) WHERE rank <= 20"""))
def latest_messages_kept(spark, sf):
    spec = topk_views.latest()
    return spec.first(changed(spark, sf, spec)).select(*VENDOR, "message_id", "rank")


@register("subjects_kept", sql("messages", f"""
SELECT account_id, vendor_key, string_agg(subject, ' ' ORDER BY date_ms, message_id) AS subjects FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id, vendor_key ORDER BY date_ms, message_id) AS r {LEFT} AND subject IS NOT NULL) WHERE r <= 10 GROUP BY 1, 2"""))
def subjects_kept(spark, sf):
    spec = topk_views.first_subjects()
    return topk_views.subjects_of(changed(spark, sf, spec), spec)


@register("unsub_best_kept", sql("messages", f"""
SELECT account_id, vendor_key, method, url, sender_email FROM (SELECT *, row_number() OVER (PARTITION BY account_id, vendor_key
  ORDER BY CASE method WHEN 'rfc8058' THEN 1 WHEN 'list-unsubscribe' THEN 2 ELSE 3 END) AS r
  FROM ({METHODS.replace("FROM messages WHERE type = 'bulk'", f"{LEFT} AND type = 'bulk'")})) WHERE r = 1"""))
def unsub_best_kept(spark, sf):
    spec = topk_views.methods()
    return topk_views.best_of(changed(spark, sf, spec), spec)
