"""Vendor queries, details, logs and requests."""

from functools import reduce

from pyspark.sql import functions as F

from ..operators import requests, topk
from ..plans import vendor_detail as detail, vendor_query as vq
from . import tables as t
from .ctes import sql
from .joins import KEYS, LANGUAGE
from .registry import register
from .windows import METHODS, big

DAYS = f"(({t.AS_OF_MS} - last_seen) / 86400000.0)"
REVIEWED = "coalesce(status = 'reviewed', false)"
DEFAULTS = (f"NOT {REVIEWED} AND (has_nonpersonal OR has_action) AND (has_unwhitelisted OR has_action) AND vendor_key <> 'gmail.com'")
# The risk filter, which leaves out unknown categories.
RISK_SQL = {
    "high": "(has_orders OR (category_id IN ('financial', 'healthcare', 'government') AND has_account))",
    "medium": """(NOT has_orders AND ((category_id IN ('financial', 'healthcare', 'government') AND NOT has_account)
      OR category_id IN ('shopping', 'communication', 'services') OR (category_id IN ('social', 'marketing') AND has_account)))""",
    "low": "(NOT has_orders AND (category_id = 'entertainment' OR (category_id IN ('social', 'marketing') AND NOT has_account)))"}


def picked(spark, sf, predicate):
    return t.vendors(spark, sf).filter(predicate).select(*KEYS)


def tagged(spark, sf, choices):
    """Union of the vendors each choice selects, in one pass: an array of the names that hold."""
    names = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in choices.items()]))
    return t.vendors(spark, sf).select(*KEYS, F.explode(names).alias("choice"))


def tagged_sql(choices):
    parts = [f"SELECT account_id, vendor_key, '{n}' AS choice FROM vendors WHERE {p}" for n, p in choices.items()]
    return sql("vendors", " UNION ALL ".join(parts))


@register("vendor_query", sql("risks", f"""
SELECT account_id, vendor_key, message_count, computed_risk AS risk_level, rank, total FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY last_seen DESC, vendor_key) AS rank,
    count(*) OVER (PARTITION BY account_id) AS total
  FROM risks WHERE {DEFAULTS} AND (has_account OR on_breach_list) AND (contains(lower(name), 's') OR contains(vendor_key, 's'))
    AND message_count <= 100 AND {DAYS} >= 730)
WHERE rank <= 25"""))
def vendor_query(spark, sf):
    q = vq.VendorQuery(filter="accounts", search=" S ", activity="stale", max_messages=100, sort_by="last_seen", limit=25)
    return vq.vendor_query(t.vendors(spark, sf), q, t.AS_OF_MS).select(*KEYS, "message_count", "risk_level", big("rank"), "total")


@register("vendor_query_breaches", sql("breach_pairs", f"""
SELECT account_id, vendor_key, breach AS breach_name, breach_date, pwn_count, likely_affected FROM breach_pairs p
JOIN (SELECT account_id, vendor_key FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY message_count DESC, vendor_key) AS rank
  FROM vendors WHERE NOT {REVIEWED} AND vendor_key <> 'gmail.com' AND on_breach_list) WHERE rank <= 10) USING (account_id, vendor_key)"""))
def vendor_query_breaches(spark, sf):
    page = vq.vendor_query(t.vendors(spark, sf), vq.VendorQuery(on_breach_list=True, limit=10), t.AS_OF_MS)
    return vq.page_breaches(page, t.breaches(spark, sf)).drop("domain", "data_classes")


@register("vq_risk", tagged_sql({**RISK_SQL, "other": "true"}))
def vq_risk(spark, sf):
    return tagged(spark, sf, {n: vq.risk_predicate(n) for n in [*RISK_SQL, "other"]})


@register("vq_activity", tagged_sql({
    "recent": f"{DAYS} BETWEEN 0 AND 90", "active": f"{DAYS} BETWEEN 90 AND 365", "inactive": f"{DAYS} BETWEEN 365 AND 730",
    "stale": f"{DAYS} >= 730", "dead": f"{DAYS} >= 1825"}))
def vq_activity(spark, sf):
    return tagged(spark, sf, {n: vq.activity_predicate(n, t.AS_OF_MS) for n in vq.ACTIVITY})


@register("vq_volume", tagged_sql({
    "oneoff": "message_count <= 5", "low": "message_count BETWEEN 6 AND 25", "medium": "message_count BETWEEN 26 AND 100",
    "high": "message_count > 100"}))
def vq_volume(spark, sf):
    return tagged(spark, sf, {n: vq.volume_predicate(n) for n in vq.VOLUME})


@register("vq_datatype", tagged_sql({
    "has_orders": "has_orders", "has_account": "has_account", "marketing_only": "has_marketing AND NOT has_account"}))
def vq_datatype(spark, sf):
    return tagged(spark, sf, {n: vq.datatype_predicate(n) for n in ("has_orders", "has_account", "marketing_only")})


@register("vq_subscriptions", sql("vendors", "SELECT account_id, vendor_key FROM vendors WHERE has_actionable_recent_bulk"))
def vq_subscriptions(spark, sf):
    return picked(spark, sf, vq.active_subscriptions())


@register("vq_whitelisted", tagged_sql({
    "hidden": f"NOT has_unwhitelisted AND NOT {REVIEWED} AND NOT has_action",
    "shown": f"has_unwhitelisted OR {REVIEWED} OR has_action"}))
def vq_whitelisted(spark, sf):
    return tagged(spark, sf, {"hidden": vq.whitelist_view(True), "shown": vq.whitelist_view(False)})


@register("vq_search", tagged_sql({
    "OP1": "contains(lower(name), 'op1') OR contains(vendor_key, 'op1')", "_": "contains(name, '_') OR contains(vendor_key, '_')",
    "Zendesk": "contains(lower(name), 'zendesk') OR contains(vendor_key, 'zendesk')"}))
def vq_search(spark, sf):
    return tagged(spark, sf, {n: vq.search_predicate(n) for n in ("OP1", "_", "Zendesk")})


_ACCOUNTS = "(has_account OR on_breach_list)"
_LISTS = "has_marketing AND has_active_bulk"
_BREACH = f"NOT {REVIEWED} AND vendor_key <> 'gmail.com' AND on_breach_list"


@register("vq_presets", tagged_sql({
    "highrisk": f"{DEFAULTS} AND {_ACCOUNTS} AND {RISK_SQL['high']}",
    "onetime": f"{DEFAULTS} AND {_ACCOUNTS} AND has_orders AND message_count <= 5",
    "breached": f"{_BREACH} AND {_ACCOUNTS}",
    "oldaccounts": f"{DEFAULTS} AND {_ACCOUNTS} AND {RISK_SQL['high']} AND {DAYS} >= 730",
    "oldorders": f"{DEFAULTS} AND {_ACCOUNTS} AND has_orders AND {DAYS} >= 730",
    "mail_whitelisted": f"NOT {REVIEWED} AND {_LISTS} AND has_nonpersonal AND NOT has_unwhitelisted AND NOT has_action",
    "mail_priorities": f"{DEFAULTS} AND {_LISTS} AND has_actionable_recent_bulk",
    "mail_breached": f"{_BREACH} AND {_LISTS}"}))
def vq_presets(spark, sf):
    return tagged(spark, sf, {
        n: reduce(lambda a, b: a & b, vq.predicates(vq.preset(n), t.AS_OF_MS)) for n in vq.PRESETS})


@register("vendor_detail", sql("risks companies actions", """
SELECT v.account_id, v.vendor_key, v.company_slug, c.name AS company_name, c.email AS company_email, c.web AS company_web, v.name,
  v.category_id, computed_risk AS risk_level, message_count, sender_count, bulk_count, first_seen, last_seen, has_marketing, has_account,
  has_orders, v.status, m.message_id AS latest_message_id, m.subject AS latest_subject, coalesce(a.n, 0) AS action_count, a.last_action_at
FROM risks v LEFT JOIN companies c ON c.slug = v.company_slug
JOIN (SELECT *, row_number() OVER (PARTITION BY account_id, vendor_key ORDER BY date_ms DESC, message_id DESC) AS r FROM messages) m
  ON m.account_id = v.account_id AND m.vendor_key = v.vendor_key AND m.r = 1
LEFT JOIN (SELECT account_id, vendor_key, count(*) AS n, max(actioned_at) AS last_action_at FROM actions GROUP BY 1, 2) a
  ON a.account_id = v.account_id AND a.vendor_key = v.vendor_key"""))
def vendor_detail(spark, sf):
    return detail.vendor_detail(t.vendors(spark, sf), t.companies(spark, sf), t.messages(spark, sf), t.actions(spark, sf))


@register("vendor_detail_lists", sql("breach_pairs actions", """
SELECT account_id, vendor_key, 'all_messages' AS section, message_id AS item FROM (SELECT *, row_number() OVER (PARTITION BY account_id, vendor_key
  ORDER BY date_ms DESC, message_id DESC) AS r FROM messages) WHERE r <= 20
UNION ALL SELECT account_id, vendor_key, CASE WHEN bulk THEN 'bulk_messages' ELSE 'account_messages' END, message_id FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id, vendor_key, bulk ORDER BY date_ms DESC, message_id DESC) AS r
  FROM (SELECT *, type = 'bulk' AS bulk FROM messages WHERE type <> 'personal')) WHERE r <= 50
UNION ALL SELECT account_id, vendor_key, 'senders', concat(count(*), '|', sender_email, '|', sender_name) FROM messages GROUP BY account_id, vendor_key, sender_email, sender_name
UNION ALL SELECT a.account_id, a.vendor_key, 'activity', concat(a.action_id, '|', a.action_type) FROM actions a JOIN vendors USING (account_id, vendor_key)
UNION ALL SELECT account_id, vendor_key, 'breaches', concat(breach, '|', likely_affected) FROM breach_pairs"""))
def vendor_detail_lists(spark, sf):
    sections = detail.detail_sections(t.vendors(spark, sf), t.messages(spark, sf), t.actions(spark, sf), t.breaches(spark, sf), everyone=True)

    def of(*names):
        return F.concat_ws("|", *[F.get_json_object("json", f"$.{n}") for n in names])

    item = (
        F.when(F.col("section") == "senders", of("message_count", "sender_email", "sender_name"))
        .when(F.col("section") == "activity", of("action_id", "action_type"))
        .when(F.col("section") == "breaches", of("name", "likely_affected")).otherwise(of("message_id")))
    return sections.select(*KEYS, "section", F.explode("items").alias("json")).select(*KEYS, "section", item.alias("item"))


@register("activity_log", sql("vendors actions", """
SELECT a.account_id, rank, total, a.action_id, a.vendor_key, v.name AS vendor_name, v.company_slug, a.action_type,
  a.message_count, a.size_bytes, a.actioned_at FROM (
    SELECT a.*, row_number() OVER (PARTITION BY a.account_id ORDER BY actioned_at DESC, action_id) AS rank
    FROM actions a JOIN (SELECT DISTINCT account_id, vendor_key FROM vendors) USING (account_id, vendor_key)) a
  JOIN vendors v ON v.account_id = a.account_id AND v.vendor_key = a.vendor_key
  JOIN (SELECT account_id, count(*) AS total FROM actions GROUP BY 1) n ON n.account_id = a.account_id
WHERE rank > 10 AND rank <= 40"""))
def activity_log(spark, sf):
    return detail.activity_log(t.actions(spark, sf), t.vendors(spark, sf), 30, 10).withColumn("rank", big("rank"))


@register("activity_log_deep", sql("vendors actions", """
SELECT account_id, rank, action_id FROM (SELECT a.*, row_number() OVER (PARTITION BY a.account_id ORDER BY actioned_at DESC, action_id) AS rank
  FROM actions a JOIN vendors v ON v.account_id = a.account_id AND v.vendor_key = a.vendor_key) WHERE rank > 1200 AND rank <= 1300"""))
def activity_log_deep(spark, sf):
    found = detail.activity_log(t.actions(spark, sf), t.vendors(spark, sf), 100, 1200)
    return found.select("account_id", big("rank"), "action_id")


@register("recommended_actions", sql("breach_pairs", f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY account_id, vendor_key ORDER BY date_ms DESC, message_id DESC) AS r
  FROM messages WHERE type = 'bulk'),
m AS (SELECT account_id, vendor_key, bool_or(status IS NULL AND date_ms > {t.AS_OF_MS - 63115200000}) AS active FROM b WHERE r <= 50 GROUP BY 1, 2),
s AS (SELECT account_id, vendor_key, unsubscribe_method AS method, min(r) AS f FROM b WHERE r <= 50 AND unsubscribe_url <> '' GROUP BY 1, 2, 3),
x AS (SELECT v.*, coalesce(m.active, false) AS active, EXISTS (SELECT 1 FROM breach_pairs p WHERE p.account_id = v.account_id
    AND p.vendor_key = v.vendor_key AND p.likely_affected) AS affected,
  last_seen < {t.AS_OF_MS - 315576000000} AND message_count >= 5 AS ancient, last_seen < {t.AS_OF_MS - 63115200000} AND message_count >= 5 AS old
  FROM vendors v LEFT JOIN m USING (account_id, vendor_key)),
a AS (SELECT account_id, vendor_key, unnest([1, 2, 3]) AS o, 0 AS f, unnest(['breachReview', 'breachAccess', 'breachDeletion']) AS action FROM x WHERE affected
  UNION ALL SELECT s.account_id, s.vendor_key, 4, s.f, concat('unsub-', method) FROM s JOIN x USING (account_id, vendor_key) WHERE x.active
  UNION ALL SELECT account_id, vendor_key, 5, 0, 'deleteMarketing' FROM x WHERE bulk_count = message_count
  UNION ALL SELECT account_id, vendor_key, 6, 0, 'deleteAll' FROM x WHERE bulk_count < message_count
  UNION ALL SELECT account_id, vendor_key, 7, 0, 'checkActive' FROM x WHERE ancient AND NOT affected
  UNION ALL SELECT account_id, vendor_key, 8, 0, 'dataDeletion' FROM x WHERE old AND NOT ancient AND NOT affected)
SELECT account_id, vendor_key, action, row_number() OVER (PARTITION BY account_id, vendor_key ORDER BY o, f) - 1 AS pos FROM a""").replace(
    ") WITH b AS", "), b AS", 1))
def recommended_actions(spark, sf):
    found = detail.recommend(t.vendors(spark, sf), t.messages(spark, sf), t.breaches(spark, sf), t.AS_OF_MS)
    return found.withColumn("pos", big("pos"))


@register("bulk_eligible", sql("vendors", f"""
SELECT account_id, vendor_key, v.name, m.url FROM vendors v JOIN ({METHODS}) m USING (account_id, vendor_key) WHERE m.method = 'rfc8058'"""))
def bulk_eligible(spark, sf):
    return topk.oneclick_worklist(t.vendors(spark, sf), topk.unsub_methods(t.messages(spark, sf)))


@register("request_batch", sql("companies", f"""
SELECT concat('a', c_custkey % 3) AS account_id, concat('user', c_custkey, '@me.org') AS user_email, slug AS company_slug, language,
  CASE ord % 3 WHEN 0 THEN concat('privacy@Shop', ord, '.nl') WHEN 1 THEN concat('privacy@Shop', ord, '.com') ELSE 'privacy@company.com' END AS recipient,
  CASE language WHEN 'de' THEN 'Antrag auf Löschung personenbezogener Daten' WHEN 'fr' THEN 'Demande de suppression de données personnelles'
    WHEN 'es' THEN 'Solicitud de eliminación de datos personales' WHEN 'nl' THEN 'Verzoek tot verwijdering van persoonsgegevens'
    ELSE 'Personal Data Deletion Request' END AS subject,
  concat('- user', c_custkey, '@me.org', CASE WHEN c_custkey % 2 = 0 THEN concat(chr(10), '- ', CASE language WHEN 'de' THEN 'Kontoreferenz'
    WHEN 'fr' THEN 'Référence de compte' WHEN 'es' THEN 'Referencia de cuenta' WHEN 'nl' THEN 'Accountreferentie' ELSE 'Account reference' END,
    ': R', c_custkey) ELSE '' END) AS reference,
  CASE language WHEN 'de' THEN 'Bitte löschen Sie alle Daten zu meiner Person und informieren Sie deren Empfänger.'
    WHEN 'fr' THEN 'Merci d''effacer toutes mes données et d''en avertir leurs destinataires.'
    WHEN 'es' THEN 'Borren todos mis datos y avisen a quienes los hayan recibido.'
    WHEN 'nl' THEN 'Wis alstublieft alle gegevens over mij en laat ontvangers hetzelfde doen.'
    ELSE 'Please erase every record you keep about me and tell recipients of my data to do the same.' END AS wish,
  CASE language WHEN 'de' THEN 'Ich erwarte Ihre Antwort innerhalb von 30 Tagen.' WHEN 'fr' THEN 'J''attends votre réponse sous 30 jours.'
    WHEN 'es' THEN 'Espero su respuesta en 30 días.' WHEN 'nl' THEN 'Ik verwacht uw antwoord binnen 30 dagen.'
    ELSE 'I expect your answer within 30 days.' END AS closing,
  CASE WHEN c_custkey % 3 = 0 THEN concat('Name ', c_custkey) ELSE concat('user', c_custkey, '@me.org') END AS signed
FROM customer JOIN (SELECT *, {LANGUAGE.replace("WHEN ord % 7 = 0 THEN 'it' ", "")} AS language FROM companies) ON ord = c_custkey % 150"""))
def request_batch(spark, sf):
    k = F.col("c_custkey")
    slug = F.concat(F.lit("shop"), k % 150, F.when(k % 150 % 10 == 9, "-de").otherwise(""))
    people = t.table(spark, sf, "customer").select(
        F.concat(F.lit("a"), k % 3).alias("account_id"), F.concat(F.lit("user"), k, F.lit("@me.org")).alias("user_email"),
        F.when(k % 3 == 0, F.concat(F.lit(" Name "), k)).otherwise("  ").alias("user_name"),
        F.when(k % 2 == 0, F.concat(F.lit("R"), k)).alias("account_reference"), slug.alias("company_slug"))
    letters = requests.request_batch(people, t.companies(spark, sf), requests.templates(spark), "delete")
    parts = F.split("body", "\n\n")
    return letters.select(
        "account_id", "user_email", "company_slug", "language", "recipient", "subject",
        parts[0].alias("wish"), parts[1].alias("reference"), parts[2].alias("closing"), parts[3].alias("signed"))
