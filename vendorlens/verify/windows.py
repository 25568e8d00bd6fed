"""Newest-n, best-of, search and index queries."""

from pyspark.sql import functions as F

from ..operators import breaches as breach_ops, matching, topk
from ..plans import breach_pages as pages, vendor_query as vq
from . import tables as t
from .aggregates import LABEL_SQL
from .ctes import sql
from .joins import KEYS, resolved
from .registry import register


def big(name):
    return F.col(name).cast("bigint").alias(name)


@register("latest_messages", sql("messages", """
SELECT account_id, vendor_key, message_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY account_id, vendor_key
  ORDER BY date_ms DESC, message_id DESC) AS rank FROM messages) WHERE rank <= 20"""))
def latest_messages(spark, sf):
    return topk.latest_messages(t.messages(spark, sf), None, 20).select(*KEYS, "message_id", big("rank"))


@register("unsub_url_by_sender", sql("messages", """
SELECT account_id, sender_email, first(unsubscribe_url ORDER BY date_ms DESC, message_id DESC) AS unsubscribe_url
FROM messages WHERE unsubscribe_url <> '' GROUP BY 1, 2"""))
def unsub_url_by_sender(spark, sf):
    return topk.unsub_url_by_sender(t.messages(spark, sf))


@register("unsub_url_by_vendor", sql("messages", """
SELECT account_id, vendor_key, first(unsubscribe_url ORDER BY date_ms DESC, message_id DESC) AS unsubscribe_url
FROM messages WHERE unsubscribe_url <> '' AND type = 'bulk' GROUP BY 1, 2"""))
def unsub_url_by_vendor(spark, sf):
    return topk.unsub_url_by_vendor(t.messages(spark, sf))


METHODS = """SELECT account_id, vendor_key, unsubscribe_method AS method, unsubscribe_url AS url, sender_email, date_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id, vendor_key, unsubscribe_method ORDER BY date_ms DESC, message_id DESC) AS r
  FROM messages WHERE type = 'bulk' AND unsubscribe_url <> '' AND coalesce(status, '') <> 'unsubscribed') WHERE r = 1"""


@register("unsub_methods", sql("messages", METHODS))
def unsub_methods(spark, sf):
    return topk.unsub_methods(t.messages(spark, sf))


@register("unsub_best", sql("messages", f"""
SELECT account_id, vendor_key, method, url, sender_email FROM (SELECT *, row_number() OVER (PARTITION BY account_id, vendor_key
  ORDER BY CASE method WHEN 'rfc8058' THEN 1 WHEN 'list-unsubscribe' THEN 2 ELSE 3 END) AS r FROM ({METHODS})) WHERE r = 1"""))
def unsub_best(spark, sf):
    return topk.best_unsub(topk.unsub_methods(t.messages(spark, sf)))


def two_senders(spark, sf):
    """Messages in which even vendors write from two addresses."""
    n = F.substring("message_id", 2, 20).cast("bigint")
    return t.messages(spark, sf).withColumn(
        "sender_email", F.when((n % 3 == 0) & (n % 2 == 0), F.concat(F.lit("alt-"), "sender_email")).otherwise(F.col("sender_email")))


@register("messages_by_sender", sql("messages", """
SELECT account_id, vendor_key, message_id, sr AS sender_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id, vendor_key, sender ORDER BY rank) AS sr,
    count(*) FILTER (sender LIKE 'alt-%') OVER (PARTITION BY account_id, vendor_key) AS alts,
    count(*) OVER (PARTITION BY account_id, vendor_key) AS total
  FROM (SELECT *, CASE WHEN event_id % 6 = 0 THEN concat('alt-', sender_email) ELSE sender_email END AS sender,
    row_number() OVER (PARTITION BY account_id, vendor_key ORDER BY date_ms DESC, message_id DESC) AS rank FROM messages)
  WHERE rank <= 50) WHERE sr <= CASE WHEN alts > 0 AND alts < total THEN 5 ELSE 10 END"""))
def messages_by_sender(spark, sf):
    return topk.messages_by_sender(two_senders(spark, sf)).select(*KEYS, "message_id", big("sender_rank"))


@register("subjects_sample", sql("vendor_subjects", "SELECT account_id, vendor_key, subjects FROM vendor_subjects"))
def subjects_sample(spark, sf):
    return topk.subjects_sample(t.messages(spark, sf))


@register("vendor_page", sql("risks", """
SELECT account_id, vendor_key, message_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY account_id
  ORDER BY CASE computed_risk WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, message_count DESC, vendor_key) AS rank FROM risks)
WHERE rank > 20 AND rank <= 40"""))
def vendor_page(spark, sf):
    q = vq.VendorQuery(page=2, limit=20, sort_by="risk", sort_dir="ASC")
    return vq.vendor_page(t.vendors(spark, sf), q).select(*KEYS, "message_count", big("rank"))


@register("company_search", sql("companies", """
WITH q AS (SELECT DISTINCT query FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN concat('shop', c_custkey) WHEN 1 THEN concat('p', c_custkey % 10, '.co')
  WHEN 2 THEN concat('hop', c_custkey % 10) ELSE 'x' END AS query FROM customer) WHERE length(query) >= 2),
h AS (SELECT query, slug, name, starts_with(lower(name), query) AS prefix, row_number() OVER (PARTITION BY query ORDER BY name, slug) AS scan
  FROM q JOIN companies c ON contains(lower(name), query) OR contains(domains[1], query) OR contains(domains[2], query))
SELECT query, rank, slug, name FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY prefix DESC, scan) AS rank FROM h WHERE scan <= 20)
WHERE rank <= 5""").replace(") WITH q AS", "), q AS", 1))
def company_search(spark, sf):
    k = F.col("c_custkey")
    query = F.when(k % 4 == 0, F.concat(F.lit(" Shop"), k)).when(k % 4 == 1, F.concat(F.lit("P"), k % 10, F.lit(".co"))).when(
        k % 4 == 2, F.concat(F.lit("hop"), k % 10)).otherwise("x")
    queries = t.table(spark, sf, "customer").select(query.alias("query"))
    return matching.company_search(queries, t.companies(spark, sf), 5, scan=20, index=t.company_index(spark, sf)).withColumn("rank", big("rank"))


@register("breach_index", sql("records", f"""
SELECT slug, title, breach_date, pwn_count, array_to_string(data_classes, ',') AS data_classes, severity,
  {LABEL_SQL.format('categories[1]')} AS category_label, CASE categories[1] WHEN 'shopping' THEN '🛒' WHEN 'social' THEN '💬'
    WHEN 'entertainment' THEN '🎮' END AS category_icon, CASE WHEN webform IS NOT NULL THEN concat('/logos/', slug, '.png') END AS logo_path
FROM records WHERE breach_date >= '2020-01-01'"""))
def breach_index(spark, sf):
    records = pages.breach_records(t.companies(spark, sf), t.breaches(spark, sf)).withColumn(
        "logo_path", F.when(F.col("webform").isNotNull(), F.concat(F.lit("/logos/"), "slug", F.lit(".png"))))
    return breach_ops.breach_index(records, "2020-01-01")


REGULATORS = """SELECT * FROM (VALUES
  ('Germany', 'BfDI + 16 state DPAs', 'poststelle@bfdi.bund.de', '+49 228 997799-0', 'Graurheindorfer Str. 153, 53117 Bonn',
    'https://www.bfdi.bund.de/EN/Buerger/Inhalte/Allgemein/Datenschutz/BeschwerdeBeiDatenschutzbehoerden.html', 'https://www.bfdi.bund.de', false,
    'For private companies, file with the state DPA where the company is headquartered, not the federal BfDI. Forms are German only.'),
  ('France', 'Commission Nationale de l''Informatique et des Libertés (CNIL)', NULL, '+33 1 53 73 22 22', '3 Place de Fontenoy, 75007 Paris',
    'https://www.cnil.fr/fr/plaintes', 'https://www.cnil.fr/en/', false, 'Complaint process is French only. No English submission accepted.'),
  ('Spain', 'Agencia Española de Protección de Datos (AEPD)', 'uits@aepd.es', '900 293 183 (freephone within Spain)', 'C/ Jorge Juan 6, 28001 Madrid',
    'https://sedeaepd.gob.es/sede-electronica-web/vistas/infoSede/tramitesCiudadanoReclamaciones.jsf', 'https://www.aepd.es/en', false,
    'Online filing requires a Spanish digital certificate (Cl@ve). Non-residents should file by post in Spanish.'),
  ('Austria', 'Datenschutzbehörde (DSB)', 'dsb@dsb.gv.at', '+43 1 52 152-0', 'Barichgasse 40-42, 1030 Vienna',
    'https://dsb.gv.at/eingabe-an-die-dsb/formulare', 'https://data-protection-authority.gv.at', true, NULL),
  ('Netherlands', 'Autoriteit Persoonsgegevens (AP)', 'info@autoriteitpersoonsgegevens.nl', '+31 70 888 8500', 'Postbus 93374, 2509 AJ Den Haag',
    'https://klachten.autoriteitpersoonsgegevens.nl/', 'https://www.autoriteitpersoonsgegevens.nl/en', true, NULL),
  ('United Kingdom', 'Information Commissioner''s Office (ICO)', 'icocasework@ico.org.uk', '+44 303 123 1113', 'Wycliffe House, Water Lane, Wilmslow SK9 5AF',
    'https://ico.org.uk/make-a-complaint/data-protection-complaints/', 'https://ico.org.uk', true,
    'Post-Brexit: the UK operates under UK GDPR, not EU GDPR. Substantively similar but legally separate.')
) v(regulated, regulator_name, regulator_email, regulator_phone, regulator_address, regulator_complaint_url, regulator_website,
  regulator_english_ok, regulator_warning)"""

PAGES_SQL = f"""
WITH f AS (SELECT company_slug, count(*) AS fines, CAST(sum(coalesce(fine_eur, 0)) AS BIGINT) AS total,
  nullif(first(dpa_country ORDER BY decision_date DESC, etid DESC), 'Czech Republic') AS dpa FROM enforcement GROUP BY 1),
c AS (SELECT r.*, coalesce(fines, 0) AS fines, coalesce(total, 0) AS total_fines, CAST(split_part(replace(r.slug, '-', ''), 'p', 2) AS VARCHAR) AS x,
  coalesce(dpa, CASE WHEN address LIKE '%Germany.' THEN 'Germany' WHEN address LIKE '%France' THEN 'France'
    WHEN address LIKE 'Calle%' THEN 'Spain' WHEN domain LIKE '%.uk' THEN 'United Kingdom' END) AS regulator_country
  FROM records r LEFT JOIN f ON f.company_slug = r.slug)
SELECT slug, concat(title, ' Data Breach - What to Do') AS page_title,
  concat(floor(pwn_count / 1000.0 + 0.5)::BIGINT, 'K records exposed in the ', title, ' breach (', left(breach_date, 4),
    '). Find out what data was leaked and what steps to take now.') AS page_description,
  company_name, web AS website, domain, {LABEL_SQL.format('categories[1]')} AS category_label, breach_date, pwn_count, severity,
  'haveibeenpwned.com' AS source_name, concat('https://haveibeenpwned.com/Breach/', name) AS source_url, fines, total_fines,
  regulator_country, regulator_name, regulator_email, regulator_phone, regulator_address, regulator_complaint_url, regulator_website,
  regulator_english_ok, regulator_warning,
  coalesce(webform, concat('mailto:', nullif(email, ''))) AS contact_url FROM c LEFT JOIN ({REGULATORS}) ON regulated = regulator_country"""


@register("breach_page", sql("records enforcement", PAGES_SQL).replace(") \nWITH f AS", "), f AS").replace(") WITH f AS", "), f AS", 1).replace(
    "concat('mailto:', nullif(email, ''))", "CASE WHEN email IS NOT NULL THEN concat('mailto:', email) END"))
def breach_page(spark, sf):
    records = pages.breach_records(t.companies(spark, sf), t.breaches(spark, sf))
    return pages.breach_pages(records, resolved(spark, sf))
