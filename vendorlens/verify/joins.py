"""Join and matching queries."""

from pyspark.sql import functions as F

from ..functions import fines
from ..operators import breaches as breach_ops, enforcement, matching, requests, rollups, whitelist
from ..operators.joins import lookup
from ..plans import vendor_detail
from . import tables as t
from .ctes import sql
from .registry import register

KEYS = ["account_id", "vendor_key"]


def vendor_keys(spark, sf):
    return t.message_vendors(spark, sf).distinct()


@register("join_company_domain", sql("messages companies", """
SELECT DISTINCT m.account_id, m.vendor_key, c.slug AS domain_slug
FROM messages m LEFT JOIN companies c ON list_contains(c.domains, m.vendor_key)"""))
def join_company_domain(spark, sf):
    return matching.match_by_domain(vendor_keys(spark, sf), t.companies(spark, sf)).select(*KEYS, "domain_slug")


def named_vendors(spark, sf):
    """Vendor names that are part of company names, of brands, of several or of none."""
    k = F.col("c_custkey")
    name = t.pick(["shop{id}", "BRAND {id}", "hop{id} L", "line", "Zz{id}", "op", "{id} ltd."], k)
    return t.table(spark, sf, "customer").select(
        F.concat(F.lit("a"), k % 3).alias("account_id"), F.concat(F.lit("v"), k, F.lit(".org")).alias("vendor_key"),
        name.alias("name"))


@register("join_company_name", sql("companies", """
SELECT concat('a', c_custkey % 3) AS account_id, concat('v', c_custkey, '.org') AS vendor_key,
  (SELECT arg_min(slug, ord) FROM companies WHERE length(n) >= 3 AND (contains(lower(name), lower(n))
     OR contains(lower(runs[1]), lower(n)) OR contains(lower(runs[2]), lower(n)))) AS name_slug
FROM (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN concat('shop', c_custkey) WHEN 1 THEN concat('BRAND ', c_custkey)
  WHEN 2 THEN concat('hop', c_custkey, ' L') WHEN 3 THEN 'line' WHEN 4 THEN concat('Zz', c_custkey) WHEN 5 THEN 'op'
  ELSE concat(c_custkey, ' ltd.') END AS n FROM customer)"""))
def join_company_name(spark, sf):
    return matching.match_by_name(named_vendors(spark, sf), t.companies(spark, sf), t.company_index(spark, sf)).select(*KEYS, "name_slug")


@register("match_vendor_companies", sql("companies", """
SELECT concat('a', c_custkey % 3) AS account_id, vk AS vendor_key,
  CASE WHEN c_custkey % 4 = 0 THEN 'kept' WHEN vk = 'gmail.com' THEN NULL ELSE coalesce(
    (SELECT slug FROM companies WHERE list_contains(domains, vk)),
    (SELECT arg_min(slug, ord) FROM companies WHERE contains(lower(name), lower(n)))) END AS company_slug
FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'gmail.com' WHEN 1 THEN concat('shop', c_custkey % 200, '.com')
  ELSE concat('v', c_custkey, '.org') END AS vk, concat('Shop', c_custkey % 300, ' ltd') AS n FROM customer)"""))
def match_vendor_companies(spark, sf):
    k = F.col("c_custkey")
    key = F.when(k % 5 == 0, "gmail.com").when(k % 5 == 1, F.concat(F.lit("shop"), k % 200, F.lit(".com"))).otherwise(
        F.concat(F.lit("v"), k, F.lit(".org")))
    vendors = t.table(spark, sf, "customer").select(
        F.concat(F.lit("a"), k % 3).alias("account_id"), key.alias("vendor_key"),
        F.concat(F.lit("Shop"), k % 300, F.lit(" ltd")).alias("name"),
        F.when(k % 4 == 0, "kept").alias("company_slug"), k.alias("k"))
    # The stored table has one row per key; the customers do not, so the row id joins the key here.
    vendors = vendors.withColumn("account_id", F.concat_ws("|", "account_id", "k"))
    found = matching.match_companies(vendors, t.companies(spark, sf))
    return found.select(F.substring_index("account_id", "|", 1).alias("account_id"), "vendor_key", "company_slug")


@register("join_breach_suffix", sql("breach_pairs", "SELECT account_id, vendor_key, breach, domain FROM breach_pairs"))
def join_breach_suffix(spark, sf):
    return breach_ops.join_breaches(vendor_keys(spark, sf), t.breaches(spark, sf)).select(
        *KEYS, F.col("name").alias("breach"), "domain")


@register("semi_breach", sql("vendors", "SELECT account_id, vendor_key, on_breach_list FROM vendors"))
def semi_breach(spark, sf):
    return breach_ops.on_breach_list(vendor_keys(spark, sf), t.breaches(spark, sf)).select(*KEYS, "on_breach_list")


@register("breach_affected", sql("breach_pairs", """
SELECT account_id, vendor_key, breach, likely_affected FROM breach_pairs"""))
def breach_affected(spark, sf):
    stats = rollups.vendor_stats(t.messages(spark, sf))
    return breach_ops.breach_info(stats, t.breaches(spark, sf)).select(
        *KEYS, F.col("name").alias("breach"), "likely_affected")


@register("breach_lookup_bidir", sql("breaches", """
SELECT query, slug, title FROM (SELECT q.query, x.name AS slug, x.title,
  row_number() OVER (PARTITION BY query ORDER BY pwn_count DESC, x.name) AS r
FROM (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN concat('shop', c_custkey, '.com') WHEN 1 THEN concat('a.b.shop', c_custkey, '.co.uk')
    WHEN 2 THEN 'co.uk' ELSE concat('none', c_custkey, '.com') END AS query FROM customer) q
JOIN breaches x ON x.breach_date >= '2018-01-01' AND
  (x.domain = query OR query LIKE concat('%.', x.domain) OR x.domain LIKE concat('%.', query))) WHERE r = 1"""))
def breach_lookup_bidir(spark, sf):
    domains = t.table(spark, sf, "customer").select(
        t.pick([" Shop{id}.COM", "a.b.shop{id}.co.uk", "co.uk", "none{id}.com"], F.col("c_custkey")).alias("domain"))
    known = t.breaches(spark, sf).withColumn("slug", F.col("name"))
    return breach_ops.lookup_breach(domains, known, "2018-01-01")


@register("breach_best_for_company", sql("records", "SELECT slug, name, breach_date, pwn_count FROM records"))
def breach_best_for_company(spark, sf):
    return breach_ops.top_breach(t.companies(spark, sf), t.breaches(spark, sf)).select(
        "slug", "name", "breach_date", "pwn_count")


def _relation_sql(name, step, key, months, candidates):
    since = {12: "2023-01-31", 6: "2023-07-31"}[months]
    return f"""
SELECT slug, '{name}' AS relation, {step} AS step, pos, r, company, breach_date, pwn_count, attribution FROM (
  SELECT w.slug, w.pos, c.company, c.breach_date, c.pwn_count, c.attribution,
    row_number() OVER (PARTITION BY w.slug, w.key ORDER BY c.breach_date DESC, c.pwn_count DESC, c.candidate, c.breach) AS r
  FROM ({key}) w JOIN ({candidates}) c ON c.key = w.key AND c.candidate <> w.slug AND c.breach_date >= '{since}') WHERE r <= 3"""


_EVERY = """SELECT {0} AS key, c.slug AS candidate, c.name AS company, x.name AS breach, x.breach_date, x.pwn_count, x.attribution
FROM companies c JOIN breaches x ON list_contains(c.domains, x.domain)"""
_TLD = "CASE WHEN {0} LIKE '%.uk' THEN 'uk' END"


@register("breach_related", sql("records", f"""
SELECT slug, relation, company, breach_date, pwn_count, attribution FROM (
  SELECT *, row_number() OVER (PARTITION BY slug, relation, company ORDER BY pos, r) AS n FROM (
    {_relation_sql('same-attribution', 1, "SELECT slug, 0 AS pos, attribution AS key FROM records", 12, _EVERY.format("x.attribution"))}
    UNION ALL {_relation_sql('same-country', 2, "SELECT slug, 0 AS pos, " + _TLD.format("domain") + " AS key FROM records", 6, _EVERY.format(_TLD.format("x.domain")))}
    UNION ALL {_relation_sql('same-sector', 3, "SELECT slug, unnest(generate_series(0, len(categories) - 1)) AS pos, unnest(categories) AS key FROM records", 12,
        "SELECT unnest(categories) AS key, * EXCLUDE (key, categories) FROM (" + _EVERY.format("0").replace("x.attribution\nFROM", "x.attribution, c.categories\nFROM") + ")")}
  )) WHERE n = 1"""))
def breach_related(spark, sf):
    return breach_ops.related_breaches(t.companies(spark, sf), t.breaches(spark, sf), t.AS_OF_DAY)


COVERED = """EXISTS (SELECT 1 FROM whitelist w WHERE w.account_id = m.account_id AND (m.sender_email = w.value
  OR m.sender_email LIKE concat('%@', w.value) OR m.sender_email LIKE concat('%.', w.value)))"""


@register("whitelist_anti", sql("messages whitelist", f"""
SELECT account_id, message_id, sender_email FROM messages m WHERE NOT {COVERED}"""))
def whitelist_anti(spark, sf):
    return whitelist.not_whitelisted(t.messages(spark, sf), t.whitelist(spark, sf)).select(
        "account_id", "message_id", "sender_email")


@register("whitelist_seed", sql("whitelist accounts", """
SELECT account_id, value FROM whitelist UNION SELECT account_id, lower(email) FROM accounts
UNION SELECT account_id, split_part(lower(email), '@', 2) FROM accounts"""))
def whitelist_seed(spark, sf):
    return whitelist.seed_whitelist(t.accounts(spark, sf), t.whitelist(spark, sf))


@register("whitelist_scope", sql("vendors whitelist", """
SELECT * FROM (
  SELECT DISTINCT m.account_id, m.vendor_key, w.value, 'entry' AS kind FROM messages m JOIN whitelist w ON w.account_id = m.account_id
    AND (w.value = m.sender_email OR w.value = split_part(m.sender_email, '@', 2)
      OR (w.value NOT LIKE '%@%' AND w.value = coalesce((SELECT replace(web, 'https://www.', '') FROM companies c
        WHERE list_contains(c.domains, m.vendor_key)) , concat(m.vendor_key, '/')) [:-2])
      OR (w.value = 'zendesk.com' AND m.vendor_key LIKE '%.zendesk.com'))
  UNION ALL
  SELECT DISTINCT account_id, vendor_key, value, 'option' FROM (
    SELECT account_id, vendor_key, sender_email AS value FROM messages UNION
    SELECT account_id, vendor_key, coalesce(CASE WHEN company_slug IS NOT NULL THEN regexp_replace(vendor_key, '(com|co.uk)$', 'com') END,
      regexp_replace(vendor_key, '^.*[.](substack.com|zendesk.com|luma-mail.com)$', '\\1')) FROM vendors) o
  WHERE NOT EXISTS (SELECT 1 FROM whitelist w WHERE w.account_id = o.account_id AND w.value = o.value))"""))
def whitelist_scope(spark, sf):
    messages = t.messages(spark, sf)
    vendors = t.vendors(spark, sf)
    return whitelist.whitelist_scope(
        vendors, messages.select(*KEYS, "sender_email").distinct(), t.companies(spark, sf), t.whitelist(spark, sf))


@register("exists_type", sql("vendor_base", """
SELECT account_id, vendor_key, has_orders, has_nonpersonal, has_rfc8058, has_active_bulk FROM vendor_base"""))
def exists_type(spark, sf):
    features = rollups.vendor_features(
        t.messages(spark, sf), t.whitelist(spark, sf), t.actions(spark, sf), t.AS_OF_MS)
    return features.select(*KEYS, "has_orders", "has_nonpersonal", "has_rfc8058", "has_active_bulk")


@register("anti_unsubscribed", sql("messages actions", """
SELECT account_id, message_id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM actions a
  WHERE a.account_id = m.account_id AND a.vendor_key = m.vendor_key AND a.action_type = 'unsubscribed')"""))
def anti_unsubscribed(spark, sf):
    return whitelist.not_actioned(t.messages(spark, sf), t.actions(spark, sf)).select("account_id", "message_id")


@register("join_activity_vendor", sql("vendors actions", """
SELECT a.account_id, a.action_id, a.vendor_key, v.name AS vendor_name, v.company_slug
FROM actions a JOIN vendors v USING (account_id, vendor_key)"""))
def join_activity_vendor(spark, sf):
    return vendor_detail.activity_rows(t.actions(spark, sf), t.vendors(spark, sf)).select(
        "account_id", "action_id", "vendor_key", "vendor_name", "company_slug")


@register("join_sender_vendor", sql("vendors", """
SELECT account_id, vendor_key, name FROM vendors v WHERE EXISTS (SELECT 1 FROM messages m WHERE m.account_id = v.account_id
  AND m.vendor_key = v.vendor_key AND m.sender_email IN (SELECT concat('hi@shop', c_custkey, '.com') FROM customer))"""))
def join_sender_vendor(spark, sf):
    emails = t.table(spark, sf, "customer").select(
        F.concat(F.lit("hi@shop"), "c_custkey", F.lit(".com")).alias("sender_email"))
    return rollups.vendors_by_sender(t.vendors(spark, sf), t.messages(spark, sf), emails).select(*KEYS, "name")


@register("keyed_lookup", sql("vendors", """
SELECT account_id, vendor_key, company_slug FROM vendors
WHERE company_slug IN (SELECT concat('shop', c_custkey) FROM customer)"""))
def keyed_lookup(spark, sf):
    slugs = t.table(spark, sf, "customer").select(F.concat(F.lit("shop"), "c_custkey").alias("company_slug"))
    return lookup(t.vendors(spark, sf), slugs, "company_slug").select(*KEYS, "company_slug")


@register("touched_vendors", sql("messages", """
SELECT DISTINCT account_id, vendor_key FROM messages WHERE subject = 'Out of office'"""))
def touched_vendors(spark, sf):
    ids = t.events(spark, sf).filter("event_type = 'error'").select(
        t.account().alias("account_id"), F.concat(F.lit("m"), "event_id").alias("message_id"))
    return rollups.touched_vendors(t.messages(spark, sf), ids)


# ---- fines ----------------------------------------------------------------------------------


def parsed(spark, sf):
    """The stored table of parsed fines."""
    return t.stored(spark, sf, "fines", lambda: enforcement.parse_enforcement(t.cells(spark, sf)))


def resolved(spark, sf):
    return enforcement.resolve_fines(parsed(spark, sf), t.fined_companies(spark, sf), t.overrides(spark, sf))


@register("enf_company_match", sql("fines companies", """
SELECT controller_slug, coalesce(exact_slug, prefix_slug, exact_name, prefix_name) AS auto_slug FROM (
  SELECT DISTINCT controller_slug,
    (SELECT slug FROM companies WHERE slug = controller_slug) AS exact_slug,
    (SELECT arg_max(slug, length(slug)) FROM companies WHERE starts_with(controller_slug, concat(slug, '-'))) AS prefix_slug,
    (SELECT concat('firm', s_suppkey) FROM supplier WHERE concat('handel-', s_suppkey) = controller_slug) AS exact_name,
    (SELECT concat('firm', s_suppkey) FROM supplier WHERE concat('handel-', s_suppkey, '-retail-group') = controller_slug) AS prefix_name
  FROM fines) WHERE auto_slug IS NOT NULL"""))
def enf_company_match(spark, sf):
    return enforcement.resolve_controllers(parsed(spark, sf), t.fined_companies(spark, sf)).select("controller_slug", "auto_slug")


@register("enf_override", sql("matched", "SELECT etid, company_slug, tier = 'override' AS overridden FROM matched"))
def enf_override(spark, sf):
    fines_df = parsed(spark, sf)
    auto = enforcement.resolve_controllers(fines_df, t.fined_companies(spark, sf))
    matched = fines_df.join(auto, "controller_slug", "left")
    return enforcement.apply_overrides(matched, t.overrides(spark, sf)).select("etid", "company_slug", "overridden")


@register("enf_confidence", sql("enforcement", """
SELECT etid, company_slug, CASE WHEN tier = 'name' THEN 'medium' ELSE 'high' END AS match_confidence FROM enforcement"""))
def enf_confidence(spark, sf):
    return resolved(spark, sf).select("etid", "company_slug", "match_confidence")


@register("enf_regulator", sql("enforcement", "SELECT etid, country, dpa_country FROM enforcement"))
def enf_regulator(spark, sf):
    return resolved(spark, sf).select("etid", "country", "dpa_country")


@register("enf_by_company", sql("enforcement", """
SELECT e.company_slug, e.etid, e.decision_date, coalesce(e.fine_eur, 0) AS fine_eur, s.total_fines
FROM enforcement e JOIN (SELECT company_slug, CAST(sum(coalesce(fine_eur, 0)) AS BIGINT) AS total_fines FROM enforcement GROUP BY 1) s
  USING (company_slug)"""))
def enf_by_company(spark, sf):
    return enforcement.fine_records(resolved(spark, sf)).select(
        "company_slug", "etid", "decision_date", F.coalesce("fine_eur", F.lit(0)).alias("fine_eur"), "total_fines")


@register("regulator_by_address", sql("companies", """
SELECT slug, CASE ord % 4 WHEN 0 THEN 'Germany' WHEN 1 THEN 'France' WHEN 2 THEN 'Spain' END AS by_address,
  CASE ord % 6 WHEN 0 THEN 'Netherlands' WHEN 1 THEN 'Denmark' WHEN 2 THEN 'United Kingdom'
    ELSE CASE ord % 4 WHEN 0 THEN 'Germany' WHEN 1 THEN 'France' WHEN 2 THEN 'Spain' END END AS by_code
FROM companies"""))
def regulator_by_address(spark, sf):
    code = F.when(F.col("ord") % 6 == 0, "nl").when(F.col("ord") % 6 == 1, "Denmark").when(
        F.col("ord") % 6 == 2, "GB").when(F.col("ord") % 6 == 3, "XX")
    return t.companies(spark, sf).select(
        "slug", fines.regulator_by_address(F.col("address")).alias("by_address"),
        fines.regulator_by_address(F.col("address"), code).alias("by_code"))


@register("regulator_by_tld", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Germany' WHEN 2 THEN 'United Kingdom' WHEN 3 THEN 'Portugal' END AS regulator
FROM events""")
def regulator_by_tld(spark, sf):
    domain = t.pick(["a{id}.DE", "a{id}.com", "a{id}.co.uk", "x.a{id}.pt"], F.col("event_id"))
    return t.events(spark, sf).select("event_id", fines.regulator_by_tld(domain).alias("regulator"))


@register("company_exact_name", sql("companies", """
SELECT query, slug FROM (SELECT DISTINCT concat('  SHOP', c_custkey, ' ltd. ') AS query, concat('shop', c_custkey, ' ltd.') AS key FROM customer)
JOIN companies c ON lower(c.name) = key"""))
def company_exact_name(spark, sf):
    queries = t.table(spark, sf, "customer").select(
        F.concat(F.lit("  SHOP"), "c_custkey", F.lit(" ltd. ")).alias("query")).distinct()
    return matching.company_by_name(queries, t.companies(spark, sf))


LANGUAGE = """CASE ord % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' WHEN 2 THEN 'es'
  ELSE CASE WHEN ord % 7 = 0 THEN 'it' WHEN ord % 3 = 0 THEN 'nl' ELSE 'en' END END"""


@register("request_language", sql("companies", f"SELECT slug, {LANGUAGE} AS language FROM companies"))
def request_language(spark, sf):
    manual = F.when(F.col("ord") % 7 == 0, " dpo@Firma.IT ").when(F.col("ord") % 7 == 1, "no mail")
    return requests.with_request_language(
        t.companies(spark, sf).withColumn("manual_email", manual)).select("slug", "language")
