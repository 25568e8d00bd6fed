"""Readers and writers. Input files are written by Spark from the given tables, then read back."""

from pyspark.sql import functions as F

from ..operators import enforcement, matching, stats
from ..plans import breach_pages as pages
from ..sources import layout, readers, sinks
from ..sources.scratch import scratch_path
from . import tables as t
from .ctes import sql
from .registry import register


def company_objects(spark, sf):
    """Companies as the raw objects of the source files."""
    k = F.col("ord")
    kind = F.array(F.lit("commerce"), F.when(k % 2 == 0, "finance").otherwise("oddity"))
    return t.companies(spark, sf).select(
        "slug", "name", "runs", F.when(k % 4 != 0, kind).alias("categories"), "address", "web", "webform", "email",
        "quality", F.lit("email").alias("suggested-transport-medium"), F.array("slug").alias("relevant-countries"))


def company_files(spark, sf):
    path = scratch_path(spark, "companies")
    sinks.write_json_arrays(company_objects(spark, sf), path, ["slug"])
    return path


COMPANY_SQL = """
SELECT slug, name, concat_ws(',', concat('shop', ord, '.com'), CASE WHEN ord % 5 = 0 THEN concat('forms.shop', ord, '.com') END,
    CASE WHEN ord % 3 = 0 THEN concat('shop', ord, '.nl') END) AS domains,
  CASE WHEN ord % 4 = 0 THEN NULL WHEN ord % 2 = 0 THEN 'shopping,financial' ELSE 'shopping' END AS categories, quality FROM companies"""


def read_back(spark, sf):
    return readers.read_companies(spark, company_files(spark, sf), glob="*.txt")


@register("src_companies", sql("companies", COMPANY_SQL))
def src_companies(spark, sf):
    return read_back(spark, sf).select(
        "slug", "name", F.array_join("domains", ",").alias("domains"), F.array_join("categories", ",").alias("categories"), "quality")


@register("src_companies_merge", sql("companies", """
SELECT slug, CASE WHEN quality = 'verified' THEN concat('Curated ', ord) ELSE name END AS name FROM companies"""))
def src_companies_merge(spark, sf):
    companies = t.companies(spark, sf)
    base = companies.select("ord", "slug", "name")
    later = base.withColumns({"ord": F.col("ord") + 1_000_000, "name": F.lit("later copy")})
    first = companies.filter("quality = 'verified'").select("ord", "slug", F.lit("earlier").alias("name"))
    curated = first.unionByName(first.withColumns({
        "name": F.concat(F.lit("Curated "), "ord"), "ord": F.col("ord") + 1_000_000}))
    return matching.merge_companies(base.unionByName(later), curated).select("slug", "name")


@register("src_breaches", sql("breaches", """
SELECT name, CASE WHEN domain LIKE '%.uk' THEN NULL ELSE domain END AS domain, breach_date, pwn_count,
  array_to_string(data_classes, ',') AS data_classes, severity = 'low' AS is_verified, false AS is_sensitive FROM breaches"""))
def src_breaches(spark, sf):
    path = scratch_path(spark, "breaches")
    kind = F.array_join("data_classes", ",")
    objects = t.breaches(spark, sf).select(
        F.col("name").alias("Name"), F.col("title").alias("Title"),
        F.when(F.endswith("domain", F.lit(".uk")), "").otherwise(F.col("domain")).alias("Domain"),
        F.col("breach_date").alias("BreachDate"), F.col("pwn_count").alias("PwnCount"), F.col("data_classes").alias("DataClasses"),
        (kind == "Email addresses").alias("IsVerified"))
    sinks.write_json_arrays(objects, path, ["Name"])
    return readers.read_breaches(spark, path).select(
        "name", "domain", "breach_date", "pwn_count", F.array_join("data_classes", ",").alias("data_classes"),
        "is_verified", "is_sensitive")


@register("src_enforcement", sql("fines", """
SELECT etid, country, authority, decision_date, fine_eur, controller_slug, source_url, concat('Case ', k) AS description FROM fines"""))
def src_enforcement(spark, sf):
    path = scratch_path(spark, "fines")
    sinks.write_json_arrays(
        t.cells(spark, sf), path, ["row"], item=F.col("row"), head='{"data":[', tail="]}")
    parsed = enforcement.parse_enforcement(readers.read_enforcement(spark, path))
    return parsed.select("etid", "country", "authority", "decision_date", "fine_eur", "controller_slug", "source_url", "description")


@register("src_overrides", """
SELECT concat('ETid-', o_orderkey) AS etid, CASE WHEN o_orderpriority = '1-URGENT' THEN 'shop1' END AS company_slug
FROM orders WHERE o_orderstatus = 'P'""")
def src_overrides(spark, sf):
    path = scratch_path(spark, "overrides")
    slug = F.coalesce(F.concat(F.lit('"'), "company_slug", F.lit('"')), F.lit("null"))
    (t.overrides(spark, sf)
     .select(F.concat(F.lit('{"_comment":"x","'), "etid", F.lit('":'), slug, F.lit("}")).alias("value"))
     .write.option("maxRecordsPerFile", 1000).text(path))
    return readers.read_overrides(spark, path, lines=True)


@register("src_release_assets", """
SELECT p_brand AS tag, CASE WHEN p_size % 5 < 4 THEN concat('file-', p_partkey) END AS asset,
  CASE WHEN p_size % 5 < 4 THEN CAST(p_size AS BIGINT) END AS download_count FROM part""")
def src_release_assets(spark, sf):
    path = scratch_path(spark, "releases")
    asset = F.struct(F.concat(F.lit("file-"), "p_partkey").alias("name"), F.col("p_size").alias("download_count"))
    none = F.expr("array()").cast("array<struct<name:string,download_count:int>>")
    releases = t.table(spark, sf, "part").select(
        F.col("p_brand").alias("tag_name"), F.lit("2024-01-01T00:00:00Z").alias("published_at"),
        F.when(F.col("p_size") % 5 < 4, F.array(asset)).otherwise(none).alias("assets"), "p_partkey")
    sinks.write_json_arrays(releases, path, ["p_partkey"])
    return readers.read_releases(spark, path).select("tag", "asset", "download_count")


@register("src_messages_full", sql("messages", """
SELECT account_id, message_id, body_preview, date_ms FROM messages WHERE date_ms >= 1600000000000 AND date_ms < 1690000000000"""))
def src_messages_full(spark, sf):
    path = scratch_path(spark, "mail")
    sinks.write_table(sinks.with_month(t.messages(spark, sf)), path, ["msg_month"])
    found = readers.read_messages(spark, path, 1_600_000_000_000, 1_690_000_000_000)
    return found.select("account_id", "message_id", "body_preview", "date_ms")


@register("src_messages_headers", sql("messages", """
SELECT account_id, message_id, vendor_key, subject, date_ms, type FROM messages WHERE date_ms >= 1600000000000"""))
def src_messages_headers(spark, sf):
    found = readers.date_range(t.messages(spark, sf), 1_600_000_000_000, None, headers_only=True)
    return found.select("account_id", "message_id", "vendor_key", "subject", "date_ms", "type")


@register("src_backfill", sql("messages", f"""
WITH g AS (SELECT *, ({t.AS_OF_MS} - 1 - date_ms) // 7776000000 AS rg FROM messages
    WHERE date_ms < {t.AS_OF_MS} AND date_ms >= 788918400000),
f AS (SELECT account_id, rg, rg - coalesce(lag(rg) OVER (PARTITION BY account_id ORDER BY rg), -1) - 1 AS gap FROM (SELECT DISTINCT account_id, rg FROM g))
SELECT account_id, message_id, rg AS range FROM g WHERE rg < coalesce((SELECT min(rg) FROM f WHERE f.account_id = g.account_id AND gap >= 3), 100000)""").replace(
    ") WITH g AS", "), g AS", 1))
def src_backfill(spark, sf):
    return stats.backfill_ranges(t.messages(spark, sf), t.AS_OF_MS, 788_918_400_000).select("account_id", "message_id", "range")


def docs(spark, sf, prior=None):
    """Documents from the stored matched fines: lists, their lengths and totals each read them. Only what documents show is parsed."""
    shown = ["decision_date", "etid", "controller", "fine_eur", "authority", "source_url"]
    parsed = t.stored(spark, sf, "fines-shown", lambda: enforcement.parse_enforcement(t.cells(spark, sf)).select(*shown, "country", "controller_slug"))
    matched = enforcement.resolve_fines(parsed, t.fined_companies(spark, sf), t.overrides(spark, sf)).select("company_slug", "dpa_country", *shown)
    fines = t.stored(spark, sf, "fines-resolved", lambda: matched)
    return pages.build_breach_docs(t.companies(spark, sf), t.breaches(spark, sf), fines, prior)


DOCS_SQL = """
SELECT slug, name, pwn_count, (SELECT count(*) FROM enforcement e WHERE e.company_slug = r.slug) AS fines,
  (SELECT CAST(coalesce(sum(fine_eur), 0) AS BIGINT) FROM enforcement e WHERE e.company_slug = r.slug) AS total_fines,
  {0} AS logo FROM records r"""


def doc_columns(frame):
    """Documents by company; the parts of a long list of fines are counted together."""
    return frame.groupBy(
        "slug", F.col("breach.name").alias("name"), F.col("breach.pwn_count").alias("pwn_count"),
        F.col("enforcement.total_fines").alias("total_fines"), F.col("logoUrl").alias("logo")
    ).agg(F.sum(F.size("enforcement.records")).alias("fines"))


@register("src_breach_docs", sql("records enforcement", DOCS_SQL.format("CAST(NULL AS VARCHAR)")))
def src_breach_docs(spark, sf):
    path = scratch_path(spark, "docs")
    sinks.write_breach_docs(docs(spark, sf), path)
    return doc_columns(readers.read_breach_docs(spark, path, lines=True))


@register("sink_breach_docs", sql("records enforcement", DOCS_SQL.format(
    "CASE WHEN webform IS NOT NULL THEN concat('logo-', slug) END")))
def sink_breach_docs(spark, sf):
    path = scratch_path(spark, "docs")
    source = F.struct(F.lit("site").alias("name"), F.lit("https://site").alias("url"))
    prior = t.companies(spark, sf).filter("webform IS NOT NULL").select(
        "slug", F.concat(F.lit("logo-"), "slug").alias("logoUrl"), F.struct(source.alias("source")).alias("breach"))
    sinks.write_breach_docs(docs(spark, sf, prior), path)
    return doc_columns(readers.read_breach_docs(spark, path, lines=True))


@register("sink_companies_json", sql("companies", COMPANY_SQL))
def sink_companies_json(spark, sf):
    path = scratch_path(spark, "companies-out")
    sinks.write_companies(readers.companies_from_json(company_objects(spark, sf).withColumns({
        "phone": F.lit(None).cast("string"), "comments": F.lit(None).cast("array<string>")})), path)
    back = spark.read.schema("slug string, name string, domains array<string>, categories array<string>, quality string").json(path)
    return back.select(
        "slug", "name", F.array_join("domains", ",").alias("domains"), F.array_join("categories", ",").alias("categories"), "quality")


@register("sink_tables", sql("messages", """
SELECT account_id, message_id, CASE WHEN account_id = 'a1' THEN 'new' ELSE type END AS type FROM messages"""))
def sink_tables(spark, sf):
    path = scratch_path(spark, "table")
    rows = t.messages(spark, sf).select("account_id", "message_id", "type")
    sinks.write_table(rows, path, ["account_id"])
    sinks.write_table(rows.filter("account_id = 'a1'").withColumn("type", F.lit("new")), path, ["account_id"])
    return spark.read.parquet(path).select("account_id", "message_id", "type")


@register("src_messages_clustered", sql("messages", """
SELECT account_id, message_id, subject, date_ms FROM messages WHERE account_id = 'a1' AND date_ms >= 1600000000000 AND date_ms < 1690000000000"""))
def src_messages_clustered(spark, sf):
    path = scratch_path(spark, "clustered")
    layout.write_clustered(t.messages(spark, sf), path, 8)
    found = layout.read_clustered(spark, path, ["a1"], 1_600_000_000_000, 1_690_000_000_000, headers_only=True)
    return found.select("account_id", "message_id", "subject", "date_ms")
