"""Vendors to companies, and categories from companies or keywords."""

from pyspark.sql import DataFrame, Window, functions as F

from ..dims.domains import PERSONAL_DOMAINS
from ..functions import addresses, classify
from ..functions.text import ascii_lower
from .contains import TextIndex, contains_join, write_index
from .topk import subjects_sample

VENDOR = ["account_id", "vendor_key"]


def domain_index(companies: DataFrame) -> DataFrame:
    """One company per domain: the first by ordinal, then slug."""
    return (
        companies.select("ord", "slug", F.explode("domains").alias("domain"))
        .groupBy("domain").agg(F.min(F.struct("ord", "slug")).alias("first"))
        .select("domain", F.col("first.slug").alias("slug")))


def match_by_domain(vendors: DataFrame, companies: DataFrame) -> DataFrame:
    """Adds ``domain_slug``: the company that lists the vendor key among its domains."""
    index = domain_index(companies).select(
        F.col("domain").alias("vendor_key"), F.col("slug").alias("domain_slug"))
    return vendors.join(index, "vendor_key", "left")


def _texts_to_match(companies: DataFrame) -> DataFrame:
    """Names and brands as the name match reads them."""
    texts = companies.select(
        "ord", "slug",
        F.explode(F.array_compact(F.concat(
            F.array("name"), F.coalesce("runs", F.expr("array()").cast("array<string>"))))).alias("text"))
    return texts.withColumn("text", ascii_lower(F.col("text"))).distinct()


def _texts_to_search(companies: DataFrame) -> DataFrame:
    """Names and domains as the type-ahead reads them."""
    return companies.select(
        "slug", "name", F.explode(F.concat(F.array(F.lower("name")), F.coalesce("domains", F.expr("array()").cast("array<string>")))).alias("text"))


def company_index(companies: DataFrame, path: str = None) -> TextIndex:
    """The index of all company texts, stored once, for :func:`match_by_name` and :func:`company_search`."""
    return write_index(_texts_to_match(companies).select("text").union(_texts_to_search(companies).select("text")), 2, path)


def match_by_name(vendors: DataFrame, companies: DataFrame, index: TextIndex = None) -> DataFrame:
    """Adds ``name_slug``: the first company whose name or a brand contains the vendor name (3+ characters)."""
    needle = ascii_lower(F.col("name"))
    needles = vendors.filter(F.length("name") >= 3).select(needle.alias("needle")).distinct()
    # Of companies with an equal text only the first can be the answer, so a text that many share is one row.
    texts = _texts_to_match(companies).groupBy("text").agg(F.min(F.struct("ord", "slug")).alias("first"))
    found = contains_join(needles, texts, 3, index).groupBy("needle").agg(F.min("first").alias("first"))
    named = found.select("needle", F.col("first.slug").alias("name_slug"))
    return vendors.withColumn("needle", needle).join(named, "needle", "left").drop("needle")


def _by_domain(vendors: DataFrame, companies: DataFrame) -> DataFrame:
    """Vendors with ``domain_slug``, and ``_open``: whether they may take a company."""
    open_ = F.col("company_slug").isNull() & ~F.col("vendor_key").isin(PERSONAL_DOMAINS)
    return match_by_domain(vendors.withColumn("_open", open_), companies)


def name_matches(vendors: DataFrame, companies: DataFrame) -> DataFrame:
    """``name_slug`` of the vendors that are looked up by name: those without a company and with no company of their domain."""
    unnamed = _by_domain(vendors, companies).filter(F.col("_open") & F.col("domain_slug").isNull()).select(*VENDOR, "name")
    return match_by_name(unnamed, companies).select(*VENDOR, "name_slug")


def match_companies(vendors: DataFrame, companies: DataFrame, by_name: DataFrame = None) -> DataFrame:
    """Fills ``company_slug`` of unmatched vendors: by domain, else by name. Webmail keys are skipped. ``by_name``: their :func:`name_matches`,
    best read from a stored table, so that the lookup and this join don't share a stage."""
    by_domain = _by_domain(vendors, companies)
    by_name = name_matches(vendors, companies) if by_name is None else by_name
    slug = F.coalesce("company_slug", F.when(F.col("_open"), F.coalesce("domain_slug", "name_slug")))
    return (
        by_domain.join(by_name, VENDOR, "left")
        .withColumn("company_slug", slug).drop("_open", "domain_slug", "name_slug"))


def initial_vendors(keys: DataFrame, companies: DataFrame) -> DataFrame:
    """New vendors: company by domain with its name and first category, else a guessed name."""
    facts = companies.select(
        F.col("slug").alias("domain_slug"), F.col("name").alias("company_name"), "categories")
    matched = match_by_domain(keys.select(*VENDOR).distinct(), companies)
    joined = matched.join(facts, "domain_slug", "left")
    return joined.select(
        *VENDOR,
        F.col("domain_slug").alias("company_slug"),
        F.coalesce("company_name", addresses.inferred_name(F.col("vendor_key"))).alias("name"),
        F.coalesce(F.try_element_at("categories", F.lit(1)), F.lit("unknown")).alias("category_id"),
        F.lit("unknown").alias("risk_level"))


def categorize_matched(vendors: DataFrame, companies: DataFrame, app_categories=False) -> DataFrame:
    """Vendors with a company take its riskiest known category; with none known they stay as they are."""
    best = companies.select(
        F.col("slug").alias("company_slug"),
        classify.riskiest_category(F.col("categories"), app_categories=app_categories).alias("best"))
    joined = vendors.join(best.filter("best IS NOT NULL"), "company_slug", "left")
    return joined.withColumns({
        "category_id": F.coalesce("best.category", "category_id"),
        "risk_level": F.coalesce("best.risk", "risk_level"),
    }).drop("best")


def categorize_unmatched(vendors: DataFrame, messages: DataFrame) -> DataFrame:
    """Vendors without a company: first keyword found in name, key and up to ten subjects.

    Only the mail of these vendors is ranked.
    """
    open_ = vendors.filter("company_slug IS NULL").select(*VENDOR)
    return categorize_by_subjects(vendors, subjects_sample(messages.join(open_, VENDOR, "left_semi")))


def categorize_by_subjects(vendors: DataFrame, subjects: DataFrame) -> DataFrame:
    """:func:`categorize_unmatched` from ``subjects``: one text per vendor."""
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.col("vendor_key"), F.coalesce("subjects", F.lit("")))
    found = F.when(F.col("company_slug").isNull(), classify.keyword_category(text))
    return (
        vendors.join(subjects, VENDOR, "left")
        .withColumn("_found", found)
        .withColumns({
            "category_id": F.coalesce("_found.category", "category_id"),
            "risk_level": F.coalesce("_found.risk", "risk_level")})
        .drop("_found", "subjects"))


def company_by_name(queries: DataFrame, companies: DataFrame) -> DataFrame:
    """Company whose trimmed, lower-cased name equals the query; the first by ordinal."""
    named = (
        companies.select(F.lower(F.trim("name")).alias("key"), "ord", "slug")
        .groupBy("key").agg(F.min(F.struct("ord", "slug")).alias("first"))
        .select("key", F.col("first.slug").alias("slug")))
    keyed = queries.withColumn("key", F.nullif(F.lower(F.trim("query")), F.lit("")))
    return keyed.join(named, "key").drop("key")


def company_search(queries: DataFrame, companies: DataFrame, limit: int = 8, scan: int = None, most: int = 20, index: TextIndex = None) -> DataFrame:
    """Type-ahead: up to ``limit`` companies per query, name-prefix hits first, then by name.

    ``limit`` is at most ``most``. With ``scan``, only the first ``scan`` hits in name order are
    ranked, which is quicker and misses prefix hits after them; without it, all are.
    """
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    needle = F.trim(F.lower("query"))
    needles = queries.select(needle.alias("needle")).filter(F.length("needle") >= 2).distinct()
    hits = (
        contains_join(needles, _texts_to_search(companies), 2, index)
        .select("needle", "slug", "name", F.startswith(F.lower("name"), F.col("needle")).alias("prefix"))
        .distinct())
    if scan:
        in_name_order = Window.partitionBy("needle").orderBy("name", "slug")
        hits = hits.withColumn("_scan", F.row_number().over(in_name_order)).filter(F.col("_scan") <= scan)
    best_first = Window.partitionBy("needle").orderBy(F.desc("prefix"), "name", "slug")
    return (
        hits.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= limit)
        .select(F.col("needle").alias("query"), "rank", "slug", "name"))


def company_profile(companies: DataFrame) -> DataFrame:
    """Companies per quality value, and how many have domains."""
    return companies.groupBy(F.coalesce("quality", F.lit("unknown")).alias("quality")).agg(
        F.count(F.lit(1)).alias("companies"),
        F.count_if(F.size("domains") > 0).alias("with_domains"))


def merge_companies(base: DataFrame, curated: DataFrame) -> DataFrame:
    """Base rows, first of a slug wins; curated rows replace them, last of a slug wins."""
    def one(frame, order):
        rank = F.row_number().over(Window.partitionBy("slug").orderBy(order))
        return frame.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")

    kept = one(curated, F.desc("ord"))
    return one(base, F.asc("ord")).join(kept.select("slug"), "slug", "left_anti").unionByName(kept)
