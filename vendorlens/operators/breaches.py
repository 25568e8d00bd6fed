"""Breach matching. Ends-with comparisons are equality joins on exploded domain suffixes."""

from pyspark.sql import DataFrame, Window, functions as F

from ..dims.domains import COUNTRY_TLDS
from ..functions import addresses, classify, dates, signals

VENDOR = ["account_id", "vendor_key"]


def listed(breaches: DataFrame) -> DataFrame:
    """Breaches that name a domain, lower-cased."""
    return breaches.filter(F.col("domain") != "").withColumn("domain", F.lower(F.trim("domain")))


def suffix_pairs(keys: DataFrame, key: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows of ``keys`` joined to ``targets`` where the key equals the target or lies below it."""
    suffixed = keys.withColumn(target, F.explode(addresses.domain_suffixes(F.col(key))))
    return suffixed.join(targets, target)


def join_breaches(vendors: DataFrame, breaches: DataFrame) -> DataFrame:
    """Vendor and breach pairs: same domain, or the vendor is a subdomain. Keys are matched once
    each, whatever the number of accounts that share them."""
    keys = vendors.select("vendor_key").distinct()
    pairs = suffix_pairs(keys, "vendor_key", listed(breaches), "domain")
    return vendors.join(pairs, "vendor_key")


def on_breach_list(vendors: DataFrame, breaches: DataFrame) -> DataFrame:
    """Adds the flag ``on_breach_list``."""
    keys = vendors.select("vendor_key").distinct()
    domains = listed(breaches).select("domain").distinct()
    hit = suffix_pairs(keys, "vendor_key", domains, "domain").select("vendor_key").distinct()
    return (
        vendors.join(hit.withColumn("on_breach_list", F.lit(True)), "vendor_key", "left")
        .fillna({"on_breach_list": False}))


def breach_info(vendors: DataFrame, breaches: DataFrame) -> DataFrame:
    """Pairs with ``likely_affected``: the vendor was first seen before the day of the breach (UTC)."""
    day_ms = dates.day_start_ms(F.col("breach_date"))
    return join_breaches(vendors, breaches).withColumn(
        "likely_affected", F.coalesce(F.col("first_seen") < day_ms, F.lit(False)))


def exposed_classes(vendors: DataFrame, breaches: DataFrame) -> DataFrame:
    """Distinct data classes of the breaches that likely affect a vendor, one row each, with the
    newest breach date that exposed the class."""
    return (
        breach_info(vendors, breaches).filter("likely_affected")
        .select(*VENDOR, "breach_date", F.explode("data_classes").alias("data_class"))
        .groupBy(*VENDOR, "data_class").agg(F.max("breach_date").alias("newest")))


def lookup_breach(domains: DataFrame, breaches: DataFrame, since: str = None) -> DataFrame:
    """For each domain the largest breach at, above or below it, of those since a day if one is given."""
    asked = domains.select(F.lower(F.trim("domain")).alias("query")).filter("query <> ''").distinct()
    known = listed(breaches) if since is None else listed(breaches).filter(F.col("breach_date") >= since)
    known = known.select("domain", "slug", "title", "pwn_count")
    above = suffix_pairs(asked, "query", known, "domain").select("query", "slug", "title", "pwn_count")
    below = suffix_pairs(known, "domain", asked, "query").select("query", "slug", "title", "pwn_count")
    order = F.struct((-F.col("pwn_count")).alias("size"), "slug", "title")
    return (
        above.unionByName(below).groupBy("query").agg(F.min(order).alias("best"))
        .select("query", "best.slug", "best.title"))


def company_breaches(companies: DataFrame, breaches: DataFrame) -> DataFrame:
    """Company and breach pairs by equal domain."""
    at = companies.select(
        "slug", F.col("name").alias("company"), "categories", F.explode("domains").alias("domain"))
    return listed(breaches).drop("slug").join(at, "domain")


def top_breach(companies: DataFrame, breaches: DataFrame) -> DataFrame:
    """Largest breach per company (ties by breach name)."""
    per_domain = listed(breaches).groupBy("domain").agg(
        F.min(F.struct((-F.col("pwn_count")).alias("size"), "name", "domain", "breach_date",
                       "pwn_count", "attribution", "title")).alias("b"))
    at = companies.select("slug", F.explode("domains").alias("domain"))
    return (
        at.join(per_domain, "domain").groupBy("slug").agg(F.min("b").alias("b"))
        .select("slug", "b.name", "b.title", "b.domain", "b.breach_date", "b.pwn_count", "b.attribution"))


def _first_excluding_self(candidates: DataFrame, wanted: DataFrame, key: str, n: int) -> DataFrame:
    """The n newest candidates per wanted row that belong to another company.

    A company adds at most its n newest rows to a group, so the first 2n rows of the group
    always hold n rows of others: a group is cut to 2n rows before it meets its members, and
    a group of a third of all companies joins 2n rows, not itself.
    """
    newest = [F.desc("breach_date"), F.desc("pwn_count"), "candidate", "breach"]
    own = Window.partitionBy(key, "candidate").orderBy(*newest)
    group = Window.partitionBy(key).orderBy(*newest)
    short = (
        candidates.withColumn("own_rank", F.row_number().over(own)).filter(F.col("own_rank") <= n)
        .withColumn("group_rank", F.row_number().over(group)).filter(F.col("group_rank") <= 2 * n))
    pairs = wanted.join(short, key).filter("slug <> candidate")
    order = Window.partitionBy("slug", key).orderBy("group_rank")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def related_breaches(companies: DataFrame, breaches: DataFrame, as_of: str, n: int = 3) -> DataFrame:
    """Recent breaches related to each company's own: same attribution (12 months), same country
    domain (6 months), same sector (12 months); one row per relation and other company."""
    every = company_breaches(companies, breaches).select(
        F.col("slug").alias("candidate"), "company", F.col("name").alias("breach"), "categories",
        "domain", "breach_date", "pwn_count", "attribution").distinct()
    current = top_breach(companies, breaches).join(companies.select("slug", "categories"), "slug")

    def since(months):
        return every.filter(F.col("breach_date") >= F.date_format(
            F.add_months(F.lit(as_of).cast("date"), -months), "yyyy-MM-dd"))

    def relation(name, order, candidates, wanted, key):
        found = _first_excluding_self(
            candidates.filter(F.col(key).isNotNull()), wanted.filter(F.col(key).isNotNull()), key, n)
        return found.select(
            "slug", F.lit(name).alias("relation"), F.lit(order).alias("step"), F.col("pos"), "rank",
            "company", "breach_date", "pwn_count", "attribution_of")

    def tld(frame):
        top = addresses.top_level(F.col("domain"))
        return F.when(top.isin(COUNTRY_TLDS), top)

    def facts(frame):
        return frame.select(
            "candidate", "company", "breach", "breach_date", "pwn_count",
            F.col("attribution").alias("attribution_of"), "domain", "attribution", "categories")

    year, half = facts(since(12)), facts(since(6))
    by_attribution = relation(
        "same-attribution", 1, year.drop("domain", "categories"),
        current.select("slug", "attribution", F.lit(0).alias("pos")), "attribution")
    by_country = relation(
        "same-country", 2, half.withColumn("tld", tld(half)).drop("domain", "categories", "attribution"),
        current.select("slug", tld(current).alias("tld"), F.lit(0).alias("pos")), "tld")
    by_sector = relation(
        "same-sector", 3,
        year.withColumn("sector", F.explode("categories")).drop("domain", "categories", "attribution").distinct(),
        current.select("slug", F.posexplode("categories").alias("pos", "sector")), "sector")
    found = by_attribution.unionByName(by_country).unionByName(by_sector)
    return (
        found.groupBy("slug", "relation", "company")
        .agg(F.min(F.struct("pos", "rank", "breach_date", "pwn_count", "attribution_of")).alias("v"))
        .select("slug", "relation", "company", "v.breach_date", "v.pwn_count",
                F.col("v.attribution_of").alias("attribution")))


def breach_index(records: DataFrame, since: str = None) -> DataFrame:
    """Breach list, newest first, of those since a day if one is given: severity, logo, category label and icon."""
    recent = records if since is None else records.filter(F.col("breach_date") >= since)
    logo = F.col("logo_path") if "logo_path" in records.columns else F.lit(None).cast("string")
    category = F.try_element_at("categories", F.lit(1))
    return (
        recent
        .select(
            "slug", "title", logo.alias("logo_path"), "breach_date", "pwn_count",
            F.array_join("data_classes", ",").alias("data_classes"),
            signals.severity(F.col("data_classes")).alias("severity"),
            classify.category_label(category).alias("category_label"), classify.category_icon(category).alias("category_icon"))
        .orderBy(F.desc("breach_date"), F.desc("pwn_count"), "slug"))
