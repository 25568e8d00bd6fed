"""Privacy fines: raw rows to typed rows, controller to company, totals."""

from pyspark.sql import DataFrame, functions as F

from ..functions import fines
from ..functions.text import first_href, strip_tags


def parse_enforcement(cells: DataFrame) -> DataFrame:
    """Rows of a 13-cell array ``row`` to typed columns."""
    def text(i):
        return F.nullif(strip_tags(F.try_element_at("row", F.lit(i + 1))), F.lit(""))

    def raw(i):
        return F.coalesce(F.try_element_at("row", F.lit(i + 1)), F.lit(""))

    controller = text(6)
    return cells.select(
        text(1).alias("etid"),
        fines.country_name(raw(2)).alias("country"),
        text(3).alias("authority"),
        text(4).alias("decision_date"),
        fines.fine_eur(raw(5)).alias("fine_eur"),
        text(5).alias("fine_text"),
        controller.alias("controller"),
        fines.controller_slug(controller).alias("controller_slug"),
        text(7).alias("sector"),
        text(8).alias("articles_violated"),
        text(9).alias("violation_type"),
        text(10).alias("description"),
        first_href(raw(11)).alias("source_url"))


def match_index(companies: DataFrame) -> DataFrame:
    """Keys a controller can match: every slug, and unambiguous names of companies that are not national."""
    slugs = companies.select(F.col("slug").alias("key"), F.lit("slug").alias("kind"), F.col("slug").alias("target"))
    names = (
        companies.filter(~fines.is_country_slug(F.col("slug")))
        .select(fines.name_slug(F.col("name")).alias("key"), "slug")
        .filter("key <> ''").groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("slug").alias("target"))
        .filter("n = 1")
        .select("key", F.lit("name").alias("kind"), "target"))
    return slugs.distinct().unionByName(names)


def resolve_controllers(slugs: DataFrame, companies: DataFrame, min_prefix: int = 8) -> DataFrame:
    """Distinct ``controller_slug`` to ``auto_slug`` and ``tier``: exact slug, longest slug prefix,
    exact name, longest name prefix. Prefixes are exploded, so each tier is an equality join."""
    prefixes = slugs.select("controller_slug").filter("controller_slug <> ''").distinct().withColumn(
        "key", F.explode(fines.hyphen_prefixes(F.col("controller_slug"))))
    hits = prefixes.join(match_index(companies), "key")
    whole = F.col("key") == F.col("controller_slug")
    by_slug = F.col("kind") == "slug"
    tier = (
        F.when(by_slug & whole, 1).when(by_slug, 2).when(whole, 3)
        .when(F.length("key") >= min_prefix, 4))
    best = F.min(F.struct("tier", (-F.length("key")).alias("short"), "target"))
    return (
        hits.withColumn("tier", tier).filter("tier IS NOT NULL")
        .groupBy("controller_slug").agg(best.alias("best"))
        .select("controller_slug", F.col("best.target").alias("auto_slug"), "best.tier"))


def apply_overrides(fines_df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Adds ``company_slug``: a listed override wins, also when it is null (a rejected match)."""
    listed = overrides.select("etid", F.col("company_slug").alias("forced")).withColumn("overridden", F.lit(True))
    return (
        fines_df.join(listed, "etid", "left")
        .withColumn("overridden", F.coalesce("overridden", F.lit(False)))
        .withColumn("company_slug", F.when(F.col("overridden"), F.col("forced")).otherwise(F.col("auto_slug")))
        .drop("forced"))


def match_confidence(fines_df: DataFrame) -> DataFrame:
    """Keeps matched fines; medium for a match by name, high otherwise."""
    by_name = ~F.col("overridden") & F.col("tier").isin(3, 4)
    return fines_df.filter("company_slug IS NOT NULL").withColumn(
        "match_confidence", F.when(by_name, "medium").otherwise("high"))


def resolve_enforcement(cells: DataFrame, companies: DataFrame, overrides: DataFrame) -> DataFrame:
    """Raw cells to matched fines with confidence and regulator country."""
    return resolve_fines(parse_enforcement(cells), companies, overrides)


def resolve_fines(parsed: DataFrame, companies: DataFrame, overrides: DataFrame) -> DataFrame:
    """Parsed fines, best read from a stored table, to matched ones. They are used twice: for their
    distinct slugs and for the rows themselves."""
    targets = resolve_controllers(parsed, companies)
    matched = parsed.join(targets, "controller_slug", "left")
    kept = match_confidence(apply_overrides(matched, overrides))
    return kept.withColumn("dpa_country", fines.regulator_of_country(F.col("country")))


def tier_of():
    """Name of the tier that matched a fine."""
    return F.when(F.col("overridden"), "override").otherwise(
        F.try_element_at(F.array(F.lit("exact"), F.lit("prefix"), F.lit("name"), F.lit("name")), F.col("tier")))


def enforcement_profile(resolved: DataFrame) -> DataFrame:
    """Stored fines per match tier, and how many have a regulator."""
    return resolved.groupBy(tier_of().alias("tier")).agg(
        F.count(F.lit(1)).alias("fines"), F.count("dpa_country").alias("with_regulator"))


def fines_by_company(enforcement: DataFrame) -> DataFrame:
    """Fines and total per company (an unknown fine counts as 0), with the newest decision."""
    newest = F.struct("decision_date", "etid", "authority", "dpa_country")
    return (
        enforcement.groupBy("company_slug").agg(
            F.count(F.lit(1)).alias("fines"),
            F.sum(F.coalesce("fine_eur", F.lit(0))).alias("total_fines"),
            F.max(newest).alias("newest"))
        .select("company_slug", "fines", "total_fines", F.col("newest.etid").alias("newest_etid"),
                F.col("newest.decision_date").alias("newest_date"), F.col("newest.dpa_country").alias("dpa_country")))


def fine_records(enforcement: DataFrame) -> DataFrame:
    """Every fine beside its company's total. Readers of a list sort it: newest first within the company."""
    totals = fines_by_company(enforcement).select("company_slug", "total_fines")
    return enforcement.join(totals, "company_slug")
