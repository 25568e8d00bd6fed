"""Breach records joined with company, fines and regulator; documents for publishing."""

from pyspark.sql import DataFrame, functions as F

from ..functions import addresses, classify, fines, signals
from ..operators import enforcement as fine_ops
from ..operators.breaches import listed
from ..operators.joins import chunked_lists

# Credited source of a breach record without one of its own.
SOURCE_NAME = "haveibeenpwned.com"
SOURCE_URL = "https://haveibeenpwned.com/Breach/"


def breach_records(companies: DataFrame, breaches: DataFrame) -> DataFrame:
    """Company and its largest breach (ties by breach name), one row per company with any."""
    per_domain = listed(breaches).drop("slug").groupBy("domain").agg(
        F.min(F.struct(
            (-F.col("pwn_count")).alias("size"), "name", "domain", "title", "breach_date", "pwn_count",
            "attribution", "data_classes", "is_verified", "is_sensitive", "disclosure_url")).alias("b"))
    at = companies.select("slug", F.explode("domains").alias("domain"))
    best = at.join(per_domain, "domain").groupBy("slug").agg(F.min("b").alias("b"))
    facts = companies.select(
        "slug", F.col("name").alias("company_name"), "categories", "runs", "address", "web", "webform", "email")
    return best.join(facts, "slug").select(
        "slug", "company_name", "categories", "runs", "address", "web", "webform", "email",
        "b.name", "b.title", "b.domain", "b.breach_date", "b.pwn_count", "b.attribution", "b.data_classes",
        "b.is_verified", "b.is_sensitive", "b.disclosure_url")


def breach_pages(records: DataFrame, enforcement: DataFrame) -> DataFrame:
    """Page record: headline texts, severity, fines, regulator, contact."""
    totals = fine_ops.fines_by_company(enforcement).withColumnRenamed("company_slug", "slug")
    year = F.substring("breach_date", 1, 4)
    tail = F.lit(" Find out what data was leaked and what steps to take now.")
    description = F.concat(
        F.when(F.col("pwn_count") > 0, F.concat(
            signals.human_count(F.col("pwn_count")), F.lit(" records exposed in the "), F.col("title"),
            F.lit(" breach ("), year, F.lit(").")))
        .otherwise(F.concat(
            F.lit("Records exposed in the "), F.col("title"), F.lit(" breach ("), year,
            F.lit(") have not been disclosed."))), tail)
    regulator = F.coalesce(
        fines.regulator_by_address(F.col("address"), F.col("dpa_country")),
        fines.regulator_by_tld(F.col("domain")))
    joined = (
        records.join(totals, "slug", "left").withColumn("regulator_country", regulator)
        .withColumn("_regulator", fines.regulator_struct(F.col("regulator_country"))))
    return joined.select(
        "slug",
        F.concat("title", F.lit(" Data Breach - What to Do")).alias("page_title"),
        description.alias("page_description"),
        "company_name", F.col("web").alias("website"), "domain",
        classify.category_label(F.try_element_at("categories", F.lit(1))).alias("category_label"),
        "breach_date", "pwn_count", signals.severity(F.col("data_classes")).alias("severity"),
        F.lit(SOURCE_NAME).alias("source_name"), F.concat(F.lit(SOURCE_URL), "name").alias("source_url"),
        F.coalesce("fines", F.lit(0)).alias("fines"), F.coalesce("total_fines", F.lit(0)).alias("total_fines"),
        "regulator_country", *[F.col(f"_regulator.{f}").alias(f"regulator_{f}") for f in fines.REGULATOR_FACTS],
        F.coalesce("webform", F.concat(F.lit("mailto:"), "email")).alias("contact_url"))


def build_breach_docs(companies, breaches, enforcement, prior=None, per_part=1000) -> DataFrame:
    """Nested documents per company: breach, fines, and the hand-written fields of a prior version.

    The fines of a company come as one list; beyond ``per_part`` fines a company has several
    documents (``part``), each with the same head and its share of the list.
    """
    item = F.struct("decision_date", "etid", "controller", F.coalesce("fine_eur", F.lit(0)).alias("fine_eur"),
                    "authority", "dpa_country", "source_url")
    lists = chunked_lists(enforcement, ["company_slug"], item, per_part, ["etid"]).select(
        F.col("company_slug").alias("slug"), "part", "items")
    totals = enforcement.groupBy(F.col("company_slug").alias("slug")).agg(
        F.sum(F.coalesce("fine_eur", F.lit(0))).alias("total_fines"))
    docs = breach_records(companies, breaches)
    if prior is None:
        docs = docs.withColumns({"logoUrl": F.lit(None).cast("string"), "source": F.lit(None).cast("struct<name:string,url:string>")})
    else:
        kept = prior.select("slug", "logoUrl", F.col("breach.source").alias("source")).dropDuplicates(["slug"])
        docs = docs.join(kept, "slug", "left")
    head = [c for c in docs.columns if c not in ("slug", "logoUrl")]
    return (
        docs.join(totals, "slug", "left").join(lists, "slug", "left")
        .select(
            "slug", F.coalesce("part", F.lit(0)).cast("bigint").alias("part"), "logoUrl",
            F.struct(*head).alias("breach"),
            F.struct(
                F.coalesce("items", F.expr("array()")).alias("records"),
                F.coalesce("total_fines", F.lit(0)).alias("total_fines")).alias("enforcement")))
