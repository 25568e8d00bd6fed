"""Data-subject requests: letter language and letters for many people and companies."""

from pyspark.sql import DataFrame, functions as F

from ..dims.letters import letter_rows
from ..functions import addresses, fines


def templates(spark) -> DataFrame:
    """The built-in letters as a table of fourteen rows."""
    return spark.createDataFrame(
        letter_rows(), "language string, action string, subject string, body string, ref_label string")


def with_request_language(companies: DataFrame) -> DataFrame:
    """Adds ``language``: of the regulator by address, else by the preferred domain, else of its TLD.

    The preferred domain is that of ``manual_email``, else of the company e-mail, else the first listed.
    """
    def host(col):
        return F.lower(addresses.mail_domain(F.trim(col)))

    manual = host(F.col("manual_email")) if "manual_email" in companies.columns else F.lit(None).cast("string")
    domain = F.coalesce(manual, host(F.col("email")), F.try_element_at("domains", F.lit(1)))
    address = F.nullif("address", F.lit(""))
    regulator = F.coalesce(fines.regulator_by_address(address), fines.regulator_by_tld(domain))
    language = F.coalesce(
        fines.regulator_language(regulator), fines.language_of_domain(domain), F.lit("en"))
    return companies.withColumn("language", language)


def request_batch(people: DataFrame, companies: DataFrame, letters: DataFrame, action: str) -> DataFrame:
    """One letter per person and listed company.

    ``people``: account_id, user_email, user_name, account_reference, company_slug. The letters
    have one row per language; an unknown language is written in English.
    """
    facts = with_request_language(companies).select(
        F.col("slug").alias("company_slug"), F.col("email").alias("company_email"), "language")
    known = [r for r in fines.LETTER_LANGUAGES]
    asked = people.join(facts, "company_slug")
    asked = asked.withColumn("language", F.when(F.col("language").isin(known), F.col("language")).otherwise("en"))
    texts = letters.filter(F.col("action") == action).select(
        "language", F.col("subject").alias("_subject"), F.col("body").alias("_body"), "ref_label")
    joined = asked.join(texts, "language")
    reference = F.nullif("account_reference", F.lit(""))
    ref_line = F.coalesce(F.concat(F.lit("\n- "), F.col("ref_label"), F.lit(": "), reference), F.lit(""))
    name = F.coalesce(F.nullif(F.trim("user_name"), F.lit("")), F.col("user_email"))
    body = F.replace(F.col("_body"), F.lit("%EMAIL%"), F.col("user_email"))
    body = F.replace(F.replace(body, F.lit("%ACCOUNT_REF%"), ref_line), F.lit("%NAME%"), name)
    return joined.select(
        "account_id", "user_email", "company_slug", "language",
        F.coalesce(F.nullif("company_email", F.lit("")), F.lit("privacy@company.com")).alias("recipient"),
        F.col("_subject").alias("subject"), body.alias("body"))
