"""Readers of the reference datasets and of stored messages. Every schema is declared."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import addresses, classify
from ..functions.dates import utc_month

COMPANY_JSON = """
slug string, name string, runs array<string>, categories array<string>, address string, web string,
webform string, email string, phone string, quality string, comments array<string>,
`suggested-transport-medium` string, _corrupt string
"""
BREACH_JSON = """
Name string, Title string, Domain string, BreachDate string, AddedDate string, ModifiedDate string,
PwnCount bigint, Description string, Attribution string, DisclosureUrl string,
DataClasses array<string>, IsVerified boolean, IsSensitive boolean, LogoPath string
"""
RELEASE_JSON = "tag_name string, published_at timestamp, assets array<struct<name:string,download_count:bigint>>"
DOC_JSON = """
slug string, generated_at string, logoUrl string,
breach struct<name:string,title:string,domain:string,breach_date:string,pwn_count:bigint,
  data_classes:array<string>,categories:array<string>,slug:string,company_name:string,address:string,
  web:string,webform:string,email:string,source:struct<name:string,url:string>>,
enforcement struct<records:array<struct<etid:string,controller:string,fine_eur:bigint,decision_date:string,
  authority:string,dpa_country:string,source_url:string,company_slug:string>>,total_fines:bigint>
"""


def companies_from_json(rows: DataFrame) -> DataFrame:
    """Company objects to the dimension: derived domains, mapped categories, ordinal by slug."""
    categories = classify.map_categories(F.col("categories"))
    return rows.select(
        "slug", "name", "runs",
        F.when(F.size(categories) > 0, categories).alias("categories"),
        addresses.company_domains(F.col("web"), F.col("webform"), F.col("email")).alias("domains"),
        "address", "web", "webform", "email", "phone", "quality", "comments",
        F.col("suggested-transport-medium").alias("suggested_transport_medium"),
        F.col("slug").alias("ord"))


def read_companies(spark: SparkSession, path: str, glob="*.json") -> DataFrame:
    """A directory of one-object JSON files. Unreadable files and other endings are skipped. The
    ordinal of a company is its slug, the order of the directory listing."""
    rows = (
        spark.read.schema(COMPANY_JSON).option("multiLine", True).option("pathGlobFilter", glob)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path))
    return companies_from_json(rows.filter("_corrupt IS NULL AND slug IS NOT NULL AND name IS NOT NULL"))


def read_breaches(spark: SparkSession, path: str) -> DataFrame:
    """Breach catalogue: empty texts become null, flags become booleans."""
    rows = spark.read.schema(BREACH_JSON).option("multiLine", True).json(path)

    def text(name):
        return F.nullif(name, F.lit(""))

    return rows.select(
        F.col("Name").alias("name"), F.col("Title").alias("title"), text("Domain").alias("domain"),
        text("BreachDate").alias("breach_date"), text("AddedDate").alias("added_date"),
        text("ModifiedDate").alias("modified_date"), F.col("PwnCount").alias("pwn_count"),
        text("Description").alias("description"), text("Attribution").alias("attribution"),
        text("DisclosureUrl").alias("disclosure_url"), F.col("DataClasses").alias("data_classes"),
        F.coalesce("IsVerified", F.lit(False)).alias("is_verified"),
        F.coalesce("IsSensitive", F.lit(False)).alias("is_sensitive"), text("LogoPath").alias("logo_path"))


def read_enforcement(spark: SparkSession, path: str) -> DataFrame:
    """Fine register ``{"data": [[13 cells], ...]}`` to one array column ``row``."""
    return (
        spark.read.schema("data array<array<string>>").option("multiLine", True).json(path)
        .select(F.explode("data").alias("row")))


def _documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """``file, text, document`` (a VARIANT, null where the text is no JSON) of every file or line."""
    return (spark.read.text(path, wholetext=not lines).filter(F.trim("value") != "")
            .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"), F.try_parse_json("value").alias("document")))


def read_overrides(spark: SparkSession, path: str, lines=False) -> DataFrame:
    """Key to slug-or-null map, one object per file or per line; keys that open with ``_`` are comments. What is no object
    is in :func:`broken_documents`."""
    found = _documents(spark, path, lines).filter(F.schema_of_variant("document").startswith("OBJECT"))
    entries = found.lateralJoin(spark.tvf.variant_explode(F.col("document").outer()))
    return (entries.select(F.col("key").alias("etid"), F.try_variant_get("value", "$", "string").alias("company_slug"))
            .filter(~F.startswith("etid", F.lit("_"))))


def broken_documents(spark: SparkSession, path: str, lines=False, shown: int = 200) -> DataFrame:
    """``file, reason, text`` of the files or lines that hold no JSON, or no object; of the text, the first ``shown`` characters."""
    rows = _documents(spark, path, lines)
    kind = F.schema_of_variant("document")
    reason = F.when(F.col("document").isNull(), "no JSON").when(~kind.startswith("OBJECT"), F.concat(F.lit("no object: "), kind))
    return rows.select("file", reason.alias("reason"), F.substring("text", 1, shown).alias("text")).filter("reason IS NOT NULL")


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """Releases with nested files to one row per file; a release without files keeps a row."""
    return (
        spark.read.schema(RELEASE_JSON).option("multiLine", True).json(path)
        .select(F.col("tag_name").alias("tag"), "published_at", F.explode_outer("assets").alias("a"))
        .select("tag", "published_at", F.col("a.name").alias("asset"), "a.download_count"))


def read_breach_docs(spark: SparkSession, path: str, lines=False) -> DataFrame:
    """Per-company breach documents: one per file, or one per line as :func:`write_breach_docs` leaves them."""
    return spark.read.schema(DOC_JSON).option("pathGlobFilter", "*.json").option("multiLine", not lines).json(path)


HEADER_COLUMNS = [
    "account_id", "message_id", "vendor_key", "sender_email", "sender_name", "subject", "date_ms",
    "headers", "type", "unsubscribe_url", "unsubscribe_method", "status", "size_bytes"]


def date_range(messages: DataFrame, since_ms: int = None, until_ms: int = None, headers_only=False) -> DataFrame:
    """Messages of [since, until); ``headers_only`` never touches the body column."""
    found = messages
    if since_ms is not None:
        found = found.filter(F.col("date_ms") >= since_ms)
    if until_ms is not None:
        found = found.filter(F.col("date_ms") < until_ms)
    return found.select(*[c for c in HEADER_COLUMNS if c in found.columns]) if headers_only else found


def read_messages(spark: SparkSession, path: str, since_ms=None, until_ms=None, headers_only=False) -> DataFrame:
    """Stored messages of a date range. The month partition prunes files, the range filter reaches
    the parquet scan."""
    found = spark.read.parquet(path)
    if "msg_month" in found.columns:
        if since_ms is not None:
            found = found.filter(F.col("msg_month") >= utc_month(F.lit(since_ms)))
        if until_ms is not None:
            found = found.filter(F.col("msg_month") <= utc_month(F.lit(until_ms)))
    return date_range(found, since_ms, until_ms, headers_only)
