"""Model tables derived from the given tables by plain expressions, on the Spark side."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import contains, ingest, matching, rollups
from ..plans import vendors as vendor_plans
from ..sources.scratch import scratch_path

AS_OF_MS = 1_706_659_200_000  # 2024-01-31T00:00:00Z
AS_OF_DAY = "2024-01-31"

# Entries every account starts with.
WHITELIST_VALUES = ["shop6.com", "news@shop1.co.uk", "zendesk.com"]

SENDER = """
CASE user_id % 8
  WHEN 0 THEN concat('noreply@mail.shop', user_id, '.com')
  WHEN 1 THEN concat('news@shop', user_id, '.co.uk')
  WHEN 2 THEN concat('pub', user_id, '@substack.com')
  WHEN 3 THEN concat('help@acme', user_id, '.zendesk.com')
  WHEN 4 THEN concat('ev', user_id, '@calendar.luma-mail.com')
  WHEN 5 THEN concat('person', user_id, '@gmail.com')
  WHEN 6 THEN concat('hi@shop', user_id, '.com')
  ELSE concat('info@bank', user_id, '.de') END
"""
SUBJECT = """
CASE event_type
  WHEN 'purchase' THEN concat('Invoice #', event_id)
  WHEN 'signup' THEN 'Welcome to the store'
  WHEN 'click' THEN 'Big sale this week'
  WHEN 'error' THEN 'Out of office'
  ELSE 'Lunch tomorrow?' END
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark, sf):
    return table(spark, sf, "events")


def pick(values, index):
    """The value at ``index % len(values)``; ``{id}`` in it becomes the index."""
    at = F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)
    return F.replace(at, F.lit("{id}"), index.cast("string"))


def account(key="event_id"):
    return F.concat(F.lit("a"), F.col(key) % 3)


def epoch_ms(column):
    """Epoch milliseconds of a zone-less timestamp, read as UTC."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def date_ms():
    return epoch_ms("ts") - (F.col("user_id") % 40) * 60 * 86_400_000


def size_bytes():
    return F.floor(F.col("value") * 100 + 0.5).cast("bigint")


def header(name, value):
    value = F.lit(value) if isinstance(value, str) else value
    return F.struct(F.lit(name).alias("name"), value.alias("value"))


def raw_messages(spark, sf) -> DataFrame:
    """The stored landing table."""
    return stored(spark, sf, "landing", lambda: landing_rows(spark, sf))


def with_bodies(rows, spark, sf, event="event_id"):
    """Mail with the number of a document has its whole text as body, mail with the number of a page its whole HTML."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias(event), F.col("text").alias("body_text"))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias(event), F.col("html").alias("body_html"))
    return rows.join(texts, event, "left").join(pages, event, "left")


def landing_rows(spark, sf) -> DataFrame:
    """Landing rows in the web-interface shape."""
    event, n = F.col("event_type"), F.col("event_id")
    name = F.concat(F.lit('"Sender '), n % 3, F.lit('" <'), F.col("_sender"), F.lit(">"))
    sender = F.when(n % 5 == 0, F.col("_sender")).otherwise(name)
    url = F.concat(F.lit("<https://u.example/"), n, F.lit("?k=1>"))
    none = F.expr("array()").cast("array<struct<name:string,value:string>>")
    click = F.when(
        n % 2 == 0, F.array(header("List-Unsubscribe", url), header("List-Unsubscribe-Post", "List-Unsubscribe=One-Click"))
    ).otherwise(F.array(header("List-Unsubscribe", url)))
    special = (
        F.when(event == "click", click)
        .when(event == "error", F.array(header("Auto-Submitted", "auto-replied"), header("List-Id", "<l>")))
        .when((event == "view") & (n % 4 == 0), F.array(header("X-Mailgun-Tag", "t")))
        .otherwise(none))
    return with_bodies(events(spark, sf), spark, sf).withColumn("_sender", F.expr(SENDER)).select(
        account().alias("account_id"), F.lit("gmail").alias("source"), F.lit("inbox").alias("folder"),
        F.concat(F.lit("m"), n).alias("id"), date_ms().alias("received_ms"),
        F.concat(F.array(header("From", sender), header("Subject", F.expr(SUBJECT))), special).alias("headers"),
        F.lit(None).cast("string").alias("from_email"), F.lit(None).cast("string").alias("from_name"),
        F.lit(None).cast("string").alias("subject"), "body_text", "body_html", F.concat(F.lit("Preview "), n).alias("snippet"),
        size_bytes().alias("size_bytes"), F.lit(AS_OF_MS).alias("ingest_ms"))


def with_status(messages):
    n = F.substring("message_id", 2, 20).cast("bigint")
    return messages.withColumn("status", F.when(n % 11 == 0, "unsubscribed"))


_STORED = {}
FILE_ROWS = 10_000


def stored(spark, sf, name, build) -> DataFrame:
    """A model table written once per session and read from then on, as the mail store keeps it.

    Queries read parquet with pruning and push-down, and a lost executor costs a re-read, not a
    re-run of the ingest.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        # Files of a bounded number of rows: a table that one task writes is read by many.
        build().write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def company_index(spark, sf):
    """The stored index of company texts, built once for all queries that look names up."""
    key = (spark.sparkContext.applicationId, sf, "company-index")
    if key not in _STORED:
        _STORED[key] = scratch_path(spark, "company-index")
        matching.company_index(companies(spark, sf), _STORED[key])
    return contains.read_index(spark, _STORED[key], 2)


def ingested(spark, sf) -> DataFrame:
    """Messages straight from the landing rows."""
    return with_status(ingest.ingest(raw_messages(spark, sf)))


def messages(spark, sf) -> DataFrame:
    return stored(spark, sf, "messages", lambda: ingested(spark, sf))


def message_vendors(spark, sf) -> DataFrame:
    """``account_id, vendor_key`` of every message. Where this session hasn't stored the messages yet, they are ingested for these two columns
    alone: Spark then neither parses bodies and wording nor writes the table, which a query of keys doesn't read."""
    known = (spark.sparkContext.applicationId, sf, "messages") in _STORED
    return (messages if known else ingested)(spark, sf).select(*rollups.VENDOR)


def accounts(spark, sf) -> DataFrame:
    n = F.col("n")
    return events(spark, sf).select((F.col("event_id") % 3).alias("n")).distinct().select(
        F.concat(F.lit("a"), n).alias("account_id"), F.concat(F.lit("Hi@Shop"), n * 8 + 6, F.lit(".com")).alias("email"))


def whitelist(spark, sf) -> DataFrame:
    values = F.array(*[F.lit(v) for v in WHITELIST_VALUES])
    return accounts(spark, sf).select("account_id", F.explode(values).alias("value")).withColumn(
        "created_at", F.timestamp_millis(F.lit(AS_OF_MS)))


def companies(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")

    def words(*names):
        return F.array(*[F.lit(x) for x in names])

    kind = F.col("s_nationkey") % 5
    return table(spark, sf, "supplier").select(
        k.alias("ord"),
        F.concat(F.lit("shop"), k, F.when(k % 10 == 9, "-de").otherwise("")).alias("slug"),
        F.concat(F.lit("Shop"), k, F.lit(" Ltd.")).alias("name"),
        F.array(F.concat(F.lit("Brand "), k, F.lit("X")), F.concat(F.lit("Line"), k % 7)).alias("runs"),
        F.when(kind == 0, words("shopping")).when(kind == 1, words("shopping", "financial"))
        .when(kind == 2, words("social")).when(kind == 3, words("entertainment")).alias("categories"),
        F.array(F.concat(F.lit("shop"), k, F.lit(".com")), F.concat(F.lit("shop"), k, F.lit(".co.uk"))).alias("domains"),
        pick(["Main St {id}\nBerlin\nGermany.", "{id} Rue Haute, Paris, France", "Calle {id}\n Madrid,  ESPAÑA\n",
              "Nowhere {id}"], k).alias("address"),
        F.concat(F.lit("https://www.shop"), k, F.lit(".com/")).alias("web"),
        F.when(k % 5 == 0, F.concat(F.lit("https://forms.shop"), k, F.lit(".com/x"))).alias("webform"),
        F.when(k % 3 != 2, F.concat(F.lit("privacy@Shop"), k, F.when(k % 3 == 0, ".nl").otherwise(".com"))).alias("email"),
        F.when(k % 3 == 0, "verified").when(k % 3 == 1, "tested").alias("quality"))


def fined_companies(spark, sf) -> DataFrame:
    """The companies, and firms whose slug says nothing about their name."""
    k = F.col("s_suppkey")
    firms = table(spark, sf, "supplier").select(
        (k + 1_000_000_000).alias("ord"), F.concat(F.lit("firm"), k).alias("slug"), F.concat(F.lit("Handel "), k, F.lit(" Ltd.")).alias("name"))
    return companies(spark, sf).select("ord", "slug", "name").unionByName(firms)


def breaches(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    day = F.date_format(F.date_add(F.lit("2016-01-01").cast("date"), F.col("p_size") * 60), "yyyy-MM-dd")
    kind = F.col("p_type")
    return table(spark, sf, "part").select(
        F.concat(F.lit("Breach"), k).alias("name"), F.concat(F.lit("Shop "), k).alias("title"),
        F.concat(F.lit("shop"), F.floor(k / 4), F.when(k % 12 == 0, ".co.uk").otherwise(".com")).alias("domain"),
        day.alias("breach_date"), F.floor(F.col("p_retailprice") * 100 + 0.5).cast("bigint").alias("pwn_count"),
        F.when(kind == "PROMO", F.array(F.lit("Credit cards"), F.lit("Names")))
        .when(kind == "SMALL", F.array(F.lit("Passwords"), F.lit("Email addresses")))
        .when(kind == "LARGE", F.array(F.lit("Phone numbers")))
        .otherwise(F.array(F.lit("Email addresses"))).alias("data_classes"),
        F.concat(F.lit("G"), F.col("p_size") % 5).alias("attribution"),
        F.lit(True).alias("is_verified"), F.lit(False).alias("is_sensitive"),
        F.lit(None).cast("string").alias("disclosure_url"))


def cells(spark, sf) -> DataFrame:
    """The stored raw rows of the fine register."""
    return stored(spark, sf, "cells", lambda: enforcement_cells(spark, sf))


def enforcement_cells(spark, sf) -> DataFrame:
    """Raw rows of fines. Some controllers are named as no company's slug, but as a company's name or the start of it."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    whole = F.format_number(F.floor("o_totalprice"), 0)
    cells = [
        F.lit(""), F.concat(F.lit("<b>ETid-"), k, F.lit("</b>")),
        F.concat(F.lit("<img src='f.png' /><br />"), pick(["AUSTRIA", "THE NETHERLANDS", "UNKNOWNIA", "CZECH REPUBLIC"], c)),
        F.concat(F.lit("Authority "), c % 5),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.when(k % 7 == 0, F.lit("Unknown")).otherwise(F.concat(F.lit("EUR "), whole)),
        F.concat(F.when(k % 5 == 4, "<b>Handel ").otherwise("<b>Shop"), c % 150, F.lit("</b>"), pick([" Ltd.", " Europe S.A.", " Retail Group"], k)),
        F.lit("Retail"), F.lit("Art. 5"), F.lit("Basis"), F.concat(F.lit("<p>Case "), k, F.lit("</p>")),
        F.concat(F.lit("<a href='https://d.example/"), k, F.lit("'>link</a>")), F.lit("")]
    return table(spark, sf, "orders").select(F.array(*cells).alias("row"))


def overrides(spark, sf) -> DataFrame:
    """Orders in progress: a forced slug for the urgent ones, a rejection for the others."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(
        F.concat(F.lit("ETid-"), "o_orderkey").alias("etid"), F.when(urgent, "shop1").alias("company_slug"))


def actions(spark, sf) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "unsubscribed").when(
        F.col("l_returnflag") == "A", "trashed").otherwise("spam_reported")
    return table(spark, sf, "lineitem").select(
        account("l_orderkey").alias("account_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("action_id"),
        F.concat(F.lit("shop"), "l_suppkey", F.lit(".com")).alias("vendor_key"), kind.alias("action_type"),
        F.lit(None).cast("string").alias("sender_email"), F.lit(None).cast("string").alias("unsubscribe_url"),
        F.col("l_quantity").cast("bigint").alias("message_count"),
        F.floor("l_extendedprice").cast("bigint").alias("size_bytes"),
        epoch_ms("l_shipdate").alias("actioned_at"))


def vendor_status(spark, sf) -> DataFrame:
    """User state: some vendors reviewed, some with a request sent."""
    from ..functions.addresses import vendor_key
    u = F.col("user_id")
    return events(spark, sf).select(
        account().alias("account_id"), vendor_key(F.expr(SENDER)).alias("vendor_key"),
        F.when(u % 9 == 0, "reviewed").when(u % 9 == 1, "gdpr_requested").alias("status")).filter(
        "status IS NOT NULL AND vendor_key <> 'gmail.com'").distinct()


def senders(spark, sf) -> DataFrame:
    """The stored sender rollup."""
    return stored(spark, sf, "senders", lambda: rollups.sender_rollup(messages(spark, sf)))


def built_vendors(spark, sf) -> DataFrame:
    """Vendors straight from the messages."""
    return vendor_plans.feature_vendors(
        messages(spark, sf), companies(spark, sf), whitelist(spark, sf), actions(spark, sf),
        breaches(spark, sf), AS_OF_MS, vendor_status(spark, sf), senders(spark, sf))


def named_vendors(spark, sf) -> DataFrame:
    """The stored vendors with the company of their domain and with their name, as the match by name reads them."""
    return stored(spark, sf, "vendor-named", lambda: vendor_plans.named_vendors(senders(spark, sf), companies(spark, sf)))


def name_matches(spark, sf) -> DataFrame:
    """The stored companies of vendors by name."""
    return stored(spark, sf, "vendor-by-name", lambda: matching.name_matches(named_vendors(spark, sf), companies(spark, sf)))


def matched_vendors(spark, sf) -> DataFrame:
    """The stored vendors with company, name and the category of the company."""
    return stored(spark, sf, "vendor-matched", lambda: vendor_plans.matched_vendors(
        senders(spark, sf), companies(spark, sf), named_vendors(spark, sf), name_matches(spark, sf)))


def base_vendors(spark, sf) -> DataFrame:
    """The stored vendors with category and status, without features."""
    return stored(spark, sf, "vendor-base", lambda: vendor_plans.build_vendors(
        messages(spark, sf), companies(spark, sf), vendor_status(spark, sf), senders(spark, sf), matched_vendors(spark, sf)))


def vendors(spark, sf) -> DataFrame:
    """The stored vendor table, features included. As :func:`built_vendors`, but joined from the stored base: all in one plan, the joins
    of messages, companies, actions and features run in one stage, whose tasks hold the memory of all of them at a time."""
    return stored(spark, sf, "vendors", lambda: vendor_plans.with_lists(
        base_vendors(spark, sf), senders(spark, sf), whitelist(spark, sf), actions(spark, sf), breaches(spark, sf), AS_OF_MS))


def release_assets(spark, sf) -> DataFrame:
    k = F.col("p_size")
    name = pick(["App-Setup-{id}.EXE", "app-{id}.dmg", "app-{id}.AppImage", "app-{id}.deb", "app-{id}.zip"], k)
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("tag"), name.alias("asset"), k.cast("bigint").alias("download_count"))


def change_feed(spark, sf) -> DataFrame:
    return events(spark, sf).select(
        F.lit("a0").alias("account_id"), F.concat(F.lit("m"), F.col("event_id") % 500).alias("message_id"),
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("op"))
