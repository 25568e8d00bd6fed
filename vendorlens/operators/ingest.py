"""Raw mail of three source shapes to classified messages, row by row."""

from pyspark.sql import DataFrame, functions as F

from ..functions import addresses, classify, optout, senders, text
from ..functions.let import let


def message_id():
    """Id of a landing row; the mailbox protocol tells inbox and sent mail apart by a prefix."""
    prefix = F.when(F.col("folder") == "sent", "imap-sent-").otherwise("imap-")
    return F.when(F.col("source") == "imap", F.concat(prefix, F.col("id"))).otherwise(F.col("id"))


def normalize_messages(raw: DataFrame, keep=()) -> DataFrame:
    """One message table from the landing table, in a single pass over its rows.

    ``source`` tells the shape. ``gmail``: everything from the header list, internal date.
    ``microsoft``: sender and subject columns, received date, size of the body. ``imap``: header
    date only, inbox and sent folders told apart by the id prefix. ``keep`` names columns to pass on.
    """
    source = F.col("source")
    imap, graph = source == "imap", source == "microsoft"
    empty = F.lit("")
    needed = {"_from": "from", "_head": "subject", "_date": "date", "_list": "list-unsubscribe", "_post": "list-unsubscribe-post"}
    subject = F.when(graph, F.col("subject")).otherwise(F.col("_head"))
    dated = senders.message_date_ms(F.col("_date_ms"), F.col("ingest_ms"))
    snippet = F.when(imap, F.substring("body_text", 1, 200)).when(
        graph, F.substring("snippet", 1, 150)).otherwise(F.col("snippet"))
    preview_fallback = F.when(imap, F.col("body_text")).otherwise(F.col("snippet"))
    return (
        raw
        # Each layer binds what the next one uses several times; header names are lower-cased once.
        .withColumn("_names", senders.lower_names(F.col("headers")))
        .withColumns({c: senders.named_value(F.col("headers"), F.col("_names"), n) for c, n in needed.items()})
        # Generated, so that a filter by the address stays above it: pushed below, it would parse each sender a second time.
        .select("*", F.explode(F.array(senders.parse_sender(F.col("_from")))).alias("_sender"))
        .withColumns({"_subject": F.coalesce(subject, empty), "_date_ms": senders.header_date_ms(F.col("_date"))})
        .withColumn("_unsub", optout.resolve_unsubscribe(F.col("_list"), F.col("_post"), F.col("body_html"), F.col("_subject")))
        .select(
            "account_id",
            message_id().alias("message_id"),
            *keep,
            F.when(graph, F.lower(F.coalesce("from_email", empty)))
            .otherwise(F.col("_sender.email")).alias("sender_email"),
            F.when(graph, F.coalesce("from_name", empty))
            .otherwise(F.col("_sender.name")).alias("sender_name"),
            F.col("_subject").alias("subject"),
            F.when(imap, dated).when(graph, F.col("received_ms"))
            .otherwise(F.coalesce("received_ms", dated)).alias("date_ms"),
            text.body_preview(F.col("body_text"), F.col("body_html"), preview_fallback).alias("body_preview"),
            F.coalesce(snippet, empty).alias("snippet"),
            F.when(imap, senders.headers_map(F.col("headers"), "first"))
            .otherwise(senders.headers_map(F.col("headers"), "last")).alias("headers"),
            F.col("_unsub.url").alias("unsubscribe_url"),
            F.col("_unsub.method").alias("unsubscribe_method"),
            F.when(graph, F.length(F.coalesce("body_html", "body_text", empty)))
            .otherwise(F.coalesce("size_bytes", F.lit(0))).cast("bigint").alias("size_bytes"),
        ))


def keep_vendor_mail(messages: DataFrame, accounts: DataFrame = None) -> DataFrame:
    """Drops mail without a domain, from webmail domains, and from the account itself.

    ``accounts`` (account_id, email) is matched on the whole address.
    """
    domain = addresses.mail_domain(F.col("sender_email"))
    # Bound once: the filter is pushed below the parsing of the sender, which each mention of the address would repeat.
    kept = messages.filter(let(domain, lambda d: d.isNotNull() & ~addresses.is_personal_domain(d)))
    if accounts is None:
        return kept
    own = accounts.select("account_id", F.lower("email").alias("sender_email")).distinct()
    return kept.join(own, ["account_id", "sender_email"], "left_anti")


def classify_messages(messages: DataFrame) -> DataFrame:
    """Adds vendor key and message type, and the empty user status."""
    return messages.withColumns({
        "vendor_key": addresses.vendor_key(F.col("sender_email")),
        "type": classify.message_type(
            F.col("subject"), F.coalesce(F.nullif("body_preview", F.lit("")), "snippet"),
            F.col("unsubscribe_method"), F.col("unsubscribe_url"), F.col("headers")),
        "body_preview": F.coalesce(
            F.nullif("body_preview", F.lit("")), F.substring("snippet", 1, 150)),
        "status": F.lit(None).cast("string"),
    }).drop("snippet")


def ingest(raw: DataFrame, accounts: DataFrame = None, keep=()) -> DataFrame:
    """Landing rows to classified vendor messages."""
    return classify_messages(keep_vendor_mail(normalize_messages(raw, keep), accounts))
