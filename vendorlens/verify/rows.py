"""Row-wise queries: normalization, opt-out links, classification, keys, report columns."""

from pyspark.sql import functions as F

from ..functions import addresses, classify, fines, optout, quality, senders, signals, text
from ..operators import ingest
from . import tables as t
from .ctes import DATE_MS, SIZE, WHITE, sql
from .registry import register

def ID():
    return F.col("event_id")


def pages(spark, sf):
    return t.table(spark, sf, "pages")


# ---- messages -----------------------------------------------------------------------------

FROM_FORMS = ['"Ann Lee {id}" <Ann.{id}@Shop.COM>', "Bob {id} <bob{id}@x.org>", "<only{id}@X.org>",
              "plain{id}@Mail.Example", "see dirty{id}@y.io please", " No Address {id} "]


@register("norm_sender", """
SELECT event_id,
  CASE event_id % 6 WHEN 0 THEN concat('Ann Lee ', event_id) WHEN 1 THEN concat('Bob ', event_id) ELSE '' END AS name,
  CASE event_id % 6 WHEN 0 THEN concat('ann.', event_id, '@shop.com') WHEN 1 THEN concat('bob', event_id, '@x.org')
    WHEN 2 THEN concat('only', event_id, '@x.org') WHEN 3 THEN concat('plain', event_id, '@mail.example')
    WHEN 4 THEN concat('dirty', event_id, '@y.io') ELSE concat('no address ', event_id) END AS email
FROM events""")
def norm_sender(spark, sf):
    parsed = senders.parse_sender(t.pick(FROM_FORMS, ID()))
    return t.events(spark, sf).select("event_id", parsed.alias("s")).select("event_id", "s.name", "s.email")


def mail_date(ts):
    return F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))


@register("norm_date", f"""
SELECT event_id, CASE WHEN event_id % 10 < 3 THEN {t.AS_OF_MS}
  ELSE epoch_us(date_trunc('second', ts)) // 1000 END AS date_ms
FROM events""")
def norm_date(spark, sf):
    k = ID() % 10
    raw = F.when(k == 0, "Sat, 1 Jan 2000 00:00:00 +0000").when(k == 1, "not a date").when(k > 2, mail_date(F.col("ts")))
    dated = senders.message_date_ms(senders.header_date_ms(raw), F.lit(t.AS_OF_MS))
    return t.events(spark, sf).select("event_id", dated.alias("date_ms"))


HTML_SQL = r"""
trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<style.*?</style>', '', 'g'),
  '(?is)<script.*?</script>', '', 'g'), '<[^>]*>', ' ', 'g'), '[{1}]+', ' ', 'g'))
"""


def html_sql(column):
    return HTML_SQL.format(column, WHITE)


@register("html_to_text", f"SELECT page_id, {html_sql('html')} AS text FROM pages")
def html_to_text(spark, sf):
    return pages(spark, sf).select("page_id", text.html_to_text(F.col("html")).alias("text"))


@register("strip_tags", f"""
SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[{WHITE}]+', ' ', 'g')) AS text
FROM pages""")
def strip_tags(spark, sf):
    return pages(spark, sf).select("page_id", text.strip_tags(F.col("html")).alias("text"))


@register("norm_preview", f"""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN trim(left({html_sql('html')}, 150)) WHEN 1 THEN left(trim(url), 150)
  ELSE concat('Snippet ', page_id) END AS preview FROM pages""")
def norm_preview(spark, sf):
    k = F.col("page_id") % 3
    body = F.when(k == 1, F.concat(F.lit("  "), "url", F.lit("\n")))
    preview = text.body_preview(
        body, F.when(k == 0, F.col("html")), F.concat(F.lit("Snippet "), "page_id"))
    return pages(spark, sf).select(
        "page_id", F.when(k == 0, F.trim(preview)).otherwise(preview).alias("preview"))


def joined_map(column):
    entries = F.array_sort(F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.array_join(entries, ";")


@register("norm_headers", """
SELECT event_id,
  concat('list-id=<', event_id, '>;received=one ', event_id) AS first_wins,
  concat('List-Id=<', event_id, '>;Received=two;X-Empty=') AS last_wins
FROM events""")
def norm_headers(spark, sf):
    raw = F.array(
        t.header("Received", F.concat(F.lit(" one "), ID())), t.header("X-Empty", ""),
        t.header("Received", "two"), t.header("List-Id", F.concat(F.lit("<"), ID(), F.lit(">"))))
    return t.events(spark, sf).select(
        "event_id", joined_map(senders.headers_map(raw, "first")).alias("first_wins"),
        joined_map(senders.headers_map(raw, "last")).alias("last_wins"))


def shaped_raw(spark, sf):
    """Landing rows of all three shapes."""
    kind = ID() % 3
    imap, graph = kind == 1, kind == 2
    base = F.array(
        t.header("From", F.concat(F.lit("Ann <Ann"), ID(), F.lit("@Shop.com>"))),
        t.header("Subject", F.concat(F.lit("Hello "), ID())), t.header("Date", mail_date(F.col("ts"))),
        t.header("List-Unsubscribe", F.concat(F.lit("<mailto:u@x>, <http://x/"), ID(), F.lit(">"))))
    return t.events(spark, sf).select(
        t.account().alias("account_id"),
        F.when(kind == 0, "gmail").when(imap, "imap").otherwise("microsoft").alias("source"),
        F.when(ID() % 2 == 0, "sent").otherwise("inbox").alias("folder"), ID().cast("string").alias("id"),
        F.when(~imap & (ID() % 6 != 0), t.epoch_ms("ts")).alias("received_ms"),
        base.alias("headers"), F.concat(F.lit("Info@Graph"), ID(), F.lit(".com")).alias("from_email"),
        F.lit("Graph").alias("from_name"), F.concat(F.lit("Graph subject "), ID()).alias("subject"),
        F.when(imap, F.concat(F.lit(" body \n "), ID())).alias("body_text"),
        F.when(graph, F.concat(F.lit("<p>html "), ID(), F.lit("</p>"))).alias("body_html"),
        F.concat(F.lit("snip "), ID()).alias("snippet"), t.size_bytes().alias("size_bytes"),
        F.lit(t.AS_OF_MS).alias("ingest_ms"))


@register("norm_messages", f"""
SELECT concat('a', event_id % 3) AS account_id,
  CASE event_id % 3 WHEN 1 THEN concat(CASE WHEN event_id % 2 = 0 THEN 'imap-sent-' ELSE 'imap-' END, event_id)
    ELSE CAST(event_id AS VARCHAR) END AS message_id,
  CASE event_id % 3 WHEN 2 THEN concat('info@graph', event_id, '.com') ELSE concat('ann', event_id, '@shop.com') END AS sender_email,
  CASE event_id % 3 WHEN 2 THEN 'Graph' ELSE 'Ann' END AS sender_name,
  CASE event_id % 3 WHEN 2 THEN concat('Graph subject ', event_id) ELSE concat('Hello ', event_id) END AS subject,
  CASE WHEN event_id % 3 = 1 OR event_id % 6 = 0 THEN epoch_us(date_trunc('second', ts)) // 1000
    ELSE epoch_us(ts) // 1000 END AS date_ms,
  CASE event_id % 3 WHEN 0 THEN concat('snip ', event_id) WHEN 1 THEN concat('body ', event_id)
    ELSE concat('html ', event_id) END AS body_preview,
  CASE event_id % 3 WHEN 1 THEN 'date,from,list-unsubscribe,subject' ELSE 'Date,From,List-Unsubscribe,Subject' END AS header_names,
  concat('http://x/', event_id) AS unsubscribe_url, 'list-unsubscribe' AS unsubscribe_method,
  CASE event_id % 3 WHEN 2 THEN length(concat('<p>html ', event_id, '</p>')) ELSE {SIZE} END AS size_bytes
FROM events""")
def norm_messages(spark, sf):
    return ingest.normalize_messages(shaped_raw(spark, sf)).withColumn(
        "header_names", F.array_join(F.array_sort(F.map_keys("headers")), ",")).drop("headers", "snippet")


# ---- opt-out ------------------------------------------------------------------------------

LIST_FORMS = ["<mailto:u{id}@x.com>, <http://x.com/{id}>, <https://x.com/{id}>", "<mailto:u{id}@x.com>, <http://x.com/{id}>",
              "<mailto:u{id}@x.com>", "https://raw.com/{id}", "nothing {id}", "<ftp://x/{id}>", ""]


@register("unsub_header", """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN concat('https://x.com/', event_id) WHEN 1 THEN concat('http://x.com/', event_id)
  WHEN 2 THEN concat('mailto:u', event_id, '@x.com') WHEN 3 THEN concat('https://raw.com/', event_id) END AS url
FROM events""")
def unsub_header(spark, sf):
    return t.events(spark, sf).select(
        "event_id", optout.list_unsubscribe_url(t.pick(LIST_FORMS, ID())).alias("url"))


@register("unsub_oneclick", """
SELECT event_id, event_id % 7 IN (0, 3) AND event_id % 2 = 0 AS one_click FROM events""")
def unsub_oneclick(spark, sf):
    post = F.when(ID() % 2 == 0, "list-unsubscribe = one-click").when(ID() % 4 == 1, "other")
    return t.events(spark, sf).select("event_id", optout.is_one_click(t.pick(LIST_FORMS, ID()), post).alias("one_click"))


FOOTER = ['<a class="b" href="https://mail.example/u/{id}"><span>Click to Unsubscribe</span></a>',
          "<a href='https://x.example/a'>More</a><A  HREF = 'https://x.example/OptOut/{id}'>here</A>",
          '<a href="mailto:unsubscribe{id}@x.com">unsubscribe</a>', "<p>bye</p>",
          '<a href="https://x.example/optout">no</a> <a href="https://fr.example/{id}">Se désabonner</a>']


def with_footer():
    return F.concat(F.col("html"), t.pick(FOOTER, F.col("page_id")))


FOOTER_SQL = """
CASE page_id % 5 WHEN 0 THEN concat('https://mail.example/u/', page_id)
  WHEN 1 THEN concat('https://x.example/OptOut/', page_id) WHEN 4 THEN concat('https://fr.example/', page_id) END
"""


@register("unsub_footer", f"SELECT page_id, {FOOTER_SQL} AS url FROM pages")
def unsub_footer(spark, sf):
    return pages(spark, sf).select("page_id", optout.footer_unsubscribe_url(with_footer()).alias("url"))


@register("unsub_resolve", f"""
WITH p AS (SELECT page_id, page_id % 4 AS k, {FOOTER_SQL} AS footer FROM pages)
SELECT page_id,
  CASE k WHEN 0 THEN 'rfc8058' WHEN 1 THEN 'list-unsubscribe' ELSE CASE WHEN k = 2 AND footer IS NOT NULL THEN 'footer' ELSE 'none' END END AS method,
  CASE k WHEN 0 THEN concat('https://h/', page_id) WHEN 1 THEN concat('http://h/', page_id) WHEN 2 THEN footer END AS url
FROM p""")
def unsub_resolve(spark, sf):
    k, n = F.col("page_id") % 4, F.col("page_id")
    listed = F.when(k == 0, F.concat(F.lit("<https://h/"), n, F.lit(">"))).when(k == 1, F.concat(F.lit("<http://h/"), n, F.lit(">")))
    post = F.when(k < 2, "List-Unsubscribe=One-Click")
    subject = F.when(k == 3, " FWD : News").otherwise("News")
    found = optout.resolve_unsubscribe(listed, post, with_footer(), subject)
    return pages(spark, sf).select("page_id", found.alias("u")).select("page_id", "u.method", "u.url")


HEADER_FORMS = [("List-ID", "<l{id}>"), ("List-Unsubscribe", ""), ("Precedence", "Bulk"), ("precedence", "first-class"),
                ("X-Mailgun-Tag", ""), ("X-SG-EID", "{id}"), ("Subject", "x"), ("List-Unsubscribe-Post", "y")]


@register("bulk_headers", """
SELECT event_id, event_id % 3 <> 0 AND event_id % 8 IN (0, 2, 4, 5, 7) AS bulk FROM events""")
def bulk_headers(spark, sf):
    auto = F.when(ID() % 3 == 0, "Auto-Replied").otherwise("no")
    headers = F.create_map(
        t.pick([n for n, _ in HEADER_FORMS], ID()), t.pick([v for _, v in HEADER_FORMS], ID()),
        F.lit("Auto-Submitted"), auto, F.lit("To"), F.lit("me"))
    return t.events(spark, sf).select("event_id", senders.has_bulk_headers(headers).alias("bulk"))


TEXTS = ["Order #{id} placed", "your order {id}", "reordering {id}", "INVOICE {id}", "VOTRE REÇU {id}", "éversand {id}",
         "versand{id}", "paiement traité", "Your blue box {id} has shipped", "Welcome to {id}", "passwort zurücksetzen {id}",
         "ticket # {id}", "Código de verificação {id}", "hello {id}", "unwelcome to {id}", "conferma dell'ordine {id}"]


@register("classify_message", """
SELECT event_id, CASE WHEN event_id % 16 IN (0, 1, 3, 4, 5, 8, 15) THEN 'order' WHEN event_id % 16 IN (9, 10, 11, 12) THEN 'transactional'
  WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'bulk' ELSE 'personal' END AS type FROM events""")
def classify_message(spark, sf):
    headers = F.when(ID() % 7 == 0, F.create_map(F.lit("List-Id"), F.lit("l"))).otherwise(
        F.create_map(F.lit("To"), F.lit("me")))
    method = F.when(ID() % 5 == 0, "footer").otherwise("none")
    kind = classify.message_type(t.pick(TEXTS, ID()), F.col("event_type"), method, F.lit("https://x"), headers)
    return t.events(spark, sf).select("event_id", kind.alias("type"))


# ---- keys and domains ---------------------------------------------------------------------

DOMAINS = ["shop{id}.com", "mail.shop{id}.com", "a.b.shop{id}.co.uk", "shop{id}.co.uk", "co.uk", "localhost{id}", "x.y.z{id}.com.br"]


@register("root_domain", """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN concat('shop', event_id, '.com') WHEN 1 THEN concat('shop', event_id, '.com')
  WHEN 2 THEN concat('shop', event_id, '.co.uk') WHEN 3 THEN concat('shop', event_id, '.co.uk') WHEN 4 THEN 'co.uk'
  WHEN 5 THEN concat('localhost', event_id) ELSE concat('z', event_id, '.com.br') END AS root FROM events""")
def root_domain(spark, sf):
    return t.events(spark, sf).select("event_id", addresses.root_domain(t.pick(DOMAINS, ID())).alias("root"))


@register("vendor_key", sql("messages", """
SELECT event_id, vendor_key FROM messages UNION ALL SELECT event_id, 'gmail.com' FROM events WHERE user_id % 8 = 5"""))
def vendor_key(spark, sf):
    return t.events(spark, sf).select("event_id", addresses.vendor_key(F.upper(F.expr(t.SENDER))).alias("vendor_key"))


@register("ingest_filter", sql("messages accounts", """
SELECT m.account_id, message_id, sender_email FROM messages m JOIN accounts a USING (account_id)
WHERE sender_email <> lower(email)"""))
def ingest_filter(spark, sf):
    raw = ingest.normalize_messages(t.raw_messages(spark, sf))
    return ingest.keep_vendor_mail(raw, t.accounts(spark, sf)).select("account_id", "message_id", "sender_email")


@register("infer_name", """
SELECT event_id, CASE WHEN event_id % 7 IN (0, 3) THEN concat('Shop', event_id) WHEN event_id % 7 = 1 THEN 'Mail'
  WHEN event_id % 7 = 2 THEN 'A' WHEN event_id % 7 = 4 THEN 'Co' WHEN event_id % 7 = 5 THEN concat('Localhost', event_id)
  ELSE 'X' END AS name FROM events""")
def infer_name(spark, sf):
    return t.events(spark, sf).select("event_id", addresses.inferred_name(t.pick(DOMAINS, ID())).alias("name"))


@register("category_map", """
SELECT s_suppkey, CASE s_nationkey % 4 WHEN 0 THEN 'financial,healthcare' WHEN 1 THEN 'marketing'
  WHEN 2 THEN 'shopping,services' ELSE '' END AS categories FROM supplier""")
def category_map(spark, sf):
    k = F.col("s_nationkey") % 4

    def words(*names):
        return F.array(*[F.lit(n) for n in names])

    sources = F.when(k == 0, words("finance", "insurance", "health", "financial")).when(
        k == 1, words("ads", "Travel", "addresses")).when(k == 2, words("travel", "commerce", "church"))
    return t.table(spark, sf, "supplier").select(
        "s_suppkey", F.array_join(classify.map_categories(sources), ",").alias("categories"))


@register("company_domains", sql("companies", """
SELECT slug, concat_ws(',', concat('shop', ord, '.com'), CASE WHEN ord % 5 = 0 THEN concat('forms.shop', ord, '.com') END,
  CASE WHEN ord % 3 = 0 THEN concat('shop', ord, '.nl') END) AS domains FROM companies"""))
def company_domains(spark, sf):
    found = addresses.company_domains(F.col("web"), F.col("webform"), F.col("email"))
    return t.companies(spark, sf).select("slug", F.array_join(found, ",").alias("domains"))


URLS = ["https://User@Shop{id}.COM/a/b?x=1#f", "http://shop{id}.com:80", "https://shop{id}.com:8443/p?q", "mailto:u{id}@x.com?s=1",
        "not a url {id}"]


@register("url_trim", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('https://shop', event_id, '.com/a/b') WHEN 1 THEN concat('http://shop', event_id, '.com/')
  WHEN 2 THEN concat('https://shop', event_id, '.com:8443/p') WHEN 3 THEN concat('mailto:u', event_id, '@x.com?s=1')
  ELSE concat('not a url ', event_id) END AS url FROM events""")
def url_trim(spark, sf):
    return t.events(spark, sf).select("event_id", addresses.strip_query(t.pick(URLS, ID())).alias("url"))


@register("language_guess", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'en' ELSE 'pt' END AS language FROM events""")
def language_guess(spark, sf):
    domain = t.pick(["a{id}.DE", "a{id}.com", "a{id}.uk", "x.a{id}.pt"], ID())
    return t.events(spark, sf).select("event_id", fines.language_of_domain(domain).alias("language"))


# ---- fines ----------------------------------------------------------------------------------

FINE_TEXTS = ["EUR 1,234,{id}", "Unknown {id}", "Only intention to fine", "Multiple fines, 10 totaling EUR {id}", "1.5", "none", "€ {id} (net)"]


@register("fine_amount", """
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN CAST(concat('1234', o_orderkey) AS BIGINT) WHEN 3 THEN o_orderkey WHEN 4 THEN 5
  WHEN 6 THEN o_orderkey END AS fine FROM orders""")
def fine_amount(spark, sf):
    return t.table(spark, sf, "orders").select(
        "o_orderkey", fines.fine_eur(t.pick(FINE_TEXTS, F.col("o_orderkey"))).alias("fine"))


@register("fine_country", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Austria' WHEN 1 THEN 'The netherlands' ELSE 'Österreich' END AS country FROM orders""")
def fine_country(spark, sf):
    cell = t.pick(["<img src='{id}'><br />AUSTRIA", "<br>THE   NETHERLANDS ", "österreich"], F.col("o_orderkey"))
    return t.table(spark, sf, "orders").select("o_orderkey", fines.country_name(cell).alias("country"))


@register("source_link", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN concat('https://s/', o_orderkey) END AS url FROM orders""")
def source_link(spark, sf):
    cell = t.pick(["<a class='x' href='https://s/{id}'>a</a><a href='b'>", '<A HREF="https://s/{id}">', "none"], F.col("o_orderkey"))
    return t.table(spark, sf, "orders").select("o_orderkey", text.first_href(cell).alias("url"))


CONTROLLERS = ["Vodafone{id} España, S.A.U.", "Bank{id} of Ireland (Group) Ltd.", "Müller & Söhne {id} GmbH", "Acme{id} International AG",
               "Ålesund {id} kommune", "(hidden) Co. {id}", "Foo+Bar{id} S.r.l."]


@register("entity_slug", """
SELECT o_orderkey AS k,
  CASE o_orderkey % 7 WHEN 0 THEN concat('vodafone', o_orderkey) WHEN 1 THEN concat('bank', o_orderkey, '-of')
    WHEN 2 THEN concat('m-ller-s-hne-', o_orderkey) WHEN 3 THEN concat('acme', o_orderkey)
    WHEN 4 THEN concat('lesund-', o_orderkey, '-kommune') WHEN 5 THEN CAST(o_orderkey AS VARCHAR)
    ELSE concat('foo-bar', o_orderkey) END AS controller,
  CASE o_orderkey % 7 WHEN 0 THEN concat('vodafone', o_orderkey, '-espa-a') WHEN 1 THEN concat('bank', o_orderkey, '-of')
    WHEN 2 THEN concat('m-ller-s-hne-', o_orderkey) WHEN 3 THEN concat('acme', o_orderkey, '-international')
    WHEN 4 THEN concat('lesund-', o_orderkey, '-kommune') WHEN 5 THEN CAST(o_orderkey AS VARCHAR)
    ELSE concat('foo-bar', o_orderkey) END AS name
FROM orders""")
def entity_slug(spark, sf):
    raw = t.pick(CONTROLLERS, F.col("o_orderkey"))
    return t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), fines.controller_slug(raw).alias("controller"), fines.name_slug(raw).alias("name"))


# ---- quality and report columns ---------------------------------------------------------------

VALUES = ["a{id}@x.com", "x{id}.com", "bad{id}", "a b{id}@x.com", "a@b@c{id}.com", "sub.x{id}.co"]


@register("dq_values", """
SELECT event_id, concat_ws(',', CASE WHEN event_id % 6 NOT IN (0) THEN 'email' END, CASE WHEN event_id % 6 NOT IN (1, 5) THEN 'domain' END,
  CASE WHEN event_id % 6 NOT IN (0, 1, 5) THEN 'either' END,
  CASE WHEN event_type <> 'error' THEN 'type' END) AS failed FROM events""")
def dq_values(spark, sf):
    value = t.pick(VALUES, ID())
    kind = F.when(F.col("event_type") == "error", "personal").otherwise(F.col("event_type"))
    rules = {"email": quality.is_email(value), "domain": quality.is_domain(value),
             "either": quality.is_email_or_domain(value), "type": quality.is_message_type(kind)}
    good, bad = quality.split_valid(t.events(spark, sf), rules)
    joined = bad.unionByName(good.withColumn("failed", F.expr("array()").cast("array<string>")))
    return joined.select("event_id", F.array_join("failed", ",").alias("failed"))


FIXED = "printf('%.{1}f', floor(({0}) * {2} + 0.5) / {2})"


def fixed(value, digits):
    return FIXED.format(value, digits, 10 ** digits)


@register("report_units", f"""
WITH e AS (SELECT o_orderkey AS k, CAST(power(10, o_orderkey % 10) AS BIGINT) * (o_orderkey % 100) AS n FROM orders)
SELECT k,
  CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN concat({fixed('n / 1024.0', 1)}, ' KB')
    WHEN n < 1073741824 THEN concat({fixed('n / 1048576.0', 1)}, ' MB') ELSE concat({fixed('n / 1073741824.0', 2)}, ' GB') END AS size,
  CASE WHEN n <= 0 THEN 'Unknown' WHEN n >= 1000000 THEN concat({fixed('n / 1000000.0', 1)}, ' million')
    WHEN n >= 1000 THEN concat({fixed('n / 1000.0', 0)}, 'K') ELSE CAST(n AS VARCHAR) END AS records,
  CASE WHEN n >= 1000000 THEN concat('€', {fixed('n / 1000000.0', 1)}, 'M') WHEN n >= 1000 THEN concat('€', {fixed('n / 1000.0', 0)}, 'K')
    ELSE concat('€', n) END AS fine FROM e""")
def report_units(spark, sf):
    k = F.col("o_orderkey")
    n = F.pow(F.lit(10.0), k % 10).cast("bigint") * (k % 100)
    return t.table(spark, sf, "orders").select(
        k.alias("k"), signals.human_bytes(n).alias("size"), signals.human_count(n).alias("records"),
        signals.human_fine(n).alias("fine"))


@register("activity_signal", f"""
WITH e AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN 0
  WHEN event_id % 50 = 2 THEN {t.AS_OF_MS - 90 * 86400000} ELSE {DATE_MS} END AS seen FROM events)
SELECT event_id, CASE WHEN coalesce(seen, 0) = 0 THEN 'unknown' WHEN {t.AS_OF_MS} - seen < 90 * CAST(86400000 AS BIGINT) THEN 'recent'
  WHEN {t.AS_OF_MS} - seen < 365 * CAST(86400000 AS BIGINT) THEN 'active' WHEN {t.AS_OF_MS} - seen < 730 * CAST(86400000 AS BIGINT) THEN 'inactive'
  WHEN {t.AS_OF_MS} - seen < 1825 * CAST(86400000 AS BIGINT) THEN 'stale' ELSE 'dead' END AS activity FROM e""")
def activity_signal(spark, sf):
    k = ID() % 50
    seen = F.when(k == 1, 0).when(k == 2, t.AS_OF_MS - 90 * 86_400_000).when(k > 2, t.date_ms())
    return t.events(spark, sf).select("event_id", signals.activity_signal(seen, t.AS_OF_MS).alias("activity"))


@register("volume_signal", """
SELECT o_orderkey, CASE WHEN o_orderkey % 150 < 6 THEN 'oneoff' WHEN o_orderkey % 150 < 26 THEN 'low'
  WHEN o_orderkey % 150 < 101 THEN 'medium' ELSE 'high' END AS volume FROM orders""")
def volume_signal(spark, sf):
    return t.table(spark, sf, "orders").select(
        "o_orderkey", signals.volume_signal(F.col("o_orderkey") % 150).alias("volume"))


@register("effective_category", sql("vendors", """
SELECT account_id, vendor_key, CASE WHEN category_id <> 'unknown' THEN category_id WHEN has_orders THEN 'shopping'
  WHEN has_account THEN 'services' ELSE 'unknown' END AS category FROM vendors"""))
def effective_category(spark, sf):
    return t.vendors(spark, sf).select(
        "account_id", "vendor_key",
        classify.effective_category(F.col("category_id"), F.col("has_orders"), F.col("has_account")).alias("category"))


@register("breach_severity", sql("breaches", "SELECT name, severity FROM breaches"))
def breach_severity(spark, sf):
    return t.breaches(spark, sf).select("name", signals.severity(F.col("data_classes")).alias("severity"))
