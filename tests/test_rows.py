"""Hand-worked rows for the column functions."""

import pytest
from pyspark.sql import functions as F

from vendorlens.dims import patterns
from vendorlens.functions import addresses, classify, fines, optout, quality, senders, signals, text


def value(spark, make, *args, types=None):
    """The column ``make(*columns)`` over one row of arguments."""
    names = [f"c{i}" for i in range(len(args))]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types or ["string"] * len(args)))
    df = spark.createDataFrame([tuple(args)], schema)
    return df.select(make(*[F.col(n) for n in names]).alias("v")).first()["v"]


@pytest.mark.parametrize("html, expected", [
    (None, ""),
    ("<script>var a = '<b>';</script>Hello", "Hello"),
    ("<div>One <b>two</b><i> three</i></div>", "One two three"),
    ("<STYLE>p{}</STYLE><script src='x'>go()</script><h1>Title</h1><p>Text\n here</p>", "Title Text here"),
    ("a  b", "a b"),
])
def test_html_to_text(spark, html, expected):
    assert value(spark, text.html_to_text, html) == expected


@pytest.mark.parametrize("raw, name, email", [
    ('"Ann Lee" <ANN@x.com>', "Ann Lee", "ann@x.com"),
    ("'Ann' <a@x.com>", "Ann", "a@x.com"),
    ("<a@x.com>", "", "a@x.com"),
    ("mail to a@x.com now", "", "a@x.com"),
    ("nobody ", "", "nobody"),
    (None, "", ""),
])
def test_parse_sender(spark, raw, name, email):
    got = value(spark, senders.parse_sender, raw)
    assert (got["name"], got["email"]) == (name, email)


@pytest.mark.parametrize("date, ms", [
    ("Mon, 01 Jan 2024 01:00:00 +0100", 1704067200000),
    ("1 Jan 2024 00:00:00 GMT (UTC)", 1704067200000),
    ("garbage", None),
])
def test_header_date(spark, date, ms):
    assert value(spark, senders.header_date_ms, date) == ms


@pytest.mark.parametrize("domain, root", [
    ("x.com", "x.com"), ("a.b.x.com", "x.com"), ("a.x.co.uk", "x.co.uk"), ("co.uk", "co.uk"), ("localhost", "localhost")])
def test_root_domain(spark, domain, root):
    assert value(spark, addresses.root_domain, domain) == root


@pytest.mark.parametrize("email, key", [
    ("News@Mail.Shop.com", "shop.com"),
    ("letter@substack.com", "letter.substack.com"),
    ("x@team.substack.com", "team.substack.com"),
    ("help@acme.zendesk.com", "acme.zendesk.com"),
    ("Event@calendar.luma-mail.com", "event.calendar.luma-mail.com"),
    ("noreply@luma-mail.com", "luma-mail.com"),
    ("a@b@c.com", "b@c.com"),
    ("shop.com", "shop.com"),
    ("substack.com", "substack.com"),
])
def test_vendor_key(spark, email, key):
    assert value(spark, addresses.vendor_key, email) == key


def test_mail_domain_takes_the_second_part(spark):
    assert value(spark, addresses.mail_domain, "a@b@c.com") == "b"
    assert value(spark, addresses.mail_domain, "a@") is None
    assert value(spark, addresses.mail_domain, "a") is None


def test_sender_suffixes(spark):
    assert value(spark, addresses.sender_suffixes, "a.b@c.d.com") == ["a.b@c.d.com", "c.d.com", "d.com", "com"]
    assert value(spark, addresses.sender_suffixes, "c.d.com") == ["d.com", "com"]


@pytest.mark.parametrize("subject, kind", [
    ("Your RECEIPT for June", "order"),
    ("Votre reçu", "order"), ("VOTRE REÇU", "order"),
    ("éversand x", "order"),          # an accented letter is no word character
    ("paiement traité", "personal"),  # nor at the end: no boundary after é
    ("paiement traitéx", "order"),
    ("reorder 5", "personal"),
    ("welcome to us", "personal"),
    ("ticket #5", "personal"), ("ticket # 5", "transactional"),
    ("Conferma dell'ordine", "order"),
    ("Bem-vindo", "transactional"),
])
def test_message_type(spark, subject, kind):
    got = value(spark, lambda s: classify.message_type(
        s, F.lit(""), F.lit("none"), F.lit(None).cast("string"), F.expr("map('To', 'x')")), subject)
    assert got == kind


def test_order_goes_before_bulk(spark):
    got = value(spark, lambda s: classify.message_type(
        s, F.lit(""), F.lit("rfc8058"), F.lit("https://x"), F.expr("map('List-Id', 'x')")), "Invoice 5")
    assert got == "order"


@pytest.mark.parametrize("headers, bulk", [
    ({"List-Unsubscribe": "<x>"}, True), ({"List-Unsubscribe": ""}, False), ({"X-SG-EID": ""}, True),
    ({"Precedence": "BULK"}, True), ({"Precedence": "first"}, False),
    ({"Auto-Submitted": "auto-generated", "List-Id": "x"}, False), ({"Auto-Submitted": "no", "List-Id": "x"}, True),
    ({"Auto-Submitted": "", "X-Auto-Submitted": "AUTO-x", "List-Id": "x"}, False), ({}, False), (None, False),
])
def test_bulk_headers(spark, headers, bulk):
    assert value(spark, senders.has_bulk_headers, headers, types=["map<string,string>"]) is bulk


@pytest.mark.parametrize("headers, bulk", [
    ([("precedence", "bulk"), ("Precedence", "none")], False),
    ([("Precedence", "none"), ("precedence", "bulk")], True),
    # A name keeps the place of its first use, so the other spelling still comes last.
    ([("Precedence", "x"), ("precedence", "bulk"), ("Precedence", "none")], True),
])
def test_last_spelling_wins(spark, headers, bulk):
    got = value(spark, lambda c: senders.has_bulk_headers(senders.headers_map(c, "last")), headers,
                types=["array<struct<name:string,value:string>>"])
    assert got is bulk


def test_headers_map_policies(spark):
    headers = [("A", " 1 "), ("a", "2"), ("B", " "), ("A", "3")]
    kind = ["array<struct<name:string,value:string>>"]
    assert value(spark, lambda c: senders.headers_map(c, "first"), headers, types=kind) == {"a": "1"}
    assert value(spark, lambda c: senders.headers_map(c, "last"), headers, types=kind) == {"A": "3", "a": "2", "B": " "}


@pytest.mark.parametrize("header, url", [
    ("<mailto:a@x>, <https://x/1>", "https://x/1"), ("<http://x/1>, <mailto:a>", "http://x/1"),
    ("<mailto:a@x>", "mailto:a@x"), ("https://raw", "https://raw"), ("<ftp://x>", None), ("", None), (None, None)])
def test_list_header(spark, header, url):
    assert value(spark, optout.list_unsubscribe_url, header) == url


FILL = "x" * 4000


@pytest.mark.parametrize("html, url", [
    (FILL + '<a href="https://a/1"><b>Opt-out</b></a>', "https://a/1"),
    ('<a href="https://a/1">unsubscribe</a>' + FILL, None),
    (FILL + '<a href="https://a/optout">x</a><a href="https://b">abmelden</a>', "https://b"),
    (FILL + '<a href="/unsubscribe">unsubscribe</a>', None),
])
def test_footer(spark, html, url):
    assert value(spark, optout.footer_unsubscribe_url, html) == url


def test_forwarded_mail_has_no_footer(spark):
    html = FILL + '<a href="https://a/1">unsubscribe</a>'
    def resolve(h, s):
        return optout.resolve_unsubscribe(F.lit(None).cast("string"), F.lit(None).cast("string"), h, s)
    assert value(spark, resolve, html, "WG: x")["method"] == "none"
    assert tuple(value(spark, resolve, html, "x")) == ("footer", "https://a/1")


@pytest.mark.parametrize("cell, fine", [
    ("EUR 1,500", 1500), ("1.5", 5), ("Multiple fines (2) EUR 178,000", 178000), ("Unknown 5", None), ("Only intention", None), ("-", None)])
def test_fine(spark, cell, fine):
    assert value(spark, fines.fine_eur, cell) == fine


@pytest.mark.parametrize("name, controller, company", [
    ("Vodafone España, S.A.U.", "vodafone", "vodafone-espa-a"), ("Bank of Ireland", "bank-of", "bank-of"),
    ("Bank of Greece", "bank-of", "bank-of-greece"), ("Meta (Facebook) Inc.", "meta", "meta")])
def test_slugs(spark, name, controller, company):
    assert value(spark, fines.controller_slug, name) == controller
    assert value(spark, fines.name_slug, name) == company


@pytest.mark.parametrize("address, given, country", [
    ("Street 1\nVienna\nAustria", None, "Austria"), ("x, 1000 København, Danmark.", None, "Denmark"),
    ("x\nÖsterreich", None, "Austria"), ("Germany Road 1\nOslo", None, None), ("x\nOslo\nNorge", "Denmark", "Denmark"),
    ("x", "AT", "Austria"), (None, None, None)])
def test_regulator(spark, address, given, country):
    assert value(spark, lambda a, g: fines.regulator_by_address(a, g), address, given) == country


def test_quality(spark):
    assert value(spark, quality.is_email, "a@x.com") and not value(spark, quality.is_email, "a@x")
    assert not value(spark, quality.is_domain, "a@x.com") and not value(spark, quality.is_domain, None)


@pytest.mark.parametrize("n, size, count, fine", [
    (1023, "1023 B", "1K", "€1K"), (1280, "1.3 KB", "1K", "€1K"), (2_500_000, "2.4 MB", "2.5 million", "€2.5M"), (0, "0 B", "Unknown", "€0")])
def test_units(spark, n, size, count, fine):
    def all_units(c):
        return F.array(signals.human_bytes(c), signals.human_count(c), signals.human_fine(c))
    assert value(spark, all_units, n, types=["bigint"]) == [size, count, fine]


def test_category_rules(spark):
    kind = ["array<string>"]
    assert value(spark, classify.map_categories, ["finance", "insurance", "Travel", "church"], types=kind) == ["financial", "services"]
    best = lambda c: classify.riskiest_category(c)["category"]
    assert value(spark, best, ["entertainment", "health", "finance"], types=kind) == "healthcare"
    assert value(spark, best, ["shopping"], types=kind) is None
    both = lambda c: classify.riskiest_category(c, app_categories=True)["category"]
    assert value(spark, both, ["shopping"], types=kind) == "shopping"
    word = lambda c: classify.keyword_category(c)["category"]
    assert value(spark, word, "Shopping world") == "financial"  # "ing" is a bank
    assert value(spark, word, "Energy game") == "services"
    assert value(spark, word, "zzz") == "unknown"


@pytest.mark.parametrize("url, clean", [
    ("https://X.com/a?b=1", "https://x.com/a"), ("http://x.com", "http://x.com/"), ("mailto:a@x", "mailto:a@x"), ("?", "?")])
def test_strip_query(spark, url, clean):
    assert value(spark, addresses.strip_query, url) == clean


@pytest.mark.parametrize("found", [patterns.ORDER, patterns.TRANSACTIONAL, patterns.OPT_OUT_TEXT])
def test_patterns_of_a_letter_share_it(spark, found):
    """Few alternatives are tried at a word, and the answer is that of the patterns one by one."""
    assert len(patterns._by_letter([p[2:] for p in found])) < len(found) / 2
    words = ["order confirmation", "Your blue box has shipped", "VOTRE REÇU 1", "uw bestelling", "je bestelling", "opt out", "opt-out", "email bestätigen", "E-Mail bestatigen",
             "résumé", "2FA code", "sign in code", "ticket # 7", "ticket 7a", "reorder #7", "order #7", "Kein Versand", "versand7", "ſe désabonner", "se desabonner", "aus dem Verteiler tragen", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    single = [F.col("w").rlike("(?iu)" + patterns.java_regex(p)) for p in found]
    rows = df.select("w", F.col("w").rlike(patterns.java_any(found)).alias("got"), F.exists(F.array(*single), lambda x: x).alias("want")).collect()
    assert [r["w"] for r in rows if r["got"] != r["want"]] == [] and any(r["got"] for r in rows)


def test_header_lists_with_and_without_repeated_names(spark):
    """A list that names each header once is taken as it is; others, and lists with empty places, are merged."""
    rows = [([("A", "1"), ("B", None)],), ([("A", "1"), ("A", "2")],), ([("A", "1"), None, (None, "3")],), ([],), (None,)]
    df = spark.createDataFrame(rows, "h array<struct<name:string,value:string>>")
    got = [r[0] for r in df.select(senders.headers_map(F.col("h"))).collect()]
    assert got == [{"A": "1", "B": None}, {"A": "2"}, {"A": "1"}, {}, {}]


def test_only_known_names_mark_bulk_mail(spark):
    rows = [({"x-other": "1"},), ({"List-ID": "l"},), ({"a\nlist-id": "l"},), ({"X-SG-ID": None},), ({"Precedence": "bulk"},), ({},), (None,)]
    df = spark.createDataFrame(rows, "h map<string,string>")
    assert [r[0] for r in df.select(senders.has_bulk_headers(F.col("h"))).collect()] == [False, True, False, False, True, False, False]


def test_white_space_collapses_and_tags_vanish(spark):
    texts = [" a  b ", "a\tb", "a \n b", "<b>a</b> b", "a<b", " a  b", None, ""]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    got = [tuple(r) for r in df.select(text.collapse(F.col("x")), text.strip_tags(F.col("x"))).collect()]
    assert got == [("a b", "a b"), ("a b", "a b"), ("a b", "a b"), ("<b>a</b> b", "a b"), ("a<b", "a<b"), ("a b", "a b"), (None, ""), ("", "")]
