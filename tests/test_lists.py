"""The fixed lists, whole: one word of every language and category."""

import pytest
from pyspark.sql import functions as F

from vendorlens.dims.categories import CATEGORIES
from vendorlens.dims.regulators import REGULATORS
from vendorlens.functions import classify, fines

LANGUAGES = ("en", "nl", "de", "fr", "es", "it", "pt")
NAMES = {
    "financial": ("Stripe", "Krediet Nu", "Sparkasse", "Assurance Vie", "Seguro Uno", "Assicurazione", "Pagamento"),
    "healthcare": ("Doctor", "Ziekenhuis Oost", "Krankenhaus", "Clinique du Parc", "Farmacia", "Ospedale", "Farmácia"),
    "government": ("Academy", "Gemeente Utrecht", "Steueramt", "École", "Gobierno", "Scuola", "Escola"),
    "marketing": ("Adtech", "Reclame", "Werbung", "Publicité", "Anuncios", "Annunci", "Anúncios"),
    "social": ("TikTok", "Netwerk", "Netzwerk", "Réseau", "Red Azul", "Rete", "Rede Norte"),
    "communication": ("Telegram", "Odido", "Telco", "Bouygues", "Movistar", "Tim", "Meo"),
    "shopping": ("Airline", "Winkel", "Marktplatz", "Magasin", "Tienda", "Negozio", "Loja"),
    "entertainment": ("Podcast", "Muziek", "Spiel", "Musique", "Juego", "Gioco", "Jogo"),
    "services": ("Supplier", "Eneco", "Wasserwerk", "Fournisseur", "Proveedor", "Fornitore", "Fornecedor"),
}


@pytest.mark.parametrize("category", NAMES)
def test_a_word_of_every_language(spark, category):
    df = spark.createDataFrame([(n,) for n in NAMES[category]], "name string")
    got = {r["name"]: r["c"] for r in df.select("name", classify.keyword_category(F.col("name"))["category"].alias("c")).collect()}
    assert got == dict.fromkeys(NAMES[category], category)


def test_every_category_has_every_language():
    assert [c.name for c in CATEGORIES] == list(NAMES)
    assert all(tuple(c.by_language) == LANGUAGES and c.icon for c in CATEGORIES)
    assert sum(len(w) for c in CATEGORIES for w in c.by_language.values()) == 362


def test_regulators_have_their_facts():
    assert len(REGULATORS) == 18
    for r in REGULATORS:
        assert r.phone and r.address and r.complaint_url.startswith("https://") and r.website.startswith("https://")
    assert sum(r.english_ok for r in REGULATORS) == 7 and sum(r.email is None for r in REGULATORS) == 2


def test_fine_countries(spark):
    df = spark.createDataFrame([(c,) for c in ("The netherlands", "UNITED KINGDOM", "Czech republic", "Austria", "Nowhere", None)], "c string")
    got = [r[0] for r in df.select(fines.regulator_of_country(F.col("c"))).collect()]
    assert got == ["Netherlands", "United Kingdom", "Czech Republic", "Austria", None, None]
