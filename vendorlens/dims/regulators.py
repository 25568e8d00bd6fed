"""Data-protection regulators, in the order in which they are tried."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Regulator:
    country: str
    tld: str
    language: str
    aliases: tuple
    name: str
    email: str | None
    phone: str
    address: str
    complaint_url: str
    website: str
    english_ok: bool = False
    warning: str | None = None

    @property
    def iso(self):
        return {"uk": "GB"}.get(self.tld, self.tld.upper())

    @property
    def names(self):
        """Country name and aliases in lower case."""
        return (self.country.lower(), *self.aliases)


# Regulators with their public contact facts.
REGULATORS = (
    Regulator(
        "Austria", "at", "de", ("österreich",),
        "Datenschutzbehörde (DSB)",
        "dsb@dsb.gv.at", "+43 1 52 152-0", "Barichgasse 40-42, 1030 Vienna",
        "https://dsb.gv.at/eingabe-an-die-dsb/formulare",
        "https://data-protection-authority.gv.at", english_ok=True),
    Regulator(
        "Belgium", "be", "fr", ("belgique", "belgië"),
        "Autorité de protection des données (APD / GBA)",
        "contact@apd-gba.be", "+32 2 274 48 00", "Drukpersstraat 35, 1000 Brussels",
        "https://www.autoriteprotectiondonnees.be/introduire-une-requete-une-plainte",
        "https://www.dataprotectionauthority.be",
        warning="Complaints must be in French, Dutch, or German. English submissions are not accepted."),
    Regulator(
        "Denmark", "dk", "en", ("danmark",),
        "Datatilsynet",
        "dt@datatilsynet.dk", "+45 33 19 32 00", "Carl Jacobsens Vej 35, 2500 Valby",
        "https://www.datatilsynet.dk/english/file-a-complaint",
        "https://www.datatilsynet.dk/english",
        warning="Online form requires MitID (Danish national eID). Non-residents should file by email or use the PDF form instead."),
    Regulator(
        "Finland", "fi", "en", (),
        "Office of the Data Protection Ombudsman (Tietosuojavaltuutetun toimisto)",
        "tietosuoja@om.fi", "+358 29 56 66700", "P.O. Box 800, FI-00531 Helsinki",
        "https://tietosuoja.fi/en/notification-to-the-data-protection-ombudsman",
        "https://www.tietosuoja.fi/en/",
        warning="Complaints are processed in Finnish or Swedish. English submissions may be accepted but Finnish is strongly preferred."),
    Regulator(
        "France", "fr", "fr", (),
        "Commission Nationale de l'Informatique et des Libertés (CNIL)",
        None, "+33 1 53 73 22 22", "3 Place de Fontenoy, 75007 Paris",
        "https://www.cnil.fr/fr/plaintes",
        "https://www.cnil.fr/en/",
        warning="Complaint process is French only. No English submission accepted."),
    Regulator(
        "Germany", "de", "de", ("deutschland",),
        "BfDI + 16 state DPAs",
        "poststelle@bfdi.bund.de", "+49 228 997799-0", "Graurheindorfer Str. 153, 53117 Bonn",
        "https://www.bfdi.bund.de/EN/Buerger/Inhalte/Allgemein/Datenschutz/BeschwerdeBeiDatenschutzbehoerden.html",
        "https://www.bfdi.bund.de",
        warning="For private companies, file with the state DPA where the company is headquartered, not the federal BfDI. Forms are German only."),
    Regulator(
        "Ireland", "ie", "en", (),
        "Data Protection Commission (DPC)",
        "info@dataprotection.ie", "+353 1 765 0100", "6 Pembroke Row, Dublin 2, D02 X963",
        "https://www.dataprotection.ie/en/individuals/exercising-your-rights/raising-concern-commission",
        "https://www.dataprotection.ie/en", english_ok=True,
        warning="Ireland is the EU lead supervisory authority for most major US tech companies (Google, Meta, Apple, Microsoft). Complaints cannot be accepted by phone — submit via webform or email only."),
    Regulator(
        "Italy", "it", "it", ("italia",),
        "Garante per la protezione dei dati personali",
        "garante@gpdp.it", "+39 06 696771", "Piazza Venezia 11, 00187 Roma",
        "https://www.garanteprivacy.it/diritti/come-agire-per-tutelare-i-tuoi-dati-personali/reclamo",
        "https://www.garanteprivacy.it/web/garante-privacy-en",
        warning="Italian only. Download the template and submit by registered mail (raccomandata). PEC email is not available to non-residents."),
    Regulator(
        "Netherlands", "nl", "nl", ("nederland", "the netherlands"),
        "Autoriteit Persoonsgegevens (AP)",
        "info@autoriteitpersoonsgegevens.nl", "+31 70 888 8500", "Postbus 93374, 2509 AJ Den Haag",
        "https://klachten.autoriteitpersoonsgegevens.nl/",
        "https://www.autoriteitpersoonsgegevens.nl/en", english_ok=True),
    Regulator(
        "Poland", "pl", "en", ("polska",),
        "Urząd Ochrony Danych Osobowych (UODO)",
        "kancelaria@uodo.gov.pl", "+48 22 531 03 00", "ul. Stanisława Moniuszki 1A, 00-014 Warsaw",
        "https://uodo.gov.pl/en/664/1408",
        "https://uodo.gov.pl/en",
        warning="Polish only. Formal complaints must be submitted via the electronic inbox (ePUAP) or by post — email is not a formal complaint channel."),
    Regulator(
        "Luxembourg", "lu", "fr", (),
        "Commission Nationale pour la Protection des Données (CNPD)",
        "info@cnpd.lu", "+352 26 10 60 1", "15, Boulevard du Jazz, L-4370 Belvaux",
        "https://cnpd.public.lu/en/particuliers/faire-valoir/formulaire-plainte.html",
        "https://cnpd.public.lu/en.html",
        warning="Luxembourg is the EU lead supervisory authority for Amazon, PayPal, Skype, and Spotify. Complaint form is primarily in French — download a PDF copy of your submission before closing the form."),
    Regulator(
        "Portugal", "pt", "pt", (),
        "Comissão Nacional de Proteção de Dados (CNPD)",
        "geral@cnpd.pt", "+351 213 928 400", "Av. D. Carlos I, 134, 1.º, 1200-651 Lisboa",
        "https://www.cnpd.pt/cidadaos/participacoes/",
        "https://www.cnpd.pt/en/",
        warning="Portuguese only. No telephone assistance, all contact must be in writing."),
    Regulator(
        "Spain", "es", "es", ("españa",),
        "Agencia Española de Protección de Datos (AEPD)",
        "uits@aepd.es", "900 293 183 (freephone within Spain)", "C/ Jorge Juan 6, 28001 Madrid",
        "https://sedeaepd.gob.es/sede-electronica-web/vistas/infoSede/tramitesCiudadanoReclamaciones.jsf",
        "https://www.aepd.es/en",
        warning="Online filing requires a Spanish digital certificate (Cl@ve). Non-residents should file by post in Spanish."),
    Regulator(
        "Sweden", "se", "en", ("sverige",),
        "Integritetsskyddsmyndigheten (IMY)",
        "imy@imy.se", "+46 8 657 61 00", "Box 8114, 104 20 Stockholm",
        "https://e-tjanster.imy.se/en/klagomal",
        "https://www.imy.se/en/", english_ok=True,
        warning="All submissions become public documents under Sweden's access principle. Use email or post if you have a protected identity."),
    Regulator(
        "United Kingdom", "uk", "en", ("uk", "united kingdom"),
        "Information Commissioner's Office (ICO)",
        "icocasework@ico.org.uk", "+44 303 123 1113", "Wycliffe House, Water Lane, Wilmslow SK9 5AF",
        "https://ico.org.uk/make-a-complaint/data-protection-complaints/",
        "https://ico.org.uk", english_ok=True,
        warning="Post-Brexit: the UK operates under UK GDPR, not EU GDPR. Substantively similar but legally separate."),
    Regulator(
        "Switzerland", "ch", "de", ("schweiz", "suisse"),
        "Federal Data Protection and Information Commissioner (FDPIC)",
        None, "+41 58 462 43 95 (10:00-11:30 only)", "Feldeggweg 1, CH-3003 Berne",
        "https://www.edoeb.admin.ch/en/report-form-data-subjects",
        "https://www.edoeb.admin.ch/en", english_ok=True,
        warning="Switzerland operates under nFADP, not GDPR. The FDPIC cannot impose fines directly, for individual enforcement civil court is the primary route."),
    Regulator(
        "Norway", "no", "en", ("norge",),
        "Datatilsynet",
        "postkasse@datatilsynet.no", "+47 22 39 69 00", "Tollbugata 3, 0152 Oslo",
        "https://www.datatilsynet.no/en/about-us/contact-us/how-to-complain-to-the-norwegian-dpa/",
        "https://www.datatilsynet.no/en/",
        warning="Norway is EEA, not EU — GDPR applies via the EEA Agreement. Online form requires BankID (Norwegian eID). Non-residents should file by email or post."),
    Regulator(
        "Iceland", "is", "en", ("island",),
        "Persónuvernd (Icelandic Data Protection Authority)",
        "postur@personuvernd.is", "+354 510 9600", "Laugarvegur 166, 4th floor, 105 Reykjavík",
        "https://island.is/en/complaint-to-the-data-protection-authority",
        "https://island.is/s/personuvernd/en/", english_ok=True,
        warning="Iceland is EEA, not EU — GDPR applies via the EEA Agreement. English is widely accepted."),
)

# Country spellings of the fine register beside the regulators' own names.
FINE_COUNTRY_ALIASES = {
    "the netherlands": "Netherlands",
    "united kingdom": "United Kingdom",
    "czech republic": "Czech Republic",
}

# Languages a request letter can be written in; English is the fallback.
LETTER_LANGUAGES = ["en", "nl", "de", "fr", "es", "it", "pt"]
