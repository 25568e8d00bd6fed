"""Fixed regular-expression lists, plus their rendering for Java regular expressions.

The lists are written in the common dialect: ``\\b`` is an ASCII word boundary and ``\\s`` any
Unicode white space. Java 17 reads both differently, so :func:`java_any` spells them out.
"""

import re

# White space as the mail clients of the field see it (includes no-break space).
WHITE_SPACE = r"\s\x{0B}\p{Z}\x{FEFF}"

# The same characters one by one, for trimming without a regular expression.
WHITE_CHARS = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# Text of an opt-out link (English, Dutch, German, French, Spanish, Italian, Portuguese).
OPT_OUT_TEXT = r"""
\bunsubscribe\b
\bopt[\s-]?out\b
\bmanage\s*(your\s*)?(email\s*)?(preferences|subscriptions)\b
\bupdate\s*(your\s*)?(email\s*)?preferences\b
\bno\s*longer\s*wish\s*to\s*receive\b
\bstop\s*(receiving|these)\s*(emails|messages)\b
\buitschrijven\b
\bafmelden\b
\bvoorkeuren\s*beheren\b
\bnie(t)?\s*meer\s*ontvangen\b
\babmelden\b
\babbestellen\b
\baus.*tragen\b
\bnicht\s*mehr\s*erhalten\b
\babmeldelink\b
\bse\s*d[eé]sabonner\b
\bd[eé]sabonnement\b
\bne\s*plus\s*recevoir\b
\bd[eé]sinscription\b
\bdarse\s*de\s*baja\b
\bdesuscribirse\b
\bcancelar\s*suscripci[oó]n\b
\bdar\s*de\s*baja\b
\bdisiscriversi\b
\bannullare?\s*(l[a']?\s*)?iscrizione\b
\bcancellare?\s*(l[a']?\s*)?iscrizione\b
\bdesinscrever\b
\bcancelar\s*(a\s*)?inscri[cç][aã]o\b
\bdescadastrar\b
""".strip().splitlines()

# URL parts of an opt-out endpoint.
OPT_OUT_URL = """
unsubscribe optout opt-out uitschrijven afmelden abmelden abbestellen
desabonner desinscription desuscribirse darse-de-baja disiscriversi desinscrever descadastrar
""".split()

# Account mail (welcome, verification, passwords, appointments), seven languages.
TRANSACTIONAL = r"""
\bwelcome to\b
\bthanks for (signing up|joining|registering)\b
\bverify your email\b
\bconfirm your (email|account)\b
\bactivate your account\b
\bget started with\b
\breset your password\b
\bpassword reset\b
\bforgot (your )?password\b
\bchange your password\b
\bverification code\b
\blogin code\b
\bsecurity code\b
\bone-time (password|code)\b
\b2fa code\b
\bauthentication code\b
\bsign[- ]?in code\b
\b(appointment|booking|reservation) (confirmation|confirmed|reminder|cancelled|rescheduled)\b
\b(lesson|session|class) (cancellation|cancelled|confirmation|confirmed|scheduled|reminder)\b
\bschedule (cancellation|cancellation confirmation)\b
\bticket #?\s*\d+\b
\bwelkom (bij|op)\b
\bafspraak\b
\bcontactverzoek\b
\bbevestig (je |uw )?e-?mail\b
\bwachtwoord (opnieuw )?instellen\b
\bverificatiecode\b
\bwijzig (je |uw )?wachtwoord\b
\bwachtwoord wijzigen\b
\bwachtwoord vergeten\b
\bwillkommen bei\b
\be-?mail best[aä]tigen\b
\bpasswort zur[uü]cksetzen\b
\bverifizierungscode\b
\bbienvenue\b
\bconfirmez? votre e-?mail\b
\br[eé]initialiser (le )?mot de passe\b
\bcode de v[eé]rification\b
\bbienvenido\b
\bconfirma tu e-?mail\b
\brestaurar contraseña\b
\bc[oó]digo de verificaci[oó]n\b
\bbenvenuto\b
\bconferma la tua e-?mail\b
\bresetta (la )?password\b
\bcodice di verifica\b
\bbem-vindo\b
\bconfirme seu e-?mail\b
\bredefinir senha\b
\bc[oó]digo de verifica[cç][aã]o\b
""".strip().splitlines()

# Purchase mail (orders, invoices, shipping, payments, refunds), seven languages.
ORDER = r"""
\border confirmation\b
\byour order\b
\breceipt for\b
\border #?\d+
\bpurchase confirmation\b
\bshipping confirmation\b
\byour .* has shipped\b
\binvoice\b
\bbilling (info|statement)\b
\bpayment (receipt|confirmation|processed|successful|declined|failed|received)\b
\bcharge (receipt|confirmation|processed|successful|declined|failed)\b
\byour (monthly |annual |yearly )?(payment|charge|subscription charge|membership charge)\b
\byour refund\b
\brefund (processed|issued|confirmed|approved|received|complete)\b
\bofferte(aanvraag)?\b
\bbestelbevestiging\b
\b(uw|je) bestelling\b
\bontvangstbewijs\b
\bverzending\b
\bfactuur\b
\bretourbon#?\d+
\bterugbetaling\b
\bbetaling (geautoriseerd|verwerkt|ontvangen|mislukt|geweigerd)\b
\bbestellbest[aä]tigung\b
\bihre bestellung\b
\bquittung\b
\bversand\b
\brechnung\b
\br[uü]ckerstattung\b
\bzahlung (autorisiert|verarbeitet|eingegangen|fehlgeschlagen|abgelehnt)\b
\bconfirmation de commande\b
\bvotre commande\b
\bre[cç]u\b
\bexp[eé]dition\b
\bfacture\b
\bremboursement\b
\bpaiement (autoris[eé]|trait[eé]|re[cç]u|[eé]chou[eé]|refus[eé])\b
\bconfirmaci[oó]n (de )?pedido\b
\btu pedido\b
\brecibo\b
\benv[ií]o\b
\bfactura\b
\breembolso\b
\bpago (autorizado|procesado|recibido|fallido|rechazado)\b
\bconferma (dell'?)?ordine\b
\btuo ordine\b
\bricevuta\b
\bspedizione\b
\bfattura\b
\brimborso\b
\bpagamento (autorizzato|elaborato|ricevuto|fallito|rifiutato)\b
\bconfirma[cç][aã]o (do )?pedido\b
\bseu pedido\b
\benvio\b
\bfatura\b
\bpagamento (autorizado|processado|recebido|falhou|recusado)\b
""".strip().splitlines()

# Subject prefixes of forwarded mail.
FORWARDED_PREFIXES = "fw fwd wg wtr tr rv".split()

# Legal forms dropped from a controller or company name.
LEGAL_FORMS = r"""
ireland limited ltd\.? inc\.? gmbh ag b\.v\.? s\.a\.u\.? s\.p\.a\.? s\.r\.l\.? s\.l\.? llc
sarl sas srl spa n\.v\.? s\.a\.? nv sa plc se kg ohg ab as oy a\.s\.? s\.r\.o\.?
d\.o\.o\.? d\.d\.? p\.l\.c\.? co\.?
""".split()

# Country and region words dropped from a controller name.
REGION_WORDS = """
españa espagne espana italia romania germany france ireland netherlands greece czech poland
belgium austria sweden finland denmark portugal hungary cyprus slovakia slovenia croatia
bulgaria lithuania latvia estonia international europe european global worldwide
""".split()

# Java reads \w as ASCII, so this is the ASCII word boundary whatever the JDK makes of \b.
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def java_regex(pattern):
    """One pattern of the common dialect as a Java regular expression."""
    spaced = re.sub(r"\[\\s", lambda _: "[" + WHITE_SPACE.replace("\\s", "\0"), pattern)
    spaced = spaced.replace(r"\s", "[" + WHITE_SPACE.replace("\\s", "\0") + "]")
    return spaced.replace("\0", r"\s").replace(r"\b", _BOUNDARY)


def _by_letter(patterns):
    """Alternatives of the patterns, those that start with the same plain letter put together."""
    groups = {}
    for p in patterns:
        # Optional and repeated letters, and patterns with a choice of their own, stay as they are.
        plain = p[0].isascii() and p[0].isalpha() and p[1:2] not in ("?", "*", "+", "{") and "|" not in re.sub(r"\([^()]*\)", "", re.sub(r"\([^()]*\)", "", p))
        groups.setdefault(p[0].lower() if plain else p, []).append(java_regex(p[1:] if plain else p))
    return [rf"{key}(?:{'|'.join(bodies)})" if len(key) == 1 and key.isalpha() else "|".join(bodies) for key, bodies in groups.items()]


def java_any(patterns):
    """Case-insensitive alternation.

    Patterns that all open at a word boundary share one look-behind, so most positions of a
    text are rejected before the alternation is entered. Those that go on with the same letter
    share it, so a word meets the patterns of its own letter only. For yes or no: which pattern comes first isn't kept.
    """
    if all(p.startswith(r"\b") for p in patterns):
        return rf"(?iu)(?<!\w)(?=\w)(?:{'|'.join(_by_letter([p[2:] for p in patterns]))})"
    return "(?iu)(?:" + "|".join(java_regex(p) for p in patterns) + ")"


def escape(word):
    """A literal word inside a regular expression."""
    return re.sub(r"([.\\+*?\[\](){}|^$])", r"\\\1", word)
