"""Data-subject request letters in seven languages.

Subjects and reference labels are fixed values. The letter bodies are our own wording; callers
who need another text pass their own template table (language, action, subject, body, ref_label).
Place holders: ``%EMAIL%``, ``%ACCOUNT_REF%``, ``%NAME%``.
"""

# Language | deletion subject | access subject | account reference label.
_SUBJECTS = """
en|Personal Data Deletion Request|Personal Data Access Request|Account reference
nl|Verzoek tot verwijdering van persoonsgegevens|Verzoek tot inzage in persoonsgegevens|Accountreferentie
de|Antrag auf Löschung personenbezogener Daten|Antrag auf Auskunft über personenbezogene Daten|Kontoreferenz
fr|Demande de suppression de données personnelles|Demande d'accès aux données personnelles|Référence de compte
es|Solicitud de eliminación de datos personales|Solicitud de acceso a datos personales|Referencia de cuenta
it|Richiesta di cancellazione dei dati personali|Richiesta di accesso ai dati personali|Riferimento account
pt|Pedido de eliminação de dados pessoais|Pedido de acesso a dados pessoais|Referência de conta
"""

_BODIES = {
    "en": ("Please erase every record you keep about me and tell recipients of my data to do the same.",
           "Please send me a copy of my data, its purposes, recipients and retention period.",
           "I expect your answer within 30 days."),
    "nl": ("Wis alstublieft alle gegevens over mij en laat ontvangers hetzelfde doen.",
           "Stuur mij een kopie van mijn gegevens met doelen, ontvangers en bewaartermijn.",
           "Ik verwacht uw antwoord binnen 30 dagen."),
    "de": ("Bitte löschen Sie alle Daten zu meiner Person und informieren Sie deren Empfänger.",
           "Bitte senden Sie mir eine Kopie meiner Daten mit Zwecken, Empfängern und Speicherdauer.",
           "Ich erwarte Ihre Antwort innerhalb von 30 Tagen."),
    "fr": ("Merci d'effacer toutes mes données et d'en avertir leurs destinataires.",
           "Merci de m'envoyer une copie de mes données avec finalités, destinataires et durée.",
           "J'attends votre réponse sous 30 jours."),
    "es": ("Borren todos mis datos y avisen a quienes los hayan recibido.",
           "Envíenme una copia de mis datos con fines, destinatarios y plazo de conservación.",
           "Espero su respuesta en 30 días."),
    "it": ("Cancellate tutti i miei dati e avvisate chi li ha ricevuti.",
           "Inviatemi una copia dei miei dati con finalità, destinatari e durata.",
           "Attendo risposta entro 30 giorni."),
    "pt": ("Apaguem todos os meus dados e avisem quem os recebeu.",
           "Enviem-me uma cópia dos meus dados com finalidades, destinatários e prazo.",
           "Aguardo resposta no prazo de 30 dias."),
}


def letter_rows():
    """(language, action, subject, body, ref_label) for every language and action."""
    rows = []
    for line in _SUBJECTS.strip().splitlines():
        lang, delete_subject, access_subject, ref = line.split("|")
        delete, access, closing = _BODIES[lang]
        for action, subject, wish in (("delete", delete_subject, delete),
                                      ("access", access_subject, access)):
            body = f"{wish}\n\n- %EMAIL%%ACCOUNT_REF%\n\n{closing}\n\n%NAME%"
            rows.append((lang, action, subject, body, ref))
    return rows
