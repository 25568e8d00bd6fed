"""Fixed domain and header lists used by ingest and classification."""

# Webmail domains that never name a company.
PERSONAL_DOMAINS = """
gmail.com googlemail.com
outlook.com hotmail.com hotmail.co.uk hotmail.de hotmail.fr hotmail.nl
live.com live.co.uk live.be live.de live.fr live.nl msn.com
yahoo.com yahoo.co.uk yahoo.de yahoo.fr ymail.com
icloud.com me.com mac.com
protonmail.com proton.me pm.me
fastmail.com tutanota.com tuta.com
aol.com
gmx.de gmx.net gmx.com web.de t-online.de
laposte.net orange.fr wanadoo.fr
btinternet.com
libero.it
hetnet.nl planet.nl kpnmail.nl xs4all.nl ziggo.nl upcmail.nl casema.nl home.nl
""".split()

# Sending platforms where each subdomain or user name is its own publisher.
PLATFORM_DOMAINS = """
substack.com beehiiv.com buttondown.email
zendesk.com intercom-mail.com freshdesk.com
ghost.io
calendar.luma-mail.com user.luma-mail.com
""".split()

# Public suffixes of two labels.
COMPOUND_TLDS = """
co.uk org.uk me.uk ac.uk
com.au net.au org.au
co.nz co.za co.in co.jp co.kr
com.br com.mx com.ar com.co
com.tr com.sg com.hk com.tw
""".split()

# Headers whose presence alone marks a bulk sender.
SENDER_PLATFORM_HEADERS = """
x-mailer-recptid x-klavio-id x-klaviyo
x-sg-id x-sg-eid x-smtpapi
x-mailchimp-id x-mc-user x-campaign-id x-mailgun-tag
x-brevo-id x-sib-id x-amazon-ses x-ses-message-id
x-iterable-id x-iterable x-hubspot-msgid x-pardot-id
x-marketo-id x-eloqua-id x-cm-mmlid x-drip
x-customer-io-id x-postmark-msgid
""".split()

# List headers (must be non-empty) and precedence words that mark bulk mail.
LIST_HEADERS = ["list-unsubscribe", "list-unsubscribe-post", "list-id"]
BULK_PRECEDENCE = ["bulk", "list", "auto", "junk"]

# Country domains that count for the "same country" breach relation.
COUNTRY_TLDS = "nl de fr be es it pl se no dk fi ie uk at ch cz pt gr hu ro".split()

# Slug endings that mark a national entity of a company.
COUNTRY_SLUG_SUFFIXES = """
de fr gb uk ie es it nl be at ch
pl gr ro pt se fi dk no is cz hu
cy sk si hr bg lt lv ee lu mt li
us ca au nz jp cn in br mx ru
""".split()
