"""Text clean-up as columns."""

from pyspark.sql import Column, functions as F

from ..dims.patterns import WHITE_CHARS, WHITE_SPACE
from .let import let

# Runs that aren't a single blank, which would be replaced by itself.
_SPACES = f"[{WHITE_SPACE}&&[^ ]][{WHITE_SPACE}]*| [{WHITE_SPACE}]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def collapse(col: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(col, _SPACES, " "))


def js_trim(col: Column) -> Column:
    """Trim any Unicode white space, keep inner runs."""
    return F.btrim(col, F.lit(WHITE_CHARS))


def html_to_text(col: Column) -> Column:
    """Visible text of an HTML document; empty for null."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), r"(?is)<style.*?</style>", "")
    text = F.regexp_replace(text, r"(?is)<script.*?</script>", "")
    return collapse(F.regexp_replace(text, r"<[^>]*>", " "))


def strip_tags(col: Column) -> Column:
    """Tags vanish without leaving a blank; used for table cells. Empty for null."""
    text = F.coalesce(col, F.lit(""))
    return collapse(F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, r"<[^>]*>", "")).otherwise(text))


def first_href(col: Column) -> Column:
    """First ``href`` value, null when there is none."""
    return F.nullif(F.regexp_extract(col, r"""(?i)href=["']([^"']+)["']""", 1), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, as case-insensitive LIKE does in the embedded store."""
    return F.translate(col, _UPPER, _UPPER.lower())


def capitalized(col: Column) -> Column:
    """First letter upper, the rest lower."""
    return let(col, lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2)))))


def body_preview(text: Column, html: Column, snippet: Column, length: int = 150) -> Column:
    """First characters of the text body, else of the cleaned HTML, else of the snippet."""
    body = F.coalesce(F.when(text != "", text), F.when(html.isNotNull(), html_to_text(html)))
    preview = let(F.substring(collapse(body), 1, length), lambda p: F.when(p != "", p))
    return F.coalesce(preview, F.substring(snippet, 1, length), F.lit(""))
