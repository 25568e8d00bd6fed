"""Domains, vendor keys, suffixes and URLs as columns."""

from pyspark.sql import Column, functions as F

from ..dims import domains as dims
from .let import let


def root_domain(domain: Column) -> Column:
    """Last two labels, or three below a two-label public suffix."""
    return let(domain, lambda d: F.when(
        F.substring_index(d, ".", -2).isin(dims.COMPOUND_TLDS), F.substring_index(d, ".", -3)
    ).otherwise(F.substring_index(d, ".", -2)))


def mail_domain(email: Column) -> Column:
    """Second part of an address split at ``@``; null when there is none."""
    return let(F.try_element_at(F.split(email, "@"), F.lit(2)), lambda d: F.when(d != "", d))


def vendor_key(email: Column) -> Column:
    """Grouping key of a sender: its root domain, or the publisher on a shared platform."""
    split = let(F.lower(email), lambda address: F.struct(
        address.alias("address"),
        F.when(F.instr(address, "@") > 0, F.substr(address, F.instr(address, "@") + 1))
        .otherwise(address).alias("domain")))
    rooted = let(split, lambda s: F.struct(
        s["address"].alias("address"), s["domain"].alias("domain"), root_domain(s["domain"]).alias("root")))
    return let(rooted, lambda r: _vendor_key(r["address"], r["domain"], r["root"]))


def _vendor_key(address: Column, domain: Column, root: Column) -> Column:
    by_user = F.when(
        F.instr(address, "@") > 0, F.concat_ws(".", F.substring_index(address, "@", 1), domain)).otherwise(domain)
    below_root = domain != root
    return (
        F.when(domain.isin(dims.PLATFORM_DOMAINS) & below_root, by_user)
        .when(~root.isin(dims.PLATFORM_DOMAINS), root)
        .when(below_root, domain)
        .otherwise(by_user)
    )


def is_personal_domain(domain: Column) -> Column:
    """The domain, or its root, is a webmail provider."""
    return let(domain, lambda d: d.isin(dims.PERSONAL_DOMAINS) | root_domain(d).isin(dims.PERSONAL_DOMAINS))


def domain_suffixes(domain: Column) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``: turns an ends-with match into an equality join."""
    return let(F.split(domain, "[.]"), lambda labels: F.transform(
        labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))


def sender_suffixes(email: Column) -> Column:
    """Values of a whitelist that cover a sender: the address and every domain above it."""
    host = F.when(F.instr(email, "@") > 0, F.substring_index(email, "@", -1))
    parents = domain_suffixes(email)
    return F.when(
        host.isNotNull(), F.concat(F.array(email), domain_suffixes(host))
    ).otherwise(F.slice(parents, 2, F.size(parents)))


def inferred_name(domain: Column) -> Column:
    """Name guessed from the first label, first letter upper."""
    label = F.substring_index(domain, ".", 1)
    return F.when(label == "", domain).otherwise(
        F.concat(F.upper(F.substring(label, 1, 1)), F.substr(label, F.lit(2))))


def url_host(url: Column) -> Column:
    """Lower-case host of an absolute URL, null when it is not one."""
    return F.nullif(
        F.lower(F.regexp_extract(F.trim(url), r"\A[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)),
        F.lit(""))


def bare_host(url: Column) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(url_host(url), r"\Awww\.", "")


def company_domains(web: Column, webform: Column, email: Column) -> Column:
    """Distinct hosts of web, webform and mail domain, in that order."""
    found = F.array(bare_host(web), bare_host(webform), F.lower(mail_domain(email)))
    return F.array_distinct(F.filter(found, lambda d: d.isNotNull()))


def strip_query(url: Column) -> Column:
    """Origin and path of a web address; anything else is kept as it is."""
    return let(url, _origin_and_path)


def _origin_and_path(url: Column) -> Column:
    pattern = r"(?i)\A(https?)://(?:[^/?#@]*@)?([^/?#:\s]+)(:[0-9]+)?([^?#]*)"
    scheme = F.lower(F.regexp_extract(url, pattern, 1))
    port = F.regexp_extract(url, pattern, 3)
    default = ((scheme == "https") & (port == ":443")) | ((scheme == "http") & (port == ":80"))
    path = F.regexp_extract(url, pattern, 4)
    clean = F.concat(
        scheme, F.lit("://"), F.lower(F.regexp_extract(url, pattern, 2)),
        F.when(default, "").otherwise(port),
        F.when(path == "", "/").otherwise(path))
    return F.when(url.rlike(pattern), clean).otherwise(url)


def top_level(domain: Column) -> Column:
    return F.lower(F.substring_index(domain, ".", -1))
