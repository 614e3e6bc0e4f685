"""URL functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query parameters that tracking adds, extensions of static files, words of contact pages.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "ref", "source",
]
STATIC = [
    "png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "bmp", "tiff", "mp3", "mp4", "wav", "avi", "mov", "wmv", "webm", "zip", "tar", "gz", "7z",
    "rar", "bz2", "exe", "dmg", "app", "deb", "rpm", "apk", "css", "js", "mjs", "woff", "woff2", "ttf", "eot", "json",
]
CONTACT_WORDS = [
    "contact", "contact-us", "contact_us", "contacts", "about", "about-us", "about_us", "team", "our-team", "company", "support", "help",
    "customer-service", "reach-us", "location", "staff", "people",
]

#: scheme, authority, path, query and fragment (RFC 3986, appendix B); path parameters are cut off apart.
PARTS = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
STATIC_RE = r"\.(" + "|".join(STATIC) + r")$"
CONTACT_RE = "|".join(CONTACT_WORDS)


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def path(url: Column) -> Column:
    """The path without the parameters of its last segment."""
    return F.regexp_replace(part(url, 3), r";[^/]*$", "")


def domain(url: Column) -> Column:
    """Lower-case host without user and port; an IPv6 host keeps its brackets."""
    host = F.regexp_replace(F.lower(part(url, 2)), r"^.*@", "")
    return F.regexp_extract(host, r"^(\[[^\]]*\]|[^:]*)", 1)


def _below(host: Column, name: Column, subdomains: bool) -> Column:
    test = host == name
    return test | host.endswith(F.concat(F.lit("."), name)) if subdomains else test


def same_domain(url: Column, allowed: list[str] | Column, subdomains: bool = True) -> Column:
    """Whether the URL's host is one of `allowed` (names, or an array column of them), or below one; ports are cut off."""
    host = domain(url)
    names = allowed if isinstance(allowed, Column) else F.array(*[F.lit(a) for a in allowed]).cast("array<string>")
    return (host != "") & F.exists(F.transform(names, lambda a: F.substring_index(F.lower(a), ":", 1)), lambda a: _below(host, a, subdomains))


def in_domains(rows: DataFrame, url: str, allowed: DataFrame, subdomains: bool = True) -> DataFrame:
    """Rows whose URL's host is in the table `allowed` (domain) of any size, or below one of them: an equi-join on the host's suffixes."""
    names = allowed.select(F.substring_index(F.lower("domain"), ":", 1).alias("_allowed")).distinct()
    labels = F.split(domain(F.col(url)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select(domain(F.col(url)).alias("_host"), (suffixes if subdomains else F.array(domain(F.col(url)))).alias("s")).distinct()
    inside = hosts.select("_host", F.explode("s").alias("_allowed")).join(names, "_allowed", "left_semi").select("_host").distinct()
    return rows.join(inside, domain(F.col(url)) == F.col("_host"), "left_semi")


def crawlable(url: Column) -> Column:
    """Whether the path does not end like a static file."""
    return ~F.lower(path(url)).rlike(STATIC_RE)


def contact_page(url: Column) -> Column:
    return F.lower(path(url)).rlike(CONTACT_RE)


def priority(url: Column) -> Column:
    """100 for contact pages, else 50 less 5 a segment, 10 at least."""
    depth = F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))
    return F.when(contact_page(url), 100).otherwise(50 - F.least(5 * depth, F.lit(40))).cast("int")


def percent_decoded(text: Column) -> Column:
    """Valid percent escapes resolved as UTF-8; anything else, + and lone % too, as it is."""
    runs = F.regexp_extract_all(text, F.lit(r"(?s)(?:%[0-9A-Fa-f]{2})+|%|[^%]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda p: F.when(p.rlike("^%[0-9A-Fa-f]{2}"), F.try_url_decode(p)).otherwise(p)), "")


def _form_decoded(text: Column) -> Column:
    return percent_decoded(F.translate(text, "+", " "))


def _form_encoded(text: Column) -> Column:
    """Letters, digits and _ . - ~ as they are, a space as +, all else as percent escapes."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query(query: Column) -> Column:
    """Pairs with a value, without tracking names, in code-point order, form-encoded."""
    given = F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=."))
    pairs = F.transform(given, lambda p: F.struct(
        _form_decoded(F.substring_index(p, "=", 1)).alias("k"), _form_decoded(F.regexp_replace(p, "(?s)^[^=]*=", "")).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING))
    return F.array_join(F.transform(F.sort_array(kept), lambda p: F.concat(_form_encoded(p["k"]), F.lit("="), _form_encoded(p["v"]))), "&")


def normalized(url: Column) -> Column:
    """The absolute http(s) URL in normal form, else null.

    Lower-case scheme and authority, no default port, no fragment, no
    parameters, single slashes, no trailing slash, sorted query without tracking.
    """
    url = F.regexp_replace(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""), r"[\t\r\n]", "")
    scheme, host = F.lower(part(url, 1)), F.lower(part(url, 2))
    whole = F.contains(host, F.lit("[")) == F.contains(host, F.lit("]"))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    way = F.regexp_replace(F.regexp_replace(path(url), "/+", "/"), "(?<=.)/$", "")
    way = F.when(way == "", "/").otherwise(way)
    query = _query(part(url, 4))
    full = F.concat(scheme, F.lit("://"), host, way, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (host != "") & whole, full)


@F.pandas_udf(StringType())
def joined(base: pd.Series, url: pd.Series) -> pd.Series:
    """url as seen from base (RFC 3986); null where it can't be read."""
    from urllib.parse import urljoin

    def one(b, u):
        try:
            return None if u is None else urljoin(b or "", u.strip())
        except ValueError:
            return None

    return pd.Series([one(b, u) for b, u in zip(base, url)], dtype=object)
