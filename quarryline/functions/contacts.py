"""Contact patterns, validity and confidence as column expressions."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, endings that are no top-level domains, regions by top-level domain, path names that are no profiles.
EMAIL = (
    r"\b[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
    r"(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*\.[A-Za-z]{2,63}\b"
)
OBFUSCATED = (
    r"\b([A-Za-z0-9._%+-]+)\s*(?:\[at\]|\(at\)|\[@\]|\bAT\b)\s*([A-Za-z0-9.-]+)\s*(?:\[dot\]|\(dot\)|\[\.\]|\bDOT\b)\s*([A-Za-z]{2,24})\b"
)
NOT_TLD = [
    "png", "jpg", "jpeg", "gif", "svg", "webp", "bmp", "ico", "js", "css", "woff", "woff2", "ttf", "eot", "mp3", "mp4", "webm", "zip", "tar", "gz",
    "when", "great", "post", "we", "at", "to", "in", "on", "for", "with", "by", "from", "about", "this", "that", "it", "they",
]
REGIONS = {"uk": "GB", "us": "US", "ca": "CA", "in": "IN", "au": "AU", "de": "DE", "fr": "FR", "es": "ES", "it": "IT", "nl": "NL", "br": "BR", "jp": "JP"}
PROFILE = r"(?i)(?:https?://)?(?:[a-zA-Z0-9-]+\.)*linkedin\.com/(in|company|school|showcase)/([a-zA-Z0-9\-_%]+)/?"
NO_PROFILE = [
    "sharing", "sharearticle", "share-offsite", "login", "signup", "feed", "jobs", "learning", "help", "legal", "pulse", "posts", "newsletters",
    "events", "search", "checkpoint", "notifications", "messaging", "groups", "pub", "in", "company", "school",
]
# Calling code, its main region, the prefix that national numbers are dialled with, their least and greatest length without it.
PLANS = [
    ("1", "US", "1", 10, 10), ("7", "RU", "8", 10, 10), ("20", "EG", "0", 8, 10), ("27", "ZA", "0", 9, 9), ("30", "GR", "", 10, 10),
    ("31", "NL", "0", 9, 9), ("32", "BE", "0", 8, 9), ("33", "FR", "0", 9, 9), ("34", "ES", "", 9, 9), ("36", "HU", "06", 8, 9),
    ("39", "IT", "", 6, 11), ("40", "RO", "0", 9, 9), ("41", "CH", "0", 9, 9), ("43", "AT", "0", 7, 13), ("44", "GB", "0", 9, 10),
    ("45", "DK", "", 8, 8), ("46", "SE", "0", 7, 10), ("47", "NO", "", 8, 8), ("48", "PL", "", 9, 9), ("49", "DE", "0", 7, 12),
    ("51", "PE", "0", 8, 9), ("52", "MX", "", 10, 10), ("54", "AR", "0", 10, 11), ("55", "BR", "0", 10, 11), ("56", "CL", "", 9, 9),
    ("57", "CO", "", 10, 10), ("60", "MY", "0", 8, 10), ("61", "AU", "0", 9, 9), ("62", "ID", "0", 8, 12), ("63", "PH", "0", 8, 10),
    ("64", "NZ", "0", 8, 10), ("65", "SG", "", 8, 8), ("66", "TH", "0", 8, 9), ("81", "JP", "0", 9, 10), ("82", "KR", "0", 8, 10),
    ("84", "VN", "0", 9, 10), ("86", "CN", "0", 10, 11), ("90", "TR", "0", 10, 10), ("91", "IN", "0", 10, 10), ("92", "PK", "0", 9, 10),
    ("98", "IR", "0", 10, 10), ("212", "MA", "0", 9, 9), ("234", "NG", "0", 8, 10), ("254", "KE", "0", 9, 9), ("351", "PT", "", 9, 9),
    ("352", "LU", "", 6, 9), ("353", "IE", "0", 7, 9), ("354", "IS", "", 7, 7), ("358", "FI", "0", 6, 10), ("359", "BG", "0", 8, 9),
    ("370", "LT", "0", 8, 8), ("371", "LV", "", 8, 8), ("372", "EE", "", 7, 8), ("380", "UA", "0", 9, 9), ("385", "HR", "0", 8, 9),
    ("386", "SI", "0", 8, 8), ("420", "CZ", "", 9, 9), ("421", "SK", "0", 9, 9), ("852", "HK", "", 8, 8), ("886", "TW", "0", 8, 9),
    ("966", "SA", "0", 8, 9), ("971", "AE", "0", 8, 9), ("972", "IL", "0", 8, 9),
]
# Canadian area codes, and digits of a number without its area code, which counts as possible there.
CANADA = [
    "204", "226", "236", "249", "250", "257", "263", "289", "306", "343", "354", "365", "367", "368", "382", "387", "403", "416", "418", "428",
    "431", "437", "438", "450", "460", "468", "474", "506", "514", "519", "537", "548", "568", "579", "581", "584", "587", "600", "604", "613",
    "639", "647", "672", "683", "705", "709", "742", "753", "767", "778", "780", "782", "807", "819", "825", "867", "873", "879", "902", "905",
]
LOCAL = 7
#: The parts of OBFUSCATED (a match without what stands around it), and what a text must hold for a match: one of each.
OBFUSCATED_PARTS = "^" + OBFUSCATED.removeprefix(r"\b").removesuffix(r"\b") + "$"
AT_MARKS, DOT_MARKS = ("[at]", "(at)", "[@]", "AT"), ("[dot]", "(dot)", "[.]", "DOT")
#: What a text must hold for a match of PROFILE; no repetition, so cheap to look for.
PROFILE_MARK = r"(?i)linkedin\.com/(?:in|company|school|showcase)/"
#: A number that may be a phone number: digits with the usual marks between them.
PHONE = r"\+?\(?[0-9][0-9 ().-]{5,18}[0-9]"


def emails(text: Column) -> Column:
    return F.when(F.instr(text, "@") > 0, F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _holds(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])


def obfuscated_emails(text: Column) -> Column:
    """raw match and address of each obfuscated form. Texts without the marks of one are not searched, and the others once."""
    raws = F.regexp_extract_all(text, F.lit(OBFUSCATED), F.lit(0))
    found = F.when(_holds(text, AT_MARKS) & _holds(text, DOT_MARKS), raws).otherwise(F.array().cast("array<string>"))
    part = lambda raw, i: F.regexp_extract(raw, OBFUSCATED_PARTS, i)
    return F.transform(found, lambda x: F.struct(x.alias("raw"), F.concat(part(x, 1), F.lit("@"), part(x, 2), F.lit("."), part(x, 3)).alias("email")))


def email_valid(email: Column) -> Column:
    host = F.substring_index(email, "@", -1)
    tld = F.lower(F.substring_index(host, ".", -1))
    return (
        email.rlike(r"^[^@ \r\n]+@[^@ \r\n]+$") & (F.instr(host, ".") > 0) & ~tld.isin(NOT_TLD) & F.length(tld).between(2, 24)
    )


def email_confidence(source: Column, contact_page: Column) -> Column:
    return (
        F.when(source == "mailto", 0.99).when(source == "address", 0.95).when(source == "obfuscated", 0.75)
        .when(contact_page, 0.90).when(source.isin("header", "footer"), 0.88).otherwise(0.85)
    )


def phones(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))


def profiles(text: Column) -> Column:
    """Profile URLs as they are written. Texts without the host and a kind after it are not searched."""
    return F.when(text.rlike(PROFILE_MARK), F.regexp_extract_all(text, F.lit(PROFILE), F.lit(0))).otherwise(F.array().cast("array<string>"))


def phone_false_positive(raw: Column) -> Column:
    """Too short or long, a date, a run of digits in order, one digit repeated, or bare digits with little variety."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    n = F.length(digits)
    bare = ~raw.rlike(r"[-() +]")
    variety = F.size(F.array_distinct(F.split(digits, "")))
    return (
        (n < 7) | (n > 15) | raw.rlike(r"^\s*[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}\s*$")
        | digits.isin("0123456789", "1234567890", "0987654321", "9876543210") | digits.rlike(r"^([0-9])\1{6,}$")
        | (bare & ((n <= 8) | (variety <= 3)))
    )


def region(host: Column) -> Column:
    """Default region by the host's last label, else US."""
    table = F.create_map(*[F.lit(x) for kv in REGIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.substring_index(host, ".", -1))), F.lit("US"))


def _bound(value: Column, then) -> Column:
    """then(value) with the value computed once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _plan(key: Column, by: int) -> Column:
    """The numbering plan of a calling code (by = 0) or region (by = 1): struct(code, region, trunk, lo, hi), else null."""
    table = {p[by]: dict(zip(("code", "region", "trunk", "lo", "hi"), p)) for p in PLANS}
    if by:
        table["CA"] = table["US"]
    return F.try_element_at(F.from_json(F.lit(json.dumps(table)), "map<string, struct<code: string, region: string, trunk: string, lo: int, hi: int>>"), key)


def phone(raw: Column, host: Column) -> Column:
    """struct(e164, valid, country) of a number, or null if it is no possible one.

    A declared subset of numbering: PLANS by length. A number that starts with +
    (or 011 or 00, as dialled from the default region of the host) has a calling
    code; others are national numbers of the default region, with its trunk
    prefix or without. A code that PLANS lacks is taken as it is, with 8 to 15
    digits. Valid are numbers of a full length that start as their plan's do.
    """

    def read(x):
        digits, home = x["digits"], x["home"]
        north = home.isin("US", "CA")
        abroad = F.when(x["plus"], digits).when(north & digits.startswith("011"), F.substring(digits, 4, 20)).when(~north & digits.startswith("00"), F.substring(digits, 3, 20))
        return F.struct(digits.alias("digits"), home.alias("home"), abroad.alias("abroad"))

    def planned(x):
        abroad = x["abroad"]
        plan = F.when(abroad.isNull(), _plan(x["home"], 1)).otherwise(F.coalesce(*[_plan(F.substring(abroad, 1, k), 0) for k in (3, 2, 1)]))
        return F.struct(x["digits"].alias("digits"), x["home"].alias("home"), abroad.alias("abroad"), plan.alias("p"))

    def cut(x):
        p, abroad = x["p"], x["abroad"]
        rest = F.when(abroad.isNull(), x["digits"]).otherwise(F.substring(abroad, F.length(p["code"]) + 1, F.lit(20)))
        keep = lambda r: F.when((p["trunk"] != "") & r.startswith(p["trunk"]) & (F.length(r) - F.length(p["trunk"])).between(p["lo"], p["hi"]), F.substring(r, F.length(p["trunk"]) + 1, F.lit(20))).otherwise(r)
        return F.struct(x["home"].alias("home"), abroad.alias("abroad"), p.alias("p"), _bound(rest, keep).alias("national"))

    def judged(x):
        p, national, abroad = x["p"], x["national"], x["abroad"]
        full = F.length(national).between(p["lo"], p["hi"])
        starts = F.when(p["code"] == "1", national.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")).otherwise((p["region"] == "IT") | ~national.startswith("0"))
        possible = full | (abroad.isNull() & (p["code"] == "1") & (F.length(national) == LOCAL))
        return F.struct(x["home"].alias("home"), abroad.alias("abroad"), p.alias("p"), national.alias("national"), possible.alias("possible"), (full & starts).alias("valid"))

    def told(x):
        p, national, valid = x["p"], x["national"], x["valid"]
        north = F.when(~valid, x["home"]).when(F.substring(national, 1, 3).isin(CANADA), "CA").otherwise("US")
        country = F.when(p["code"] == "1", north).when(valid, p["region"])
        known = F.struct(F.concat(F.lit("+"), p["code"], national).alias("e164"), valid.alias("valid"), country.alias("country"))
        other = F.struct(F.concat(F.lit("+"), x["abroad"]).alias("e164"), F.lit(True).alias("valid"), F.lit(None).cast("string").alias("country"))
        return F.when(p.isNull(), F.when(F.length(x["abroad"]).between(8, 15), other)).when(x["possible"], known)

    given = F.struct(F.regexp_replace(raw, "[^0-9]", "").alias("digits"), region(host).alias("home"), raw.rlike(r"^\s*\(?\+").alias("plus"))
    return _bound(given, lambda a: _bound(read(a), lambda b: _bound(planned(b), lambda c: _bound(cut(c), lambda d: _bound(judged(d), told)))))


def phone_confidence(source: Column, plus: Column, valid: Column, contact_page: Column) -> Column:
    return (
        F.when(source == "tel", 0.98).when(source == "address", 0.92).when(plus & valid, 0.95)
        .when(contact_page, 0.90).when(valid, 0.88).otherwise(0.75)
    )


def profile(raw: Column) -> Column:
    """struct(clean, normalized, kind) of a profile URL, else null. The host must be linkedin.com or below it."""
    url = F.btrim(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), F.lit(".,;:()[]{}<>\"'"))
    url = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    match = r"^https?://(?:[^/?#@]*@)?(?i:(?:[^/?#@:]+\.)?linkedin\.com)(?::[0-9]*)?/+([^/?#;]+)/([^/?#;]+)"
    kind = F.lower(F.regexp_extract(url, match, 1))
    slug = F.try_url_decode(F.replace(F.regexp_extract(url, match, 2), F.lit("+"), F.lit("%2B")))
    ok = kind.isin("in", "company", "school", "showcase") & slug.rlike(r"^[A-Za-z0-9\-_%]{2,100}$") & ~F.lower(slug).isin(NO_PROFILE)
    base = F.concat(F.lit("https://www.linkedin.com/"), kind, F.lit("/"))
    return F.when(ok, F.struct(F.concat(base, slug).alias("clean"), F.concat(base, F.lower(slug)).alias("normalized"), kind.alias("kind")))


def profile_confidence(source: Column, contact_page: Column) -> Column:
    return F.when(source.isin("header", "footer", "address"), 0.98).when(source.isin("anchor", "attribute"), 0.95).when(contact_page, 0.90).otherwise(0.85)


def context(text: Column, target: Column, before: int = 80, after: int = 80) -> Column:
    """What stands around the first place of target (any case), white space as single spaces, ... where it is cut; 300 characters at most."""
    flat = lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "))
    at = lambda x: F.position(F.lower(target), F.lower(x))
    found = lambda x, place: F.struct(x.alias("text"), place.alias("at"), F.length(x).alias("n"))

    def ends(x):
        start = F.greatest(x["at"] - 1 - before, F.lit(0))
        end = F.least(x["at"] - 1 + F.length(target) + after, x["n"])
        cut = F.concat(F.when(start > 0, "...").otherwise(""), flat(F.substring(x["text"], start + 1, end - start)), F.when(end < x["n"], "...").otherwise(""))
        return F.when(x["at"] > 0, F.substring(cut, 1, 300)).otherwise(F.btrim(F.substring(F.regexp_replace(text, r"\s+", " "), 1, 200)))

    # a text may be long: it is lowered and searched once
    there = _bound(at(text), lambda place: F.when(place > 0, found(text, place)).otherwise(_bound(flat(text), lambda x: found(x, at(x)))))
    return F.when((F.length(text) > 0) & (F.length(target) > 0), _bound(there, ends))
