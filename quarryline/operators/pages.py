"""From pages, and from plain texts, to contacts: anchors first, then text nodes, the first of equal ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contacts as C
from ..functions import html as H
from ..functions import urls as U


def _percent_decoded(raw: Column) -> Column:
    """Percent escapes resolved, + left alone; what is no valid escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def _matches() -> Column:
    """The candidates of a piece as structs (type, raw, email, pattern): an anchor's own, or all that its patterns find."""
    text, none = F.col("text"), F.lit(None).cast("string")
    row = lambda t, raw, email, n: F.struct(F.lit(t).alias("type") if isinstance(t, str) else t.alias("type"), raw.alias("raw"), email.alias("email"), F.lit(n).alias("pattern"))
    found = F.concat(
        F.transform(C.emails(text), lambda x: row("email", x, x, 0)),
        F.transform(C.obfuscated_emails(text), lambda x: row("email", x["raw"], x["email"], 1)),
        F.transform(C.phones(text), lambda x: row("phone", x, none, 2)),
        F.transform(C.profiles(text), lambda x: row("linkedin", x, none, 3)),
    )
    return F.when(F.col("type").isNotNull(), F.array(row(F.col("type"), F.btrim("text"), _percent_decoded(F.btrim("text")), 0))).otherwise(found)


def page_contacts(pages: DataFrame) -> DataFrame:
    """page_id, type, value, normalized_value, country, confidence, source_type, context of each contact of each page.

    A contact is reported where it is first found, but email anchors each time.
    Null or empty html has no contacts.
    """
    rows = H.pieces(pages).select("page_id", "url", "pos", F.col("type").isNotNull().alias("anchor"), "text", "source_type", "context", F.posexplode(_matches()).alias("nth", "m"))
    kind, raw, host, source = F.col("m.type"), F.col("m.raw"), U.domain(F.col("url")), F.col("source_type")
    rows = rows.withColumn("phone", F.when(kind == "phone", C.phone(raw, host)))
    number, profile, contact = F.col("phone"), C.profile(raw), U.contact_page(F.col("url"))
    normalized = (
        F.when((kind == "email") & C.email_valid(F.lower(F.col("m.email"))), F.lower(F.col("m.email")))
        .when((kind == "phone") & ~C.phone_false_positive(raw), number["e164"])
        .when(kind == "linkedin", profile["normalized"])
    )
    value = F.when((kind == "email") & F.col("anchor"), F.col("m.email")).when(kind == "linkedin", profile["clean"]).otherwise(raw)
    origin = F.when(F.col("m.pattern") == 1, F.lit("obfuscated")).otherwise(source)
    confidence = (
        F.when(kind == "email", C.email_confidence(origin, contact))
        .when(kind == "phone", C.phone_confidence(source, raw.startswith("+"), number["valid"], contact))
        .otherwise(C.profile_confidence(source, contact))
    )
    context = F.coalesce("context", C.context(F.col("text"), raw))
    out = rows.select(
        "page_id", "anchor", "pos", F.col("m.pattern").alias("pattern"), "nth", kind.alias("type"), value.alias("value"), normalized.alias("normalized_value"),
        number["country"].alias("country"), confidence.alias("confidence"), "source_type", context.alias("context"),
    ).where("normalized_value is not null")
    first = F.row_number().over(Window.partitionBy("page_id", "type", "normalized_value").orderBy("pos", "pattern", "nth"))
    out = out.withColumn("first", first).where("first = 1 or (type = 'email' and anchor)")
    return out.select("page_id", "type", "value", "normalized_value", "country", "confidence", "source_type", "context")


#: The host whose region numbers in plain texts take, as these name no page.
TEXT_HOST = "example.com"


def text_contacts(docs: DataFrame) -> DataFrame:
    """type, value, normalized_value, country, confidence, source_type, context, job, page, doc_id, pattern, nth of all that the patterns find in each whole text.

    Emails, obfuscated emails, phone numbers and profiles, as in a text node of
    a page's body. Each place counts; null or empty texts have no contacts.
    """
    rows = docs.select("doc_id", "source", "text", F.lit(None).cast("string").alias("type"))
    rows = rows.select("doc_id", "source", "text", F.posexplode(_matches()).alias("nth", "m"))
    kind, raw, host, source, contact = F.col("m.type"), F.col("m.raw"), F.lit(TEXT_HOST), F.lit("body"), F.lit(False)
    rows = rows.withColumn("phone", F.when(kind == "phone", C.phone(raw, host)))
    number, profile, email = F.col("phone"), C.profile(raw), F.lower(F.col("m.email"))
    normalized = (
        F.when((kind == "email") & C.email_valid(email), email)
        .when((kind == "phone") & ~C.phone_false_positive(raw), number["e164"])
        .when(kind == "linkedin", profile["normalized"])
    )
    origin = F.when(F.col("m.pattern") == 1, F.lit("obfuscated")).otherwise(source)
    confidence = (
        F.when(kind == "email", C.email_confidence(origin, contact))
        .when(kind == "phone", C.phone_confidence(source, raw.startswith("+"), number["valid"], contact))
        .otherwise(C.profile_confidence(source, contact))
    )
    value = F.when(kind == "linkedin", profile["clean"]).otherwise(raw)
    return rows.select(
        kind.alias("type"), value.alias("value"), normalized.alias("normalized_value"), number["country"].alias("country"), confidence.alias("confidence"),
        source.alias("source_type"), C.context(F.col("text"), raw).alias("context"),
        F.col("source").alias("job"), F.col("doc_id").cast("string").alias("page"), "doc_id", F.col("m.pattern").alias("pattern"), "nth",
    ).where("normalized_value is not null")
