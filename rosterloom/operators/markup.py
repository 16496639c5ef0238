"""Fields of web pages and of mails saved as HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The header lines of a saved mail.
MAIL_FIELDS = ["From", "Sent", "To", "Subject"]


def plain_text(html: Column) -> Column:
    """Text without scripts, styles and tags; runs of blanks become one."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.regexp_replace(bare, entity, char)
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def page_fields(pages: DataFrame) -> DataFrame:
    """page_id, host, language, title and number of links."""
    return pages.select(
        "page_id",
        F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host"),
        F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("page_lang"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all("html", F.lit('<a href="'), F.lit(0))).cast("long").alias("n_links"),
    )


def mail_fields(frame: DataFrame, html: str) -> DataFrame:
    """From, Sent, To and Subject of a saved mail, and the text after them as Body."""
    text = plain_text(F.col(html))
    out = frame.withColumn("_text", text)
    for name in MAIL_FIELDS:
        following = "|".join(f"{n}:" for n in MAIL_FIELDS if n != name)
        out = out.withColumn(name.lower(), F.trim(F.regexp_extract("_text", rf"(?s)\b{name}:(.*?)(?={following}|Body:|$)", 1)))
    return out.withColumn("body", F.trim(F.regexp_extract("_text", r"(?s)\bBody:(.*)$", 1))).drop("_text")
