"""Candidate rows from picture search replies; choosing among them is in ``operators.pictures``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import text
from topicloom.operators import pictures

_VALUE = "struct<value:string>"
_WIKI = f"query struct<pages: map<string, struct<title: string, imageinfo: array<struct<thumburl: string, descriptionurl: string, extmetadata: struct<ImageDescription: {_VALUE}, Artist: {_VALUE}, LicenseShortName: {_VALUE}, LicenseUrl: {_VALUE}>>>>>>"
_PHOTO = "results array<struct<urls: struct<raw: string, regular: string, small: string>, alt_description: string, description: string, user: struct<name: string>, links: struct<html: string>>>"


def encyclopedia(replies: DataFrame) -> DataFrame:
    """query_id, query, ord, title, description, url, license, credit, page from (query_id, query, body); without markup."""
    pages = F.map_values(F.from_json("body", _WIKI)["query"]["pages"])
    each = replies.select("query_id", "query", F.posexplode(pages).alias("ord", "p")).withColumn("i", F.try_element_at("p.imageinfo", F.lit(1)))
    plain = lambda c: text.untagged(F.col(f"i.extmetadata.{c}.value"), "")
    license_ = F.coalesce(F.nullif(plain("LicenseShortName"), F.lit("")), plain("LicenseUrl"))
    return each.select("query_id", "query", F.col("ord").cast("long"), F.col("p.title").alias("title"), plain("ImageDescription").alias("description"), F.col("i.thumburl").alias("url"), license_.alias("license"), plain("Artist").alias("credit"), F.col("i.descriptionurl").alias("page"))


def photos(replies: DataFrame, width: int = 900) -> DataFrame:
    """topic_id, ord, query, url, alt, description, credit, page from (topic_id, query, ord, body); without a URL none."""
    each = replies.select("topic_id", "query", F.col("ord").alias("query_ord"), F.posexplode(F.from_json("body", _PHOTO)["results"]).alias("place", "p"))
    link = F.coalesce(F.concat(F.col("p.urls.raw"), F.lit(f"&w={width}&fit=max&q=80")), F.col("p.urls.regular"), F.col("p.urls.small"))
    some = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    alt = text.squeezed(some(F.col("p.alt_description"), F.col("p.description"), F.col("query")))
    described = text.squeezed(some(F.col("p.description"), F.col("p.alt_description"), alt))
    rows = each.select("topic_id", (F.col("query_ord") * 1000 + F.col("place")).cast("long").alias("ord"), "query", link.alias("url"), alt.alias("alt"), described.alias("description"), pictures.credit(F.col("p.user.name")).alias("credit"), F.col("p.links.html").alias("page"))
    return rows.filter("url is not null")
