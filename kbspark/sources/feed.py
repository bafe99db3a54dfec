"""Landed RSS, RDF, Atom and JSON Feed bodies -> Content (one row per item).

Parsed with the built-in ``from_xml`` (one schema covering RSS
``rss/channel/item``, RSS 1.0 ``rdf:RDF/item`` and Atom ``feed/entry``) and
``from_json``, then ``explode``.  Per item: title, text = item title,
description (Atom and JSON Feed: summary); source = the *feed* title; url = link;
published_at = parsed date (RSS: pubDate, else dc:date; Atom: published, else
updated), else ``now``.
A body that is not a feed rejects the fetch; a feed without items is a
successful fetch with no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions.text import go_string

_RSS_ITEM = "array<struct<title string, link string, description string, pubDate string, `dc:date` string>>"
FEED_SCHEMA = (
    f"channel struct<title string, item {_RSS_ITEM}>, item {_RSS_ITEM}, title string,"
    " entry array<struct<title string, link array<struct<_href string, _rel string>>, summary string,"
    " content string, published string, updated string>>"
)

JSON_FEED_SCHEMA = ("version string, title string,"
                    " items array<struct<title string, url string, summary string, date_published string>>")
# Fixed prefix of a JSON Feed's version.
JSON_FEED_VERSION = "https://jsonfeed.org/version/"

# Fixed date layouts accepted for item dates (RFC 1123 / RFC 822 variants, ISO 8601).
RFC_LAYOUTS = ("dd MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss Z", "dd MMM yyyy HH:mm:ss z",
               "d MMM yyyy HH:mm:ss z", "dd MMM yyyy HH:mm Z", "dd MMM yy HH:mm:ss Z")


def parse_feed_date(s) -> Column:
    s = F.col(s) if isinstance(s, str) else s
    body = F.regexp_replace(F.trim(s), "^[A-Za-z]{3,9},\\s*", "")
    tries = [F.try_to_timestamp(body, F.lit(fmt)) for fmt in RFC_LAYOUTS]
    tries.append(F.try_to_timestamp(F.trim(s)))
    return F.coalesce(*tries)


_ITEM = "struct<title:string,text:string,url:string,date:string,error:string>"


def parse_feeds(landed: DataFrame, now: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Landed ``(source_id, url, body, fetched_at)`` -> Content rows + ``error``.

    One parse and one ``explode`` per body: items or entries become rows; a body that is
    not a feed becomes one row with ``error`` (url = the landed url); a feed without items
    gives no row (it was still fetched). Columns ``keep`` are carried along.
    """
    now = now if now is not None else F.current_timestamp()
    json_like = F.coalesce(F.col("body").rlike("^\\s*\\{"), F.lit(False))
    x = landed.withColumn("_x", F.from_xml(F.when(~json_like, F.col("body")), FEED_SCHEMA, {"mode": "PERMISSIVE"})) \
              .withColumn("_j", F.from_json(F.when(json_like, F.col("body")), JSON_FEED_SCHEMA))
    is_json = F.coalesce(F.startswith(F.col("_j.version"), F.lit(JSON_FEED_VERSION)), F.lit(False))
    is_rss = F.col("_x.channel").isNotNull()
    is_atom = F.col("_x.entry").isNotNull() | F.col("_x.title").isNotNull()
    nul = F.lit(None).cast("string")
    rss = F.transform(F.coalesce(F.col("_x.channel.item"), F.col("_x.item")), lambda it: F.struct(
        it["title"].alias("title"), it["description"].alias("text"), it["link"].alias("url"),
        F.coalesce(it["pubDate"], it["dc:date"]).alias("date"), nul.alias("error")))
    jsn = F.transform(F.col("_j.items"), lambda it: F.struct(
        it["title"].alias("title"), it["summary"].alias("text"), it["url"].alias("url"),
        it["date_published"].alias("date"), nul.alias("error")))
    # Atom: text is the summary (content is a separate field), the link is the first
    # alternate/untyped one.
    atom = F.transform(F.col("_x.entry"), lambda it: F.struct(
        it["title"].alias("title"), it["summary"].alias("text"),
        F.try_element_at(F.filter(it["link"], lambda l: l["_rel"].isNull() | (l["_rel"] == "alternate")),
                         F.lit(1))["_href"].alias("url"),
        F.coalesce(it["published"], it["updated"]).alias("date"), nul.alias("error")))
    bad = F.array(F.struct(nul.alias("title"), nul.alias("text"), F.col("url").alias("url"), nul.alias("date"),
                           F.lit("not a feed").alias("error")))
    items = (F.when(is_rss, F.coalesce(rss, F.array().cast(f"array<{_ITEM}>")))
             .when(is_atom, F.coalesce(atom, F.array().cast(f"array<{_ITEM}>")))
             .when(is_json, F.coalesce(jsn, F.array().cast(f"array<{_ITEM}>")))
             .otherwise(bad))
    e = x.select("source_id", F.coalesce(F.col("_x.channel.title"), F.col("_x.title"), F.col("_j.title")).alias("feed_title"),
                 F.explode(items).alias("it"), *keep)
    ok = F.col("it.error").isNull()
    return e.select(
        "source_id",
        go_string(F.col("it.title")).alias("title"),
        go_string(F.col("it.text")).alias("text"),
        go_string(F.col("feed_title")).alias("source"),
        go_string(F.col("it.url")).alias("url"),
        F.when(ok, F.coalesce(parse_feed_date(F.col("it.date")), now)).alias("published_at"),
        F.col("it.error").alias("error"), *keep)
