"""Landed web pages -> Content.

text  = concatenation, without separator, of the full text of every element
        matching ``article, main, .content, #content`` in document order
        (a match nested in a match repeats its text); script text counts,
        comments do not; entities decoded.
title = text of all ``<title>`` elements.
No match -> empty text, still ingested.

Parsing needs a DOM walk, which built-in expressions cannot express, so it is
a small per-row helper on the stdlib ``html.parser`` inside an Arrow UDF; Spark partitions the pages.  A page that fails to parse yields an
error string instead of failing the task.
"""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.functions.parallel import per_row, spread
from kbspark.functions.text import go_string

# HTML void elements (no end tag, no content).
VOID_TAGS = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
# HTML5 RCDATA elements: their content is text (tags inside are literal), entities decoded.
RCDATA_TAGS = frozenset(("title", "textarea"))
# HTML5 RAWTEXT elements (scripting enabled): literal text, entities not decoded.
# script and style are handled by the stdlib parser already.
RAWTEXT_TAGS = frozenset(("xmp", "iframe", "noembed", "noframes", "noscript"))
# HTML formatting elements: their end tags do not close a block opened inside them.
FORMATTING_TAGS = frozenset("a b big code em font i nobr s small strike strong tt u".split())
# Fixed selector of the reference: article, main, .content, #content
SELECT_TAGS = frozenset(("article", "main"))
SELECT_CLASS = "content"
SELECT_ID = "content"


def _matches(tag: str, attrs) -> bool:
    if tag in SELECT_TAGS:
        return True
    for k, v in attrs:
        if k == "class" and v and SELECT_CLASS in v.split():
            return True
        if k == "id" and v == SELECT_ID:
            return True
    return False


class _Extractor(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int | None]] = []
        self.buffers: list[list[str]] = []
        self.open_matches: list[int] = []
        self.title: list[str] = []
        self.in_title = 0
        self.rcdata = False
        self.rawtext = False

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            return
        idx = None
        if _matches(tag, attrs):
            idx = len(self.buffers)
            self.buffers.append([])
            self.open_matches.append(idx)
        self.stack.append((tag, idx))
        if tag == "title":
            self.in_title += 1
        if tag in RCDATA_TAGS:
            self.set_cdata_mode(tag)          # raw text up to the matching end tag
            self.rcdata = True
        elif tag in RAWTEXT_TAGS:
            self.set_cdata_mode(tag)
            self.rawtext = True

    def handle_startendtag(self, tag, attrs):
        # HTML ignores the self-closing slash on non-void elements.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in RCDATA_TAGS:
            self.rcdata = False
        if tag in RAWTEXT_TAGS:
            self.rawtext = False
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag in FORMATTING_TAGS and any(t not in FORMATTING_TAGS for t, _ in self.stack[i + 1:]):
                    if self.stack[i][1] is not None:
                        self.open_matches.remove(self.stack[i][1])
                    del self.stack[i]
                    return
                for t, idx in self.stack[i:]:
                    if idx is not None:
                        self.open_matches.remove(idx)
                    if t == "title":
                        self.in_title -= 1
                del self.stack[i:]
                return
        # a stray end tag closes nothing

    def handle_data(self, data):
        if self.rcdata:
            data = unescape(data)
        for idx in self.open_matches:
            self.buffers[idx].append(data)
        if self.in_title > 0:
            self.title.append(data)


def extract_page(html: str | None) -> tuple[str, str, str | None]:
    """(title, text, error) of one page."""
    if html is None:
        return "", "", "no body"
    try:
        # HTML input preprocessing: newlines normalised to LF, NUL replaced.
        html = html.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "\ufffd")
        p = _Extractor()
        p.feed(html)
        p.close()
        if (p.rcdata or p.rawtext) and p.rawdata:     # an unclosed raw element runs to the end
            p.handle_data(p.rawdata)
        return "".join(p.title), "".join("".join(b) for b in p.buffers), None
    except Exception as ex:  # noqa: BLE001 - isolate the page, never fail the task
        return "", "", f"html parse error: {type(ex).__name__}"


_OUT = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()),
                     T.StructField("error", T.StringType())])


@F.arrow_udf(_OUT)
def _html_extract(html: pa.Array) -> pa.Array:
    return per_row(extract_page, html, ("title", "text", "error"))


# Nondeterministic only for the optimizer: a filter on the result must not be
# pushed below a repartition (which would re-run the parser in fewer tasks).
html_extract = _html_extract.asNondeterministic()


def parse_pages(landed: DataFrame, now: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Landed ``(source_id, url, body, fetched_at)`` -> Content rows + ``error``; columns
    ``keep`` are carried along."""
    now = now if now is not None else F.current_timestamp()
    x = spread(landed).withColumn("_p", html_extract(F.col("body")))
    return x.select(
        "source_id",
        go_string(F.col("_p.title")).alias("title"),
        go_string(F.col("_p.text")).alias("text"),
        go_string(F.col("url")).alias("source"),
        go_string(F.col("url")).alias("url"),
        now.alias("published_at"),
        F.col("_p.error").alias("error"), *keep,
    )
