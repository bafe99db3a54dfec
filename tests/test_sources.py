"""Ingest operators: HTML (S4), JSON (S3), feeds (S7), pages (S5), video (S6), updates."""

import datetime as dt

from pyspark.sql import functions as F

from kbspark.plans.ingest import ingest_updates
from kbspark.sources.api import parse_api, render_body
from kbspark.sources.feed import parse_feeds
from kbspark.sources.pages import stitch_pages
from kbspark.sources.video import parse_videos
from kbspark.sources.web import extract_page, parse_pages


def test_html_selector_semantics():
    t, x, e = extract_page("<html><head><title>A &amp; B</title></head><body><main>M<article>A<script>s()</script>"
                           "<b>b</article>N</main><div class='x content y'>C</div><div class='contents'>no</div>"
                           "<p id='content'>I<!-- c --></p></body>")
    assert e is None and t == "A & B"
    assert x == "MAs()bNAs()bCI"          # nested match repeats its text, document order


def test_html_edges():
    assert extract_page("<html><body><p>none</p></body></html>")[:2] == ("", "")   # no match, no title
    assert extract_page("<title>a</title><title>b</title>")[0] == "ab"            # all titles
    assert extract_page("")[:2] == ("", "")
    assert extract_page("<article><b>unclosed<p>x</article><footer>f</footer>")[1] == "unclosedx"


def test_formatting_end_tag_closes_no_block():
    assert extract_page("<b><article>one</b>two</article>three")[1] == "onetwo"
    assert extract_page("<article><b><i>x</b>y</i></article>z")[1] == "xy"
    assert extract_page("<b class=content>x<p>y</b>z</p>")[1] == "xy"


def test_html_rcdata():
    # title and textarea content is text: tags inside are literal, entities decoded
    t, x, _ = extract_page("<title>a<b>c</b> &amp; d</title><article>x<textarea>q<b>r</b></textarea></article>")
    assert t == "a<b>c</b> & d" and x == "xq<b>r</b>"
    assert extract_page("<title>open <article>a</article>")[:2] == ("open <article>a</article>", "")
    assert extract_page("<article>a\r\nb</article>")[1] == "a\nb"
    assert extract_page("<article><noscript><b>n</b>&amp;</noscript>z</article>")[1] == "<b>n</b>&amp;z"


def test_json_rendering():
    assert render_body('{"b":1,"a":[1,2]}') == ("map[a:[1 2] b:1]", None)
    assert render_body('{"a":{"x":null}}') == ("map[a:map[x:<nil>]]", None)
    assert render_body('{"n":1e3, "m":1e6, "f":2.5}') == ("map[f:2.5 m:1e+06 n:1000]", None)
    assert render_body("null") == ("map[]", None)
    assert render_body('{"a": NaN}')[0] is None and render_body('{"a": [-Infinity]}')[0] is None
    assert render_body("[1,2]")[0] is None and render_body("{bad")[0] is None


def test_parse_api_rejects_non_objects(spark):
    landed = spark.createDataFrame([("s", "u1", '{"k": 1}'), ("s", "u2", "[1]"), ("s", "u3", "nope")],
                                   "source_id string, url string, body string")
    got = {r.url: (r.text, r.error is None, r.title) for r in parse_api(landed).collect()}
    assert got["u1"] == ("map[k:1]", True, "API Data from u1")
    assert not got["u2"][1] and not got["u3"][1]


def test_parse_pages(spark):
    landed = spark.createDataFrame([("s", "http://x", "<title>T</title><article>hi</article>")],
                                   "source_id string, url string, body string")
    r = parse_pages(landed).first()
    assert (r.title, r.text, r.source, r.url) == ("T", "hi", "http://x", "http://x")


def test_feeds(spark):
    rss = ("<rss><channel><title>F</title><item><title>a</title><link>l1</link><description>d</description>"
           "<pubDate>Mon, 01 Jan 2024 00:05:00 +0000</pubDate></item><item><title>b</title><link>l2</link>"
           "</item></channel></rss>")
    empty = "<rss><channel><title>E</title></channel></rss>"
    atom = ('<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><entry><title>e</title>'
            '<link rel="self" href="x"/><link href="l3"/><summary>s</summary>'
            '<published>2024-01-02T03:04:05Z</published></entry>'
            '<entry><title>f</title><link rel="alternate" href="l4"/><content>c</content>'
            '<updated>2024-01-03T00:00:00Z</updated></entry></feed>')
    landed = spark.createDataFrame([("r", "u1", rss), ("r", "u2", empty), ("a", "u3", atom), ("x", "u4", "<rss")],
                                   "source_id string, url string, body string")
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    out = parse_feeds(landed, now).collect()
    got = {r.url: r for r in out if r.error is None}
    rej = [r for r in out if r.error is not None]
    assert set(got) == {"l1", "l2", "l3", "l4"}
    assert got["l4"].text == "" and got["l4"].published_at == dt.datetime(2024, 1, 3)     # updated
    assert got["l1"].published_at == dt.datetime(2024, 1, 1, 0, 5) and got["l1"].source == "F"
    assert got["l2"].text == "" and got["l2"].published_at == dt.datetime(2024, 1, 31)
    assert got["l3"].text == "s" and got["l3"].published_at == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert [r.url for r in rej] == ["u4"]


def test_feed_kinds_and_dates(spark):
    rdf = ('<rdf:RDF xmlns:rdf="r" xmlns="http://purl.org/rss/1.0/" xmlns:dc="d"><channel><title>R</title></channel>'
           "<item><title>a</title><link>r1</link><description>x</description><dc:date>2024-01-04T05:06:07Z</dc:date></item>"
           "<item><title>b</title><link>r2</link></item></rdf:RDF>")
    rss = "<rss><channel><title>F</title><item><title>c</title><link>r3</link><dc:date>2024-01-05T00:00:00Z</dc:date></item></channel></rss>"
    jsn = ('{"version": "https://jsonfeed.org/version/1.1", "title": "J", "items": [{"title": "j", "url": "j1", "summary": "s",'
           ' "date_published": "2024-01-06T00:00:00Z"}, {"url": "j2"}]}')
    landed = spark.createDataFrame([("r", "u1", rdf), ("r", "u2", rss), ("j", "u3", jsn), ("j", "u4", '{"title": "no feed"}'), ("j", "u5", None)],
                                   "source_id string, url string, body string")
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    out = parse_feeds(landed, now).collect()
    got = {r.url: (r.title, r.text, r.source, r.published_at.day) for r in out if r.error is None}
    assert got == {"r1": ("a", "x", "R", 4), "r2": ("b", "", "R", 31), "r3": ("c", "", "F", 5), "j1": ("j", "s", "J", 6), "j2": ("", "", "J", 31)}
    assert sorted(r.url for r in out if r.error is not None) == ["u4", "u5"]


def test_blank_updates_never_reach_the_model(spark):
    from kbspark.operators.embed import BatchModelEmbedder
    from kbspark.plans.ingest import prepare_updates, update_report

    def model(texts):
        if any(t is not None and not t.strip() for t in texts):
            raise AssertionError("blank text")
        return [[1.0, 2.0] if t and "bad" not in t else None for t in texts]
    ts = dt.datetime(2024, 1, 5)
    rows = [("x", "s", ts, 1), (" ", "s", ts, 2), ("bad", "s", ts, 3), ("y", "s" * 300, ts, 4), (None, "s", ts, 5), ("z", "s", ts, None)]
    u = spark.createDataFrame(rows, "content string, source string, updated_at timestamp, seq long")
    p = prepare_updates(u, BatchModelEmbedder(model, 2))
    assert {(r.seq, r.status) for r in p.collect()} == {(1, "ready"), (2, "skipped_blank"), (3, "failed_embed"), (4, "failed_insert"),
                                                        (5, "skipped_blank"), (None, "failed_insert")}
    r = {x.source: x for x in update_report(p).collect()}["s"]
    assert (r.n_seen, r.n_skipped_blank, r.n_failed_embed, r.n_failed_insert, r.n_added) == (5, 2, 1, 1, 1)


def test_video(spark):
    landed = spark.createDataFrame(
        [("y", "v1", '{"items":[{"snippet":{"title":"t","description":"d"}},{"snippet":{"title":"x"}}]}'),
         ("y", "v2", '{"items":[]}'), ("y", "v3", "garbage")], "source_id string, url string, body string")
    out = parse_videos(landed).collect()
    r = [x for x in out if x.error is None]
    assert [(x.title, x.text, x.source, x.url) for x in r] == [("t", "d", "youtube", "https://youtube.com/watch?v=v1")]
    assert sorted(x.url for x in out if x.error is not None) == ["v2", "v3"]


def test_stitch_pages(spark):
    pages = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("p", 3, None), ("p", 300, "z"), ("q", 1, None)],
                                  "path string, page_no long, text string")
    got = {r.title: r.text for r in stitch_pages(pages, block_pages=4).collect()}
    assert got == {"p": "abz", "q": ""}


def test_updates_skip_blank_last_wins(spark):
    ts = dt.datetime(2024, 1, 5, 12, 0, 0)
    upd = spark.createDataFrame([("first", "s", ts, 1), ("second", "s", ts, 2), (" \t", "s", ts, 3),
                                 (" ", "t", ts, 4)], "content string, source string, updated_at timestamp, seq long")
    kb = ingest_updates(upd, now=F.to_timestamp(F.lit("2024-01-31 00:00:00"))).collect()
    assert [(r.doc_id, r.content) for r in kb] == [(f"doc_s_{int(ts.replace(tzinfo=dt.timezone.utc).timestamp())}",
                                                    "second")]
