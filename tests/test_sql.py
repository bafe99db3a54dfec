"""Functions of SQL text; JSON bodies that must not end a job; sources without a type."""

import pytest
from pyspark.sql import functions as F

from kbspark.functions.sql import register_sql
from kbspark.functions.text import build_prompt
from kbspark.sources.api import go_value, parse_api, render_body


def test_scalar_functions(spark):
    register_sql(spark)
    register_sql(spark)
    r = spark.sql("""SELECT cosine_similarity(array(1, 0), array(1, 1)) a, cosine_similarity(array(0, 0), array(1, 1)) z,
                            cosine_similarity(NULL, array(1, 1)) n, cosine_similarity(array(1, NULL), array(1, 1)) e, sim_key(0.4999999996) k,
                            has_text('\\u00a0\\t') b, has_text(NULL) c, has_text('x') d,
                            update_doc_id(NULL, timestamp '1969-12-31 23:59:59.5') u, build_prompt(array('it''s', '100%'), NULL) p""").first()
    assert abs(r.a - 0.5 ** 0.5) < 1e-12 and r.z is None and r.n is None and r.e is None and r.k == 500000000
    assert (r.b, r.c, r.d, r.u) == (False, False, True, "doc__-1")
    assert r.p == spark.range(1).select(build_prompt(F.array(F.lit("it's"), F.lit("100%")), F.lit(None).cast("string"))).first()[0]
    with pytest.raises(Exception, match="different vector dimensions"):
        spark.sql("SELECT cosine_similarity(array(1), array(1, 2))").collect()


def test_table_functions(spark):
    register_sql(spark)
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, None), ("a", 2, "y"), (None, 1, "z"), ("b", 1, None)], "path string, page_no int, text string")
    out = spark.sql("SELECT * FROM top_rows(TABLE({d}) PARTITION BY path ORDER BY (page_no DESC), 2)", d=df).collect()
    assert sorted((str(r.path), r.page_no, r["rank"]) for r in out) == [("None", 1, 1), ("a", 2, 2), ("a", 3, 1), ("b", 1, 1)]
    out = spark.sql("SELECT * FROM stitch_pages(TABLE({d}) PARTITION BY path ORDER BY page_no)", d=df).collect()
    assert sorted((r.path, r.text) for r in out) == [("", "z"), ("a", "yx"), ("b", "")]
    assert spark.sql("SELECT * FROM top_rows(TABLE({d}) PARTITION BY path ORDER BY (page_no), 2)", d=df.limit(0)).count() == 0


def test_no_body_ends_a_job(spark):
    deep = '{"a":' * 1000 + "[" * 600 + "]" * 600 + "}" * 1000
    bodies = [deep, '{"\\ud800":"\\udc00","k":"\\ud83d\\ude00"}', "[" * 100_000, "{", None, "null", '{"a":[],"b":{},"c":[1,[true,null]]}']
    landed = spark.createDataFrame([("s", f"u{i}", b, None) for i, b in enumerate(bodies)], "source_id string, url string, body string, fetched_at timestamp")
    out = {r.url: (r.text, r.error) for r in parse_api(landed).collect()}
    assert out["u0"] == ("map[a:" * 1000 + "[" * 600 + "]" * 600 + "]" * 1000, None)
    assert out["u1"] == ("map[k:\U0001F600 \ufffd:\ufffd]", None)
    assert all(out[f"u{i}"][1] for i in (2, 3, 4)) and out["u5"] == ("map[]", None)
    assert out["u6"] == ("map[a:[] b:map[] c:[1 [true <nil>]]]", None)
    assert go_value({"b": 1, "a": {"x": [[], {}]}}) == "map[a:map[x:[[] map[]]] b:1]" and render_body("[1]")[1] == "JSON body is not an object"


def test_a_source_without_a_type_is_rejected(spark):
    from kbspark.operators.registry import dispatch
    reg = spark.createDataFrame([("s1", None, "u", "x", None, True, None), ("s2", "ftp", "u", "x", None, True, None)],
                                "id string, type string, url string, schedule string, last_updated timestamp, active boolean, created_at timestamp")
    landed = spark.createDataFrame([("s1", "u", "body", None, None)], "source_id string, url string, body string, page_no long, fetched_at timestamp")
    content, rejects, ok = dispatch(reg, landed)
    assert {(r.source_id, r.reason) for r in rejects.collect()} == {("s1", "unknown source type: "), ("s2", "unknown source type: ftp")}
    assert content.count() == 0 and ok.count() == 0
