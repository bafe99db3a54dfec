"""S3: landed REST API bodies -> Content.

The body must decode to a JSON *object* (``null`` decodes to an empty map);
anything else rejects the fetch.  title = ``API Data from <url>``; text = the
Go ``%v`` rendering of the decoded map (sorted keys, ``map[k:v ...]``, arrays
``[a b]``, ``<nil>``, float64 numbers in shortest ``%g`` form); source = url =
the URL.

Decoding and the canonical text, which is nested, are a small per-row helper
in an Arrow UDF. Constants that JSON does not have (``NaN``,
``Infinity``) make a body malformed; a lone surrogate escape reads as U+FFFD.
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.functions.parallel import per_row, spread
from kbspark.functions.text import go_string

# Fixed value of the reference: title of API content.
API_TITLE_PREFIX = "API Data from "


def go_float(x: float) -> str:
    """Go's ``%v`` of a float64: shortest round-trip digits (``%g`` with precision -1),
    exponent form (at least two exponent digits) when the decimal exponent is < -4 or >= 6."""
    if x == 0:
        return "-0" if math.copysign(1.0, x) < 0 else "0"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    if math.isnan(x):
        return "NaN"
    sign, digits, exp = Decimal(repr(x)).normalize().as_tuple()
    ds = "".join(map(str, digits))
    e10 = len(ds) + exp - 1           # exponent of the first digit
    s = "-" if sign else ""
    if e10 < -4 or e10 >= 6:
        m = ds[0] + ("." + ds[1:] if len(ds) > 1 else "")
        return f"{s}{m}e{'-' if e10 < 0 else '+'}{abs(e10):02d}"
    if e10 < 0:
        return f"{s}0.{'0' * (-e10 - 1)}{ds}"
    if len(ds) <= e10 + 1:
        return s + ds + "0" * (e10 + 1 - len(ds))
    return f"{s}{ds[:e10 + 1]}.{ds[e10 + 1:]}"


def go_value(v) -> str:
    """Go's ``%v`` of a decoded JSON value, without recursion (bodies may nest deeply)."""
    out, todo = [], [v]
    while todo:
        v = todo.pop()
        if isinstance(v, tuple):                   # text that is written as it is
            out.append(v[0])
        elif v is None:
            out.append("<nil>")
        elif isinstance(v, bool):
            out.append("true" if v else "false")
        elif isinstance(v, (int, float)):
            out.append(go_float(float(v)))
        elif isinstance(v, str):
            out.append(v)
        elif isinstance(v, list):
            todo.append(("]",))
            for i in range(len(v) - 1, -1, -1):
                todo += [v[i], (" " if i else "[",)]
            if not v:
                todo.append(("[",))
        elif isinstance(v, dict):
            todo.append(("]",))
            keys = sorted(v)
            for i in range(len(keys) - 1, -1, -1):
                todo += [v[keys[i]], (f"{' ' if i else 'map['}{keys[i]}:",)]
            if not keys:
                todo.append(("map[",))
        else:
            out.append(str(v))
    return "".join(out)


_LONE = re.compile("[\ud800-\udfff]")


def _whole(pairs: list) -> dict:
    """An object whose keys and strings have U+FFFD for lone surrogates (pairs are decoded already)."""
    return {_LONE.sub("\ufffd", k): v for k, v in pairs}


def _number(s: str) -> float:
    f = float(s)
    if math.isinf(f):
        raise ValueError("number out of range")
    return f


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def render_body(body: str | None) -> tuple[str | None, str | None]:
    """(text, error): decode the first JSON value of the body as a map, render it."""
    if body is None:
        return None, "empty body"
    try:
        dec = json.JSONDecoder(parse_float=_number, parse_int=_number, parse_constant=_no_constant, object_pairs_hook=_whole)
        v, _ = dec.raw_decode(body.lstrip(" \t\r\n"))
        if v is None:
            return "map[]", None
        if not isinstance(v, dict):
            return None, "JSON body is not an object"
        return _LONE.sub("\ufffd", go_value(v)), None
    except Exception as ex:  # noqa: BLE001 - one body never fails the job
        return None, f"invalid JSON: {type(ex).__name__}"


_OUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


@F.arrow_udf(_OUT)
def _go_map_text(body: pa.Array) -> pa.Array:
    return per_row(render_body, body, ("text", "error"))


# Nondeterministic only for the optimizer (see web.html_extract).
go_map_text = _go_map_text.asNondeterministic()


def parse_api(landed: DataFrame, now: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Landed ``(source_id, url, body, fetched_at)`` -> Content rows + ``error`` (NULL when ok);
    columns ``keep`` are carried along."""
    now = now if now is not None else F.current_timestamp()
    x = spread(landed).withColumn("_r", go_map_text(F.col("body")))
    url = go_string(F.col("url"))
    return x.select(
        "source_id",
        F.concat(F.lit(API_TITLE_PREFIX), url).alias("title"),
        go_string(F.col("_r.text")).alias("text"),
        url.alias("source"),
        url.alias("url"),
        now.alias("published_at"),
        F.col("_r.error").alias("error"), *keep,
    )
