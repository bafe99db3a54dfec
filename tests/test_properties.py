"""Property tests (hypothesis) of the per-row helpers and the exact top-k selection."""

import json
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kbspark.operators.retrieve import _NO_MATCH, _topk_block
from kbspark.sources.api import go_float, render_body
from kbspark.sources.web import extract_page


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 30), st.integers(1, 5), st.integers(1, 8), st.data())
def test_topk_block_matches_brute_force(n, q, k, data):
    keys = np.array(data.draw(st.lists(st.lists(st.one_of(st.integers(0, 4), st.just(None)), min_size=q, max_size=q),
                                       min_size=n, max_size=n)), dtype=object)
    keys = np.where(keys == None, _NO_MATCH, keys).astype(np.int64)  # noqa: E711
    ri, ci = _topk_block(keys, k)
    for j in range(q):
        want = sorted((-keys[r, j], r) for r in range(n) if keys[r, j] != _NO_MATCH)[:k]
        got = sorted((-keys[r, j], r) for r, c in zip(ri, ci) if c == j)
        assert [r for _, r in want] == [r for _, r in got]


@settings(max_examples=300, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_go_float_round_trips(x):
    s = go_float(x)
    assert float(s) == x
    m = s.lstrip("-")
    if "e" in m:
        mant, exp = m.split("e")
        e = int(exp)
        assert e < -4 or e >= 6
        assert len(exp.lstrip("+-")) >= 2
    else:
        assert x == 0 or -4 <= math.floor(math.log10(abs(x))) < 6 or abs(x) < 1e-4


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-10**6, 10**6) | st.floats(allow_nan=False, allow_infinity=False)
    | st.text(max_size=8),
    lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=5), c, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(max_size=6), json_values, max_size=5))
def test_render_objects_never_reject(obj):
    text, err = render_body(json.dumps(obj))
    assert err is None and text.startswith("map[") and text.endswith("]")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("<>/ ='&;abcdeimnoprstlx#!-" + '"')), max_size=200))
def test_html_parser_never_raises(html):
    title, text, err = extract_page(html)
    assert isinstance(title, str) and isinstance(text, str)
