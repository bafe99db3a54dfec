"""Plan lint over every registered query (sf0.001): no cartesian products or nested-loop
joins, and parquet scans read only the columns they need."""

import re

import pytest

SF = "/root/testdata/sf0.001"


def _plans(spark):
    import __spark_entry__ as E
    out = {}
    for name, fn in E.queries().items():
        df = fn(spark, SF)
        out[name] = df._jdf.queryExecution().executedPlan().toString()
    return out


@pytest.fixture(scope="module")
def plans(spark):
    return _plans(spark)


def test_no_cartesian_or_nested_loop(plans):
    bad = {n: p for n, p in plans.items() if "CartesianProduct" in p or "NestedLoopJoin" in p}
    assert not bad, sorted(bad)


def _read_schemas(plan: str) -> list[str]:
    return re.findall(r"ReadSchema: (struct<[^\n]*?>)(?:,|$| )", plan, flags=re.M) or \
        re.findall(r"ReadSchema: (struct<.*?>)", plan)


def test_scans_are_pruned(plans):
    # Projections of a few columns must not read the wide columns of the table.
    r = _read_schemas(plans["retention_survivors"])
    assert r and all("props" not in x and "value" not in x for x in r), r
    v = _read_schemas(plans["similar_documents_batch"])
    assert v and all("label" not in x for x in v), v
    c = _read_schemas(plans["count_documents"])
    assert c and all("text" not in x for x in c), c
