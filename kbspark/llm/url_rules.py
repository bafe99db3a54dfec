"""URL filters: a sort-merge range join of urls with nested host and path rules.

Canonical keys: host labels reversed, each followed by U+0001, then U+0000 and the path
(``http://a.b.org/x`` -> ``org\\x01b\\x01a\\x01\\x00/x``). A rule (host, path) then covers two
intervals of keys, each the set of keys with a prefix: ``host-key + \\x00 + path`` (the host
itself) and ``host-key`` (its subdomains, where the path is looked up as well). Prefix intervals
nest or are disjoint, so one sorted sweep with a stack finds every active rule of a url.

Scale: urls are dealt to key ranges cut at the quantiles of a bounded sample of (key, random
salt) pairs. The salt cuts inside a hot host or even one hot url, since a url needs no other
url, only the rules around it. A rule goes to each range that its intervals touch. The sample
only balances the work; results do not depend on it. One shuffle, no broadcast, no join back;
a task streams its sorted rows and holds only the open rules.

Defined cases: null urls and urls without ``://`` have empty host and path and match no rule;
rules with a null or empty host are ignored, a null path counts as empty; of equal (host, path)
rules the smallest action wins (``allow``); the longest rule (host plus path characters) wins,
ties go to the longer host; repeated url rows and null ids give one result row each; empty
tables give empty results (no rules: the default verdict). Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Sampled keys per range, for cutting the ranges (bounded: ranges x this many short strings).
SAMPLE_PER_RANGE = 40


def url_host(url: Column) -> Column:
    """Text between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01"))


def _cuts(keys: DataFrame, ranges: int) -> list[tuple[str, float]]:
    """Sorted (key, salt) cuts between ``ranges`` ranges, from a bounded sample of the rows."""
    n = keys.count()
    want = ranges * SAMPLE_PER_RANGE
    sample = keys.sample(min(1.0, want / n), seed=17) if n else keys
    rows = sorted((r.key, r.salt) for r in sample.select("key", "salt").limit(4 * want).collect())
    step = len(rows) / ranges
    return sorted({rows[int(i * step)] for i in range(1, ranges)}) if rows else []


def apply_url_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id",
                    url_col: str = "url", ranges: int | None = None) -> DataFrame:
    """Judge every url by the longest fitting rule.

    ``rules`` has columns host, path, action. Returns ``id_col``, host, path, rule (host + path of
    the winner or null), verdict (its action, else ``default``), matched (whether a rule fits).
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ids travel as text: beside the rules' nulls, pandas would turn integers into floats.
    urls = pages.select(F.col(id_col).cast("long").cast("string").alias("id"), url_host(F.col(url_col)).alias("host"),
                        url_path(F.col(url_col)).alias("path"))
    urls = urls.withColumn("key", F.concat(host_key(F.col("host")), F.lit("\x00"), F.col("path"))) \
               .withColumn("salt", F.rand(11))
    cuts = _cuts(urls, ranges)
    starts = [k for k, _ in cuts]

    def deal(batches):
        for b in batches:
            yield b.assign(part=[bisect_right(cuts, ks) for ks in zip(b.key, b.salt)]).drop(columns="salt")

    def deal_rules(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                # the host itself, at the path; and its subdomains, at any path
                for kind, prefix in ((1, f"{r.key}\x00{r.path}"), (0, r.key)):
                    first = bisect_left(starts, prefix)
                    last = first
                    while last < len(starts) and (starts[last] < prefix or starts[last].startswith(prefix)):
                        last += 1
                    out += [(None, r.host, r.path, prefix, kind, r.action, p) for p in range(first, last + 1)]
            yield pd.DataFrame(out, columns=["id", "host", "path", "key", "kind", "action", "part"])

    clean = (rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("host"),
                          F.coalesce("path", F.lit("")).alias("path"), "action")
             .filter("host <> ''").groupBy("host", "path").agg(F.min("action").alias("action"))
             .withColumn("key", host_key(F.col("host"))))
    schema = "id string, host string, path string, key string, kind int, action string, part int"
    placed = clean.mapInPandas(deal_rules, schema).unionByName(
        urls.withColumn("kind", F.lit(2)).withColumn("action", F.lit(None).cast("string")).mapInPandas(deal, schema))
    swept = placed.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("key", "kind")
    out = swept.mapInPandas(_sweep, "id string, host string, path string, rule string, action string")
    return out.select(F.col("id").cast("long").alias(id_col), "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"),
                      F.col("rule").isNotNull().alias("matched"))


def _sweep(batches):
    """Sorted rows in, judged urls out. ``stack`` holds the open intervals, outermost first, as
    (prefix, host, {path: action}, path lengths); equal intervals share one entry."""
    stack: list[tuple[str, str, dict, set]] = []
    for b in batches:
        out = []
        for id_, host, path, key, kind, action in zip(b.id, b.host, b.path, b.key, b.kind, b.action):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind != 2:
                if not stack or stack[-1][0] != key or stack[-1][1] != host:
                    stack.append((key, host, {}, set()))
                stack[-1][2][path] = action
                stack[-1][3].add(len(path))
                continue
            best = None
            for _, rule_host, paths, lengths in stack:
                if host != rule_host and not host.endswith("." + rule_host):
                    continue
                for n in lengths:
                    if (p := path[:n]) in paths and len(p) == n:
                        best = max(best or (-1,), (len(rule_host) + n, len(rule_host), rule_host + p, paths[p]))
            out.append((id_, host, path, *(best[2:] if best else (None, None))))
        yield pd.DataFrame(out, columns=["id", "host", "path", "rule", "action"], dtype=object)


#: The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

ORACLE = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(rhost, rpath, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                   ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT page_id, host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
         max_by(action, length(rhost || rpath)) AS action
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict, rule IS NOT NULL AS matched FROM best
"""
