"""LM scoring: stupid-backoff bigram scores, computed relationally over n-gram count tables.

Every word and bigram of the corpus is counted; there is no vocabulary limit. A token w after v scores
log10 of

* count'(v w) / count(v) if the bigram also occurs in other documents (count' leaves out the
  scored document's own occurrences), else
* alpha * (count(w) + 1) / (tokens + word types), the backed-off unigram.

The first word follows a start symbol counted once per document with words. Scores are summed in whole
millionths, so sums do not depend on their order.

Relations: the count table (v, w, n, docs), v null for words, is a partial aggregate partitioned by hash.
From it follows a score table by 64-bit n-gram key: of words the backed-off score, of bigrams of two or more
documents the count, the count of v and the backed-off score of w. Each document is exploded to its distinct
n-grams with their own counts, these rows are joined to the score table by key and summed per
document: words add their backed-off score, found bigrams the difference to it. So a bigram that
no other document has needs no row of the table.

Scale: both tables grow with the corpus and stay partitioned by hash. N-grams are counted, and later scored, in
``PARTS`` parts by key, one after the other, which bounds disk: the texts are read once a part, and the shuffle of one is
deleted before the next. The parts of a document meet by a hash of its id and text; rows that share both have equal
scores, so it does not matter in what order a part reads them. A document sends one row per distinct
n-gram, however often it repeats it. N-grams that have more than one in ``hot_rows`` of these rows (so fewer than
``hot_rows`` n-grams, 32 bytes each) are broadcast and scored where the documents are read; only the others enter the
shuffle, and none of these is hot. Rows of bigrams that no other document
has are left out by a Bloom filter while the other keys are at most ``FILTER_KEYS`` (it has 16 MB at most), and by the
join beyond that. Bigrams meet the counts of their words by a broadcast of
at most ``BROADCAST_WORDS`` counted words, else by a shuffle that AQE can split. The driver sees totals and the hot rows.

Defined cases: null, empty and blank texts have no words, score 0 and a null mean; repeated rows are
documents of their own; ids are only carried along, null ids too; an empty table gives an empty
result; extra columns are ignored. Rows are numbered inside a part only, but every part reads the input anew, so that should be a stored table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.components import small
from kbspark.llm.words import seeds, slices, word_hashes
from kbspark.session import delete_folder, scratch_dir

ALPHA = 0.4
HOT_ROWS = 1_000_000
BROADCAST_WORDS = 1_000_000
#: Keys of the other n-grams are broadcast as a filter (two of 16 bits a key) up to this many; beyond, all rows are sent.
FILTER_KEYS = 4_000_000
#: Parts of the n-grams, by key, that are shuffled one after the other.
PARTS = 2
START = seeds(1, 9)[0]
#: The shuffle of a stored table is not needed again; AQE may join by hash where no partition of the smaller side has more
#: than this (and the advisory size is not larger), which saves sorting the exploded rows.
_STORING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "32m"}
_KEY = "v ^ (shiftleft(w, 1) | shiftrightunsigned(w, 63))"
_PART = "shiftrightunsigned(key, 48) % {parts} = {part}"


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous words, words, offsets of each text) as hashes."""
    w, off = word_hashes(column)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[off[:-1][np.diff(off) > 0]] = START
    return v, w, off


def _key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Bigram keys; the same as ``_KEY``."""
    return v ^ (w << np.uint64(1) | w >> np.uint64(63))


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = False
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _own(key: np.ndarray, doc: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(a position, occurrences) of each distinct (key, document) of the part, by key; ``doc`` does not fall."""
    here = np.flatnonzero((key >> np.uint64(48)) % np.uint64(parts) == part)                     # the same as ``_PART``
    order = here[np.argsort(key[here], kind="stable")]
    start = _runs(key[order], doc[order])
    return order[start], np.diff(np.append(start, len(order)))


def _count_table(docs: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """(v, w, n, docs): occurrences and documents of every word (v null; the start symbol too, in part 0) and of the bigrams
    of two or more documents, whose keys lie in the part. All bigrams are counted; one that a single document has is found by none."""
    def count(batches):
        for batch in batches:
            for b in slices(batch, 1):
                v, w, off = _grams(b.column(1))
                doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
                for order, key in ((1, w), (2, _key(v, w))):
                    at, own = _own(key, doc, part, parts)
                    start = _runs(key[at])
                    n = np.add.reduceat(own, start) if len(start) else own
                    first = at[start]
                    yield pa.record_batch({"v": pa.array(v[first].view(np.int64), mask=np.full(len(first), order == 1)),
                                           "w": pa.array(w[first].view(np.int64)), "n": pa.array(n.astype(np.int64)),
                                           "docs": pa.array(np.diff(np.append(start, len(at))).astype(np.int64))})
                if part:
                    continue
                yield pa.record_batch({"v": pa.array([None], pa.int64()), "w": pa.array([START]).view(pa.int64()),
                                       "n": pa.array([int((np.diff(off) > 0).sum())], pa.int64()), "docs": pa.array([0], pa.int64())})

    counted = docs.mapInArrow(count, "v long, w long, n long, docs long").groupBy("v", "w").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return counted.filter("v is null or docs > 1")


def _score_table(counts: DataFrame) -> DataFrame:
    """(key, n, before, back, docs): of words n and before are null."""
    start = int(START.view(np.int64))
    words = counts.filter("v is null")
    total = words.filter(F.col("w") != start).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).first()
    back = F.rint(1e6 * F.log10(ALPHA * (F.col("n") + 1) / F.lit(max(1, total.tokens + total.types)))).cast("long")
    words = words.select("w", "n", back.alias("back"), "docs")
    known = small(words, BROADCAST_WORDS)
    one = words.filter(F.col("w") != start).select(F.col("w").alias("key"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("before"),
                                                   "back", "docs")
    two = (counts.filter("v is not null")
           .join(known.select(F.col("w").alias("v"), F.col("n").alias("before")), "v").join(known.select("w", "back"), "w")
           .select(F.expr(_KEY).alias("key"), "n", "before", "back", "docs"))
    return one.unionByName(two)


def _hot_scores(n, before, back, own) -> tuple[np.ndarray, np.ndarray]:
    """(millionths, found tokens) of rows of the score table; n is 0 for words."""
    found = n > own
    e6 = np.where(n == 0, own * back, 0)
    e6[found] = own[found] * (np.rint(1e6 * np.log10((n[found] - own[found]) / before[found])).astype(np.int64) - back[found])
    return e6, np.where(found, own, 0)


def _filter(cold: DataFrame) -> np.ndarray | None:
    """A Bloom filter of the keys, if there are at most ``FILTER_KEYS``."""
    n = cold.count()
    if n > FILTER_KEYS:
        return None
    bits = np.zeros(1 << max(10, (16 * n).bit_length()), bool)
    for at in _bits(cold.select("key").toArrow().column("key").to_numpy(), len(bits)):
        bits[at] = True
    return np.packbits(bits, bitorder="little")


def _bits(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    key = key.view(np.uint64)
    return (key & np.uint64(size - 1)).astype(np.int64), (key >> np.uint64(32) & np.uint64(size - 1)).astype(np.int64)


def _maybe(bits: np.ndarray | None, key: np.ndarray) -> np.ndarray:
    """Whether the keys may be in the filter."""
    if bits is None:
        return np.ones(len(key), bool)
    a, b = _bits(key, 8 * len(bits))
    return (bits[a >> 3] >> (a & 7).astype(np.uint8) & bits[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)


def score_documents(docs: DataFrame, hot_rows: int = HOT_ROWS, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS) -> DataFrame:
    """(doc_id, n_words, n_backoff, logprob_e6, mean_logprob) of every whole text, by counts over all texts."""
    spark = docs.sparkSession
    d = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    base = scratch_dir(spark, "backoff")

    def stored(df: DataFrame, name: str) -> DataFrame:
        before = {k: spark.conf.get(k, None) for k in _STORING}
        try:
            for k, value in _STORING.items():
                spark.conf.set(k, value)
            df.write.parquet(f"{base}/{name}")
        finally:
            for k, value in before.items():
                spark.conf.unset(k) if value is None else spark.conf.set(k, value)
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    counts = [stored(_count_table(d, i, parts), f"counts/{i}") for i in range(parts)]
    counts = reduce(DataFrame.unionByName, counts)
    limit = (counts.agg(F.sum("docs")).first()[0] or 0) // hot_rows        # fewer than hot_rows n-grams have more documents
    table = stored(_score_table(counts), "scores")
    delete_folder(spark, f"{base}/counts")
    hot = table.filter(F.col("docs") > limit).fillna(0, ["n", "before"]).orderBy("key").toArrow()
    hot = spark.sparkContext.broadcast([hot.column(c).to_numpy() for c in ("key", "n", "before", "back")])
    cold = table.filter(F.col("docs") <= limit).select("key", "n", "before", "back")
    known = spark.sparkContext.broadcast(_filter(cold))
    out, *more = [stored(_part_scores(d, cold, hot, known, i, parts), f"sums/{i}") for i in range(parts)]
    delete_folder(spark, f"{base}/scores")
    for sums in more:
        of_text = sums.groupBy("same").agg(F.max("found").alias("found_"), F.max("logprob_e6").alias("e6_"))      # equal for equal rows
        out = out.join(of_text, "same").select("same", "doc_id", "n_words", (F.col("found") + F.col("found_")).alias("found"),
                                               (F.col("logprob_e6") + F.col("e6_")).alias("logprob_e6"))
    out = out.select("doc_id", "n_words", (F.col("n_words") - F.col("found")).alias("n_backoff"), "logprob_e6")
    return out.withColumn("mean_logprob", F.when(F.col("n_words") > 0, F.col("logprob_e6") / F.lit(1e6) / F.col("n_words")))


def _part_scores(d: DataFrame, cold: DataFrame, hot, known, part: int, parts: int) -> DataFrame:
    """(same, doc_id, n_words, found, logprob_e6) of every document: the sums over its n-grams of the part; ``same`` is the hash of id and text."""
    def explode(batches):
        from pyspark import TaskContext
        key_, *values = hot.value
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for b in slices(batch, 1):
                v, w, off = _grams(b.column(1))
                size = np.diff(off)
                doc = np.repeat(np.arange(len(size)), size)
                e6, found = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
                for k in (w, _key(v, w)):
                    at, own = _own(k, doc, part, parts)
                    key, of = k[at].view(np.int64), doc[at]
                    near = np.minimum(np.searchsorted(key_, key), max(0, len(key_) - 1))
                    is_hot = key_[near] == key if len(key_) else np.zeros(len(key), bool)
                    s, f = _hot_scores(*(x[near[is_hot]] for x in values), own[is_hot])
                    np.add.at(e6, of[is_hot], s)
                    np.add.at(found, of[is_hot], f)
                    sent = np.flatnonzero(~is_hot & _maybe(known.value, key))         # the others are bigrams of one document
                    sent = sent[np.argsort(of[sent], kind="stable")]                  # by document: the shuffle compresses better
                    yield _rows(number + of[sent], key[sent], own[sent])
                numbers = number + np.arange(len(size))
                yield _rows(numbers, seeds(1)[0].view(np.int64) ^ numbers << 20, size, b.column(0), e6, found, b.column(2))      # keys that spread the documents
                number += len(size)

    d = d.selectExpr("doc_id", "text", "xxhash64(doc_id, text) same")
    rows = d.mapInArrow(explode, "number long, key long, own long, head boolean, doc_id long, e6 long, found long, same long")
    others = F.col("n") - F.col("own")
    gain = F.rint(1e6 * F.log10(others / F.col("before"))).cast("long") - F.col("back")
    is_found = F.col("n").isNotNull() & (others > 0)
    joined = rows.join(cold.filter(_PART.format(part=part, parts=parts)), "key", "left").filter(
        F.col("head") | (F.col("back").isNotNull() & (F.col("n").isNull() | (others > 0))))
    out = joined.groupBy("number").agg(
        F.max("same").alias("same"), F.max("doc_id").alias("doc_id"), F.sum(F.when(F.col("head"), F.col("own")).otherwise(0)).alias("n_words"),
        F.sum(F.when(F.col("head"), F.col("found")).when(is_found, F.col("own")).otherwise(0)).alias("found"),
        F.sum(F.when(F.col("head"), F.col("e6")).otherwise(F.col("own") * F.when(is_found, gain).otherwise(F.col("back")))).alias("logprob_e6"))
    return out.drop("number")


def _rows(number: np.ndarray, key: np.ndarray, own: np.ndarray, ids=None, e6=None, found=None, same=None) -> pa.RecordBatch:
    """Exploded n-grams; with ids the rows that stand for the documents themselves."""
    n = len(number)
    rest = [pa.nulls(n, pa.int64())] * 4 if ids is None else [ids, pa.array(e6), pa.array(found), same]
    return pa.record_batch({"number": pa.array(number), "key": pa.array(key), "own": pa.array(own.astype(np.int64)),
                            "head": pa.array(np.full(n, ids is not None)), "doc_id": rest[0], "e6": rest[1], "found": rest[2], "same": rest[3]})


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
c AS (SELECT w, count(*) AS n FROM t GROUP BY w),
tot AS (SELECT (SELECT count(*) FROM t) + (SELECT count(*) FROM c) AS all_words, (SELECT count(DISTINCT doc_id) FROM t) AS docs),
x AS (SELECT t.doc_id, t.i, t.w, c.n AS cw, lag(t.w) OVER (PARTITION BY t.doc_id ORDER BY t.i) AS p,
             lag(c.n) OVER (PARTITION BY t.doc_id ORDER BY t.i) AS cp, tot.all_words, tot.docs
      FROM t JOIN c ON c.w = t.w CROSS JOIN tot),
y AS (SELECT doc_id, w, cw, all_words, CASE WHEN i = 1 THEN ' ' ELSE p END AS p, CASE WHEN i = 1 THEN docs ELSE cp END AS cp FROM x),
o AS (SELECT doc_id, p, w, count(*) AS own FROM y GROUP BY doc_id, p, w),
b AS (SELECT *, sum(own) OVER (PARTITION BY p, w) - own AS others FROM o),
s AS (SELECT y.doc_id, b.others > 0 AS found,
             CASE WHEN b.others > 0 THEN CAST(round(1e6 * log10(b.others / y.cp)) AS BIGINT)
                  ELSE CAST(round(1e6 * log10(0.4 * (y.cw + 1) / y.all_words)) AS BIGINT) END AS e6
      FROM y JOIN b ON b.doc_id = y.doc_id AND b.p = y.p AND b.w = y.w),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (NOT found) AS n_backoff, sum(e6) AS e6 FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff, CAST(coalesce(e6, 0) AS BIGINT) AS logprob_e6,
       CAST(e6 AS DOUBLE) / 1e6 / n_words AS mean_logprob
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
