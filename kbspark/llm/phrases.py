"""Phrase collocations: multikey three-way quicksort of suffix pointers, after routing by leading words.

Texts are lower-cased (A-Z only), cut into pieces at punctuation and line ends, and the pieces into words.
Everything is counted per language. A *candidate* is a phrase of 2 to ``max_words`` words that occurs at
least ``min_count`` times within pieces (overlaps included).

1. Words are counted in the tasks that read the texts (bounded tables, flushed) and summed: the vocabulary.
   A phrase is never more frequent than its words, so rarer words end a suffix as a piece border does.
2. Every word that begins a suffix of two frequent words sends ``max_words`` words on, to the task its
   *leading words* choose. These are the first two; while all of the leading words are *hot* (each more than
   half a task's share of all words) one more is taken, so a hot pair is dealt out by what follows it.
3. Each task sorts its suffix pointers by multikey three-way quicksort: one partition step splits a range by
   the word at the current depth; the *equal* part's size is the count of the phrase that ends there, and it is
   sorted on from the next depth, down to ``max_words``. Ranges below ``min_count`` are abandoned, smaller
   and larger parts included. Only above the routed depth, where a count is a part of the whole, are all
   kept; these parts are summed by phrase.
4. Scores: a candidate's cuts are joined to the counts of both parts; the lowest score counts. Arithmetic is
   exact (decimals of 38 digits). Candidates inside a longer one that is (nearly) as frequent are dropped.

Words are named by 60 bits of a digest of (language, word); should two words of the corpus share a name,
which is checked over the whole vocabulary, another digest is drawn. The list of frequent words is broadcast if
its measured size is within ``dictionary_bytes`` (then suffixes are 4 bytes a word and end at rare words);
beyond it, suffixes hold the names themselves, and rare words are abandoned by the sort alone. Both give the
same rows.

Scale: two scans of the texts; per word at most one suffix of ``max_words`` names crosses the shuffle, in blocks
by route. The number of routes follows the corpus (``task_suffixes`` each), so a sort's memory is bounded;
repeated hot suffixes are counted before they are sent. The hot list has at most twice as many words as there
are shuffle partitions. Everything after the sort is joins and partial aggregates over the candidates.

Defined cases: null texts are empty; a null language is ``und`` (and counts with the rows that say ``und``);
empty texts and pieces give nothing; very long texts are processed whole; ties go to the more frequent, then to
the phrase first in UTF-8 byte order; repeated rows count as rows of their own; ids are not read; an empty
table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.words import mix, seeds, slices
from kbspark.session import scratch_dir

NO_LANG = "und"
_CUTS = b".,;:!?\n\x0b\x0c\r"
_CUT = b"\xff"                                     # occurs in no UTF-8 text
_TABLE = bytes.maketrans(bytes(range(0x41, 0x5B)) + _CUTS, bytes(range(0x61, 0x7B)) + _CUT * len(_CUTS))
_FLUSH_WORDS = 200_000


def tokens(text: bytes) -> list[bytes]:
    """The words in order, with ``_CUT`` between pieces."""
    return text.translate(_TABLE).replace(_CUT, b" \xff ").split()


def name_of(lang: bytes, word: bytes, seed: int) -> int:
    """60 bits that stand for a word of a language; never 0."""
    return int(hashlib.md5(b"%d\x00%s\x00%s" % (seed, lang, word)).hexdigest()[:15], 16) or 1


def _texts(batches):
    for batch in batches:
        for part in slices(batch, 1):
            yield [((lang.as_buffer().to_pybytes() if lang.is_valid else NO_LANG.encode()), tokens(t.as_buffer().to_pybytes() if t.is_valid else b""))
                   for lang, t in zip(part.column(0), part.column(1))]


def _vocabulary(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, name, f: counted per task, then summed."""
    def count(batches):
        tables: dict[bytes, Counter] = {}

        def flush():
            for lang, table in tables.items():
                words = list(table)
                yield pa.record_batch([pa.array([lang] * len(words), pa.binary()).cast(pa.string(), safe=False), pa.array(words, pa.binary()).cast(pa.string(), safe=False),
                                       pa.array([name_of(lang, w, seed) for w in words], pa.int64()), pa.array(table.values(), pa.int64())],
                                      ["lang", "word", "name", "f"])
            tables.clear()

        for part in _texts(batches):
            for lang, words in part:
                tables.setdefault(lang, Counter()).update(words)
            for table in tables.values():
                table.pop(_CUT, None)
            if sum(map(len, tables.values())) >= _FLUSH_WORDS:
                yield from flush()
        yield from flush()

    return (docs.mapInArrow(count, "lang string, word string, name long, f long")
            .groupBy("lang", "word", "name").agg(F.sum("f").alias("f")))


def quicksort_counts(suffixes: np.ndarray, weights: np.ndarray, complete: int, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the phrases that begin the suffixes, by multikey three-way quicksort of pointers to them.

    ``suffixes``: a row per suffix, 0 after its end. All suffixes that share their first ``complete``
    words are here, so a phrase of at least that many words is counted in full and abandoned below
    ``min_count``; shorter ones of two words or more are counted in part and never abandoned.
    Returns (row of an example, words, count) of each phrase.
    """
    depth_end = suffixes.shape[1]
    columns = [np.ascontiguousarray(suffixes[:, k]) for k in range(depth_end)]
    pointers = np.arange(len(suffixes))
    out: list[tuple[int, int, int]] = []
    # A range is abandoned if no complete phrase in it can be frequent and none of its counts is a part.
    todo = [(pointers, weights, int(weights.sum()), 0)]
    while todo:
        at, weight, _, depth = todo.pop()
        keys = columns[depth][at]
        pivot = keys[len(keys) // 2]
        least = min_count if complete <= 2 or depth >= complete - 1 else 1
        for part in (keys < pivot, keys > pivot):
            w = weight[part]
            if (total := int(w.sum())) >= least:
                todo.append((at[part], w, total, depth))
        if pivot:
            part = keys == pivot
            w = weight[part]
            if (total := int(w.sum())) >= least:
                rows = at[part]
                if depth:
                    out.append((int(rows[0]), depth + 1, total))
                if depth + 1 < depth_end:
                    todo.append((rows, w, total, depth + 1))
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def _routes(docs: DataFrame, lists, hot, seed: int, max_words: int, routes: int, flush: int, dtype) -> DataFrame:
    """(route, depth, block, weights): suffixes in blocks by route; depth is the number of leading words."""
    def send(batches):
        tables, names, hot_names = (lists.value if lists else None), {}, hot.value
        held: list[np.ndarray] = []
        mult = seeds(max_words, 300) | np.uint64(1)
        if tables is not None:
            words, langs, order = tables
            known: dict[bytes, dict[bytes, int]] = {}
            for lang, word, code in zip(langs.to_pylist(), words.to_pylist(), range(1, len(words) + 1)):
                known.setdefault(lang, {})[word] = code
            hot_codes = np.flatnonzero(np.isin(order, hot_names)).astype(dtype) + 1
        else:
            hot_codes = hot_names.astype(dtype)

        def coded(lang: bytes, words: list[bytes]) -> np.ndarray:
            if tables is not None:
                return np.fromiter(map(known.get(lang, {}).get, words, repeat(0)), dtype, len(words))
            table = names.setdefault(lang, {_CUT: 0})
            if len(table) > _FLUSH_WORDS:
                table.clear()
                table[_CUT] = 0
            for w in set(words):
                if w not in table:
                    table[w] = name_of(lang, w, seed)
            return np.fromiter(map(table.__getitem__, words), dtype, len(words))

        def cut(codes: np.ndarray) -> np.ndarray:
            n = len(codes) - max_words
            at = np.flatnonzero((codes[:n] != 0) & (codes[1:n + 1] != 0))
            w = np.empty((len(at), max_words), dtype)
            w[:, 0], w[:, 1] = codes[at], codes[at + 1]
            for k in range(2, max_words):
                w[:, k] = np.where(w[:, k - 1] != 0, codes[at + k], 0)
            return w

        def emit():
            w = np.concatenate(held) if held else np.zeros((0, max_words), dtype)
            held.clear()
            if not len(w):
                return
            lead = np.full(len(w), 2)              # leading words: one more while all of them are hot
            hot_so_far = np.ones(len(w), bool)
            for k in range(max_words - 1):
                hot_so_far &= np.isin(w[:, k], hot_codes)
                if k:
                    lead[hot_so_far] = k + 2
            plain, repeated = lead == 2, np.flatnonzero(lead > 2)
            weights = np.ones(len(w), np.int64)
            if len(repeated):                      # hot suffixes are counted before they are sent
                some, first, n = np.unique(np.ascontiguousarray(w[repeated]).view(f"V{w.itemsize * max_words}").ravel(), return_index=True, return_counts=True)
                rows = np.concatenate((np.flatnonzero(plain), repeated[first]))
                weights = np.concatenate((weights[plain], n))
                w, lead = w[rows], lead[rows]
            with np.errstate(over="ignore"):
                h = np.zeros(len(w), np.uint64)
                for k in range(max_words):
                    h = np.where(lead > k, mix(h + w[:, k].astype(np.uint64) * mult[k]), h)
            route = (h % np.uint64(routes)).astype(np.int64) * (max_words + 1) + lead
            order_ = np.argsort(route, kind="stable")
            route, w, weights = route[order_], w[order_], weights[order_]
            edge = np.flatnonzero(np.concatenate(([True], route[1:] != route[:-1], [True])))
            size = 4096
            for a in range(0, len(edge) - 1, size):
                span = [(int(x), int(y)) for x, y in zip(edge[a:a + size], edge[a + 1:a + size + 1])]
                heads = [int(route[x]) for x, _ in span]
                yield pa.record_batch([
                    pa.array([r // (max_words + 1) for r in heads], pa.int64()), pa.array([r % (max_words + 1) for r in heads], pa.int32()),
                    pa.array([w[x:y].tobytes() for x, y in span], pa.binary()),
                    pa.array([None if r % (max_words + 1) == 2 else weights[x:y].tobytes() for r, (x, y) in zip(heads, span)], pa.binary()),
                ], ["route", "depth", "block", "weights"])

        gap = np.zeros(1, dtype)
        total = 0
        for part in _texts(batches):
            codes = [x for lang, words in part for x in (coded(lang, words), gap)]
            held.append(cut(np.concatenate([*codes, np.zeros(max_words, dtype)])))
            total += len(held[-1])
            if total >= flush:
                yield from emit()
                total = 0
        yield from emit()

    return docs.mapInArrow(send, "route long, depth int, block binary, weights binary")


def phrase_counts(docs: DataFrame, vocabulary: DataFrame, lists, hot, seed: int, max_words: int, min_count: int, routes: int, flush: int) -> DataFrame:
    """(phrase array<long>, f) of all phrases of 2 to ``max_words`` words that occur ``min_count`` times."""
    dtype = np.int32 if lists else np.int64

    def sort(block: pa.Table) -> pa.Table:
        names = lists.value[2] if lists else None
        w = np.frombuffer(b"".join(block.column("block").to_pylist()), dtype).reshape(-1, max_words)
        depth = block.column("depth")[0].as_py()
        weights = np.ones(len(w), np.int64) if depth == 2 else np.frombuffer(b"".join(block.column("weights").to_pylist()), np.int64)
        row, words, f = quicksort_counts(w, weights, depth, min_count)
        flat = w[row][np.arange(max_words) < words[:, None]]
        flat = names[flat - 1] if lists else flat
        offsets = np.concatenate(([0], np.cumsum(words))).astype(np.int32)
        return pa.table({"phrase": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int64), pa.int64())), "f": pa.array(f, pa.int64())})

    return (_routes(docs, lists, hot, seed, max_words, routes, flush, dtype).groupBy("route", "depth").applyInArrow(sort, "phrase array<long>, f long")
            .groupBy("phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count))


def collocations(docs: DataFrame, min_count: int = 100, max_words: int = 5, top: int = 2000, cover_percent: int = 100,
                 lang_col: str = "lang", text_col: str = "text", dictionary_bytes: int = 16 << 20, task_suffixes: int = 1 << 20,
                 flush_suffixes: int = 1 << 20) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    spark, base = docs.sparkSession, scratch_dir(docs.sparkSession, "phrases")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    d = docs.selectExpr(f"cast(`{lang_col}` as string) lang", f"cast(`{text_col}` as string) text")
    seed = 0
    while True:
        vocabulary = stored(_vocabulary(d, seed), f"words{seed}")
        if vocabulary.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            break
        seed += 1
    frequent = vocabulary.filter(F.col("f") >= min_count)
    total = vocabulary.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = frequent.filter(F.col("f") > max(min_count, total // (2 * tasks))).select("name")   # at most 2 x tasks words
    hot = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in hot.collect()], np.int64)))
    bytes_ = frequent.agg(F.coalesce(F.sum(F.octet_length("word") + F.octet_length("lang") + 16), F.lit(0))).first()[0]
    lists = None
    if bytes_ <= dictionary_bytes:
        t = frequent.select("lang", "word", "name").toArrow().sort_by("name")
        lists = spark.sparkContext.broadcast((t.column("word").cast(pa.binary()).combine_chunks(), t.column("lang").cast(pa.binary()).combine_chunks(), t.column("name").to_numpy()))

    phrases = stored(phrase_counts(d, vocabulary, lists, hot, seed, max_words, min_count, max(4 * tasks, total // task_suffixes), flush_suffixes), "phrases")
    counts = phrases.unionByName(frequent.select(F.array("name").alias("phrase"), "f"))

    longer = phrases.filter(F.size("phrase") > 2)  # a longer phrase's parts of one word less: a still shorter one lies in such a part
    inner = F.explode(F.array(F.expr("slice(phrase, 1, size(phrase) - 1)"), F.expr("slice(phrase, 2, size(phrase) - 1)")))
    cover = longer.select(inner.alias("phrase"), "f").groupBy("phrase").agg(F.max("f").alias("cover"))
    kept = (phrases.join(cover, "phrase", "left")
            .filter(F.col("cover").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("cover") < F.lit(cover_percent).cast("decimal(20,0)") * F.col("f")))
            .select("phrase", F.col("f").alias("a")))

    cuts = kept.select("phrase", "a", F.explode(F.expr("sequence(1, size(phrase) - 1)")).alias("k"))
    cuts = cuts.select("phrase", "a", "k", F.expr("slice(phrase, 1, k)").alias("head"), F.expr("slice(phrase, k + 1, size(phrase))").alias("tail"))
    cuts = (cuts.join(counts.select(F.col("phrase").alias("head"), F.col("f").alias("l")), "head")
            .join(counts.select(F.col("phrase").alias("tail"), F.col("f").alias("r")), "tail"))
    per_lang = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    spelt = frequent.select("name", "lang", "word")
    cuts = (cuts.join(spelt.select("name", "lang"), F.col("name") == F.col("phrase")[0]).join(per_lang, "lang")
            .withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")))
    best = (cuts.groupBy("phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"), F.first("lang").alias("lang"),
                                       F.first("a").alias("a"), F.first("n").alias("n")))

    letters = kept.select("phrase", F.posexplode("phrase").alias("i", "name")).join(spelt.select("name", "word"), "name")
    text = letters.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w")).select("phrase", F.array_join("w.word", " ").alias("text"))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text")
    out = best.select("phrase", "lang", "a", "n", "b.score", "b.l", "b.r").join(text, "phrase")
    return (out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
total AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
t AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f
      FROM t, range(1, 6) AS r(m) WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 100),
parts AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS ws FROM g WHERE m > 1),
cover AS (SELECT lang, phrase, max(f) AS cover FROM (
            SELECT lang, f, array_to_string(ws[1:m - 1], ' ') AS phrase FROM parts WHERE m > 2 UNION ALL
            SELECT lang, f, array_to_string(ws[2:m], ' ') AS phrase FROM parts WHERE m > 2) GROUP BY lang, phrase),
kept AS (SELECT c.* FROM parts c LEFT JOIN cover v USING (lang, phrase) WHERE v.cover IS NULL OR v.cover < c.f),
cuts AS (SELECT lang, phrase, m, f AS a, ws, unnest(range(1, m)) AS k FROM kept),
scored AS (SELECT u.lang, u.phrase, u.a, u.k, x.f AS l, y.f AS r, total.n,
                  (1000::HUGEINT * u.a * total.n) // (x.f::HUGEINT * y.f) AS score
           FROM cuts u JOIN g x ON x.lang = u.lang AND x.phrase = array_to_string(u.ws[1:u.k], ' ')
                       JOIN g y ON y.lang = u.lang AND y.phrase = array_to_string(u.ws[u.k + 1:u.m], ' ')
                       JOIN total ON total.lang = u.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
