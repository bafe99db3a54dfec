"""Periodic runs of words (a text that repeats itself back to back) by an online sparse diagonal DP.

A *run* is a stretch of words with smallest period q (words q apart are identical) and length at
least ``max(min_length, min_exponent * q)`` that no neighbouring word extends keeping period q.

In the word-by-word match matrix a run of period q lies on the diagonal of lag q. The DP walks the
words once per octave of lags: for each position its earlier occurrence gives a lag; the lag that was
active at the position before has its match length incremented, any other one ends there, and a
diagonal that ends with sufficient length emits its run at once. What makes the diagonals sparse is
what counts as an occurrence: for the lags in (g/2, g] it is the nearest earlier occurrence of the
g words that begin here, not of one word. This loses and adds nothing:

* Inside a run of smallest period q <= g the nearest earlier occurrence of g words is at lag q: one
  at a smaller lag r would give a stretch of at least q + r words both periods, hence (Fine and
  Wilf) the run the smaller period gcd(q, r). A run has at least 3q >= 1.5 g matched words, so at
  least one window of g words shows it, and its windows are consecutive.
* A diagonal that ends is maximal on both sides, and its lag is the smallest period by the same argument.

So one lag is active at a time in each octave; the work is a sort per octave, whatever the words
(a word repeated a million times costs no more than others), and octaves end as soon as no g words
occur twice. Windows are named exactly, by doubling (a pair of names of g/2 words is a name of g
words), not by hashes.

Scale: a per-document step in Arrow tasks, no shuffle. Documents are handled in slices of a few MB of
text, concatenated with separators that occur once, so that the vector work is shared by many short
documents; a longer document is a slice of its own.

Defined cases: null, empty and blank texts have no words and no runs; very long texts are processed
whole; ties in length go to the smallest start, then the smallest period; repeated rows and null ids
are rows of their own; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.words import slices

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def find_runs(codes: np.ndarray, longest: int, min_length: int = 6, min_exponent: int = 4) -> np.ndarray:
    """Runs of a word sequence as rows (start, length, period), sorted by start, then period.

    ``codes`` may hold several texts with separators that occur once between them; ``longest`` is
    the number of words of the longest one. ``min_exponent`` must be at least 3 (see above).
    """
    if min_exponent < 3:
        raise ValueError("min_exponent must be at least 3")
    names, g, found = codes.astype(np.int64), 1, []
    while g // 2 < longest // min_exponent:        # the octave's smallest lag is g // 2 + 1
        n = len(names)
        order = np.argsort(names, kind="stable")   # equal windows side by side, by position
        ranked = names[order]
        again = np.flatnonzero(ranked[1:] == ranked[:-1])
        if not len(again):
            break
        lag = np.zeros(n, np.int64)
        lag[order[again + 1]] = order[again + 1] - order[again]
        lag[(lag <= g // 2) | (lag > g)] = 0       # other octaves
        edge = np.flatnonzero(lag[1:] != lag[:-1]) + 1
        first = np.concatenate(([0], edge))        # where a diagonal becomes active, and where it ends
        last = np.concatenate((edge, [n])) - 1
        q = lag[first]
        length = last - first + g + q              # matched words and the first period
        good = (q > 0) & (length >= np.maximum(min_length, min_exponent * q))
        found.append(np.stack((first[good] - q[good], length[good], q[good]), 1))
        if n <= g:
            break
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
        names = rank[:-g] * (int(rank.max()) + 1) + rank[g:]
        g *= 2
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when of every run only the first period does."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) == 0


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text",
                  prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document: id, n_words, runs (start, length, period; by start, then period) and
    collapsed (the words that stay, joined by one space).

    ``prepare(id, words)`` may replace a document's words before runs are looked for.
    """
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                ids = part.column(0).to_pylist()
                texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"").split() for t in part.column(1)]   # exactly \x20 and \x09-\x0D
                if prepare:
                    texts = [prepare(i, w) for i, w in zip(ids, texts)]
                table: dict = {}
                codes, starts, at = [], [], 0
                for k, words in enumerate(texts):
                    starts.append(at)
                    codes += [table.setdefault(w, len(table)) for w in words]
                    codes.append(-1 - k)           # a separator of its own
                    at += len(words) + 1
                runs = find_runs(np.array(codes, np.int64), max(map(len, texts)), min_length, min_exponent)
                del codes, table
                keep = kept_words(at, runs)
                cut = np.searchsorted(runs[:, 0], np.array([*starts, at]))
                found, collapsed = [], []
                for k, words in enumerate(texts):
                    mine = runs[cut[k]:cut[k + 1]]
                    if len(mine):
                        found.append([{"start": s - starts[k], "length": n, "period": q} for s, n, q in mine.tolist()])
                        words = [words[i] for i in np.flatnonzero(keep[starts[k]:starts[k] + len(words)]).tolist()]
                    else:
                        found.append([])
                    collapsed.append(b" ".join(words))
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(w) for w in texts], pa.int64()),
                                       pa.array(found, pa.list_(_RUN)), pa.array(collapsed, pa.binary()).cast(pa.string(), safe=False)],
                                      ["id", "n_words", "runs", "collapsed"])

    return (docs.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text")
            .mapInArrow(run, _OUT).withColumnRenamed("id", id_col))


def planted_repeats(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's own rule: one document in ten, by the CRC of its id (none without an id), repeats
    itself from some word on."""
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli) and digests of all runs
    and of the collapsed text, by ``periodic_runs`` over ``planted_repeats``."""
    found = periodic_runs(docs, prepare=planted_repeats)
    r = F.transform("runs", lambda x: F.struct((-x["length"]).alias("l"), x["start"].alias("s"), x["period"].alias("p")))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n")))
    return (found.withColumn("best", F.array_min(r)).withColumn("length", -F.col("best.l"))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), "length",
                    F.col("best.p").alias("period"), F.expr("(1000 * length) div best.p").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
