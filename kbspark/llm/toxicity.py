"""Toxicity: a weighted finite-state pattern grammar over clauses.

Five transducers are composed. Over characters, one weighted automaton (Aho-Corasick) finds *insults*:
whole words and word stems with learned weights, so that inflected forms of a stem match. Over the
words of a clause with a match, four small transducers run side by side: *threat* (a threat verb),
*target* (second person), *negation* (scope: the next ``NEGATION_SPAN`` words) and *reported speech*
(scope: the rest of the clause, or up to the closing quotation mark). Their product decides what a
match adds: an insult counts more with a target in its clause, less when negated or reported; a
threat counts only together with a target. A document's score is a logistic function of what its
matched clauses add up to: the sum, the strongest clause, and their number.

Learning (labelled training rows only): texts are taken once each; contexts (previous and next
word) make occurrences distinct, so that copies of one text cannot lift its words. A feature (word
or stem of 3 to 6 letters) enters the lexicon if its rate among toxic words exceeds that among
clean words by a factor and by several standard deviations. Lexicon and logistic weights are
fitted on at most about ``fit_rows`` labelled rows (a documented bound; rows are chosen by a hash of
the id). Scoring covers every whole text.

Scale: fitting moves only counts of the bounded sample; scoring is one narrow pass in Arrow
batches without a shuffle, the lexicon travels in the task closure.

Defined cases: null and empty texts have no match and get the score of a text without matches; null
labels are not used, of several labels of one id the toxic one holds; without toxic training rows
the lexicon has only threats and every other text scores low; repeated rows and null ids give a row
each (a null id is never held out nor used for fitting); extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kbspark.session import scratch_dir

# Small closed word classes of four languages: the fixed part of the grammar.
THREATS = ("kill", "hurt", "destroy", "strangle", "shoot", "stab", "töten", "umbringen", "vernichten", "erschießen",
           "tuer", "détruire", "étrangler", "matar", "destruir", "apuñalar")
TARGETS = frozenset(("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "euch", "ihr",
                     "tu", "te", "toi", "vous", "ton", "ta", "tú", "ti", "usted", "ustedes", "vosotros"))
NEGATIONS = frozenset(("not", "no", "never", "nobody", "isn't", "aren't", "nicht", "kein", "keine", "nie",
                       "pas", "jamais", "nunca", "jamás"))
REPORTS = frozenset(("said", "says", "wrote", "called", "quoted", "reported", "sagte", "sagt", "schrieb",
                     "dit", "disait", "écrit", "dijo", "dice", "escribió"))
NEGATION_SPAN = 3
TARGETED, NEGATED, REPORTED, THREAT_WEIGHT = 1.25, 0.5, 0.5, 4.0

STEM_LENGTHS = (3, 4, 5, 6)
#: A feature needs this many distinct toxic contexts, this log rate ratio, and this many deviations.
MIN_SUPPORT, MIN_LOG_RATIO, MIN_Z = 8, 2.5, 5.0
#: A stem must have this many word forms among toxic words, else the word alone says it.
MIN_FORMS = 4

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”«»„]")
#: Ends of clauses: ASCII marks, line ends, and the full stops, question and exclamation marks of other scripts.
_CLAUSE_END = re.compile("[.!?;:\\n|\\r\u0085\u2028\u2029\u2026\u203c\u203d\u2047-\u2049\u3002\uff0e\uff61\uff01\uff1f\uff1b\uff1a\uff5c"
                         "\u037e\u0589\u061b\u061f\u06d4\u0964\u0965\u0f0d\u104b\u1362\u1364-\u1367\u17d4\u17d5\u1803]")
#: A clause without marks reaches at most so many characters back from its first match, and on from it.
BEFORE, AFTER = 2000, 4000


def id_crc(id_col: Column) -> Column:
    """crc32 of the id as text."""
    return F.crc32(id_col.cast("string").cast("binary"))


def _word_border(text: str, at: int, last: int) -> int:
    """The first position from ``at`` on, at most ``last``, that is not inside a word."""
    while 0 < at < last and (text[at - 1].isalpha() or text[at - 1] in "'’") and (text[at].isalpha() or text[at] in "'’"):
        at += 1
    return min(at, last)


class Grammar:
    """The compiled transducers: ``words`` and ``stems`` map insults to weights."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.automaton = ahocorasick.Automaton()
        for kind, entries in (("w", words), ("s", stems), ("t", dict.fromkeys(THREATS, THREAT_WEIGHT))):
            for entry, weight in entries.items():
                old = self.automaton.get(entry, ())
                self.automaton.add_word(entry, (*old, (kind, len(entry), weight)))
        self.automaton.make_automaton()

    def __reduce__(self):
        return Grammar, (self.words, self.stems)

    def matches(self, text: str) -> dict[int, tuple[str, float]]:
        """Start of each matched word -> (kind, weight); the heaviest reading of a word counts."""
        found: dict[int, tuple[str, float]] = {}
        n = len(text)
        for last, entries in self.automaton.iter(text):
            for kind, size, weight in entries:
                start = last + 1 - size
                if start and text[start - 1].isalpha():
                    continue
                if kind != "s" and last + 1 < n and text[last + 1].isalpha():
                    continue
                if start not in found or found[start][1] < weight:
                    found[start] = ("threat" if kind == "t" else "insult", weight)
        return found

    def clause_weight(self, clause: str, found: dict[int, tuple[str, float]], offset: int) -> float:
        """What the matches of one clause add up to after the composed transducers."""
        target = reported = quoted = False
        negated = 0
        insults, threats = 0.0, 0.0
        for m in _TOKEN.finditer(clause):
            word = m[0]
            if not word[0].isalpha():
                quoted = not quoted
                if not quoted:
                    reported = False            # the quotation that was reported ends here
                continue
            hit = found.get(offset + m.start())
            if hit:
                weight = hit[1] * (NEGATED if negated else 1.0) * (REPORTED if reported else 1.0)
                if hit[0] == "threat":
                    threats += weight
                else:
                    insults += weight
            target |= word in TARGETS
            reported |= word in REPORTS
            negated = NEGATION_SPAN if word in NEGATIONS else max(0, negated - 1)
        return insults * (TARGETED if target else 1.0) + (threats if target else 0.0)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """(log of the sum, strongest clause, log of the number) of the matched clauses. Each match counts in
        one clause; a clause begins after the last mark before its first match, at most BEFORE characters back."""
        if not text:
            return 0.0, 0.0, 0.0
        text = text.lower()
        found = self.matches(text)
        if not found:
            return 0.0, 0.0, 0.0
        weights, left = [], 0                   # all before left is done; the text is walked once
        for at in sorted(found):
            if at < left:
                continue
            for mark in _CLAUSE_END.finditer(text, left, at):
                left = mark.end()
            if at - left > BEFORE:
                left = _word_border(text, at - BEFORE, at)
            end = _CLAUSE_END.search(text, at, at + AFTER)
            done = end.start() if end else _word_border(text, at + AFTER, len(text))
            weight = self.clause_weight(text[left:done], found, left)
            left = done
            if weight > 0:
                weights.append(weight)
        if not weights:
            return 0.0, 0.0, 0.0
        return math.log1p(sum(weights)), min(max(weights), 20.0), math.log1p(len(weights))


class ToxicityModel:
    def __init__(self, grammar: Grammar, bias: float, coef: tuple[float, float, float]):
        self.grammar, self.bias, self.coef = grammar, bias, coef

    def score(self, text: str | None) -> float:
        z = self.bias + sum(c * f for c, f in zip(self.coef, self.grammar.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _occurrences(rows: DataFrame) -> DataFrame:
    """(word, context, toxic) of every word of the fitting rows."""
    def run(batches):
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                words = _WORD.findall((text.as_py() or "").lower())
                if not words:
                    continue
                around = ["", *words, ""]
                yield pa.record_batch({"word": pa.array(words, pa.string()),
                                       "context": pa.array([f"{a} {c}" for a, c in zip(around, around[2:])], pa.string()),
                                       "toxic": pa.array([toxic] * len(words), pa.int32())})

    return rows.select("text", "toxic").mapInArrow(run, "word string, context string, toxic int")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A bounded table of the fitting rows, kept in the shared folder instead of computed again."""
    path = f"{scratch_dir(df.sparkSession, 'toxicity')}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Insult words and stems with their log rate ratios."""
    occ = _occurrences(rows).select("word", F.xxhash64("context").alias("context"), "toxic").distinct()
    # A word is its own feature ("w"), and so is each of its stems ("s").
    feats = F.array(F.struct(F.lit("w").alias("kind"), F.col("word").alias("f")),
                    *[F.when(F.length("word") >= n, F.struct(F.lit("s").alias("kind"), F.substring("word", 1, n).alias("f"))) for n in STEM_LENGTHS])
    words = _stored(occ.groupBy("word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q")), "words")
    rows_ = (words.select(F.explode(F.array_compact(feats)).alias("x"), "p", "q").groupBy("x.kind", "x.f")
             .agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.count_if(F.col("p") > 0).alias("forms")))
    total = words.agg(F.sum("p"), F.sum("q")).first()
    n1, n0 = (total[0] or 0), (total[1] or 0)
    if not n1 or not n0:
        return {}, {}
    ratio = F.log((F.col("p") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("q") + 0.5) / F.lit(n0 + 1.0))
    # likelihood ratio of the two rates against one common rate
    share = n1 / (n1 + n0)
    both = F.col("p") + F.col("q")
    gain = F.col("p") * F.log(F.col("p") / (both * share)) + F.when(F.col("q") > 0, F.col("q") * F.log(F.col("q") / (both * (1 - share)))).otherwise(0.0)
    z = F.sqrt(2 * F.greatest(gain, F.lit(0.0)))
    kept = rows_.filter((F.col("p") >= MIN_SUPPORT) & ((F.col("kind") == "w") | (F.col("forms") >= MIN_FORMS))).withColumn("r", ratio).filter((F.col("r") >= MIN_LOG_RATIO) & (z >= MIN_Z))
    words_, stems = {}, {}
    for r in kept.select("kind", "f", "r").collect():       # bounded by the fitting rows
        (words_ if r.kind == "w" else stems)[r.f] = float(r.r)
    return words_, stems


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[float, float, float]]:
    """Ridge logistic regression by Newton steps, each halved until the loss falls."""
    a = np.column_stack([np.ones(len(x)), x])
    ridge = np.array([1e-3, 0.1, 0.1, 0.1])

    def loss(w):
        z = a @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * w * w).sum())

    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(ridge), a.T @ (y - p) - ridge * w)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if size <= 1e-6 or np.abs(size * step).max() < 1e-8:
            break
    return float(w[0]), tuple(float(v) for v in w[1:])


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None, fit_rows: int = 20_000,
                 id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on labelled rows whose id satisfies ``train`` (an expression over a column named ``doc_id``),
    at most about ``fit_rows`` of them."""
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
           .filter("doc_id is not null and toxic is not null"))
    if train is not None:
        lab = lab.filter(train)
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = lab.count()
    if n > fit_rows:
        lab = lab.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / n))
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(lab), "doc_id").groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n"))
            .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))
    rows = _stored(rows, "rows")
    grammar = Grammar(*_lexicon(rows))

    def measure(batches):
        for b in batches:
            f = [grammar.features(t.as_py()) for t in b.column(0)]
            cols = list(zip(*f)) if f else ([], [], [])
            yield pa.record_batch([*[pa.array(c, pa.float64()) for c in cols], b.column(1)], ["a", "b", "c", "toxic"])

    got = rows.mapInArrow(measure, "a double, b double, c double, toxic int").collect()      # fit_rows at most
    y = np.array([r.toxic for r in got], float)
    if not len(got) or y.min() == y.max():
        return ToxicityModel(grammar, -4.0, (1.0, 1.0, 1.0))
    bias, coef = _logistic(np.array([(r.a, r.b, r.c) for r in got], float), y)
    return ToxicityModel(grammar, bias, coef)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in column ``out`` (which must be a new name)."""
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    grammar, bias, coef = model.grammar, model.bias, model.coef

    def run(batches):
        m = ToxicityModel(grammar, bias, coef)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.score(t.as_py()) for t in texts], pa.float64())],
                                             [*b.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), learnt from rows whose id's crc32 mod 5 is not 0."""
    model = fit_toxicity(docs, labels, train=id_crc(F.col("doc_id")) % 5 != 0)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    s = score_toxicity(d, model)
    return s.select("doc_id", F.coalesce(id_crc(F.col("doc_id")) % 5 == 0, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with a score below ``threshold``, with all their columns."""
    model = fit_toxicity(docs, labels)
    name = next(n for n in ("toxicity", *(f"toxicity_{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns)
    return score_toxicity(docs, model, out=name).filter(F.col(name) < threshold).drop(name)
