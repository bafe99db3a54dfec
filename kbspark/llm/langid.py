"""Language identification by interpolated Kneser-Ney character models.

Per language a character model of order 4 is trained on letters and single spaces (case folded, all
else is a space): absolute discounting by order (D = n1 / (n1 + 2 n2)), continuation counts below the
highest order, interpolation down to a uniform floor. The models of all languages share one table
per order: keys are packed n-grams, mixed to hashes and kept in a sorted array, with one row of
interpolated log probabilities (a column per language); a second table per order holds the backoff
weights of contexts, for n-grams that no language has seen. A text goes to the language of the
lowest cross-entropy per symbol; ties go to the smaller name.

The score is the posterior of that language against the others and an unknown language (uniform
over the alphabet), with the evidence of at most ``EVIDENCE`` symbols. Rejection is calibrated on
training rows that were not used for counting: a text is rejected if its cross-entropy is above
both the language's 99.9 % quantile there plus ``SLACK`` nats, and half way to the uniform model.

Learning uses at most about ``fit_rows`` labelled rows per language, chosen by a hash of the id (a
documented bound of the classifier), counted in Spark; the counts of that sample are all that
reaches the driver. Every whole text is scored, in one narrow pass without a shuffle; a longer text
is worked through in pieces cut at non-letters, whose symbols have their own left context.

Defined cases: null texts and texts without letters are ``und`` with score 0 and count as rejected;
null languages are not learnt; without any training row every text is ``und``; repeated rows and
null ids give a row each (null ids are neither held out nor learnt); extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from kbspark.llm.words import mix, slices
from kbspark.session import scratch_dir

ORDER = 4
EVIDENCE, SLACK = 40, 0.25
SPACE, OTHER, FIRST = 1, 2, 3
#: Known letters (16 bits a symbol); rarer ones are OTHER.
MAX_LETTERS = 60_000
PIECE = 1 << 20
UNKNOWN = "und"


def _folded(cp: int) -> int:
    """Code point of a letter in lower case (its own if that is longer); 0 for non-letters."""
    c = chr(cp)
    if not c.isalpha():
        return 0
    low = c.lower()
    return ord(low) if len(low) == 1 else cp


_FOLD: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    global _FOLD
    if _FOLD is None:
        t = np.zeros(0x110000, np.uint32)
        for cp in (*range(0xD800), *range(0xE000, 0x110000)):
            t[cp] = _folded(cp)
        _FOLD = t
    return _FOLD


def _pieces(text: str):
    """A text in pieces of at most about PIECE characters, cut at non-letters."""
    start = 0
    while len(text) - start > PIECE:
        end = start + PIECE
        while end > start + 1 and text[end - 1].isalpha():
            end -= 1
        if end == start + 1:                     # one huge word
            end = start + PIECE
        yield text[start:end]
        start = end
    yield text[start:]


def _letters(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points with 0 for spaces, owner of each): runs of spaces are single, none leads."""
    raw = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    sym = _fold_table()[raw]
    keep = np.ones(len(sym), bool)
    space = sym == 0
    if len(sym):
        first = np.ones(len(sym), bool)
        first[1:] = owner[1:] != owner[:-1]
        keep[1:] = ~(space[1:] & space[:-1])
        keep |= first
        keep &= ~(space & first)
        # a leading space run: its first was dropped above, the next ones follow a space
    return sym[keep], owner[keep]


def _ngrams(sym: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Packed ORDER-grams that end at each symbol; before a piece there are spaces."""
    key = sym.astype(np.uint64)
    same = np.ones(len(sym), bool)
    for k in range(1, ORDER):
        prev = np.full(len(sym), SPACE, np.uint64)
        if len(sym) > k:
            same = np.zeros(len(sym), bool)
            same[k:] = owner[k:] == owner[:-k]
            prev[k:][same[k:]] = sym[:-k][same[k:]]
        key |= prev << np.uint64(16 * k)
    return key


class _Hashed:
    """Sorted hash array of packed keys -> row."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        h = mix(keys)
        order = np.argsort(h, kind="stable")
        self.hash, self.rows = h[order], rows[order]
        self.bits = max(1, min(18, int(math.log2(max(len(h), 2)))))
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.start = np.append(np.searchsorted(self.hash, edges), len(h)).astype(np.int32)
        self.longest = int(np.diff(self.start).max()) if len(h) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 if absent."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.hash):
            return out
        h = mix(keys)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int32)
        pos, end = self.start[at], self.start[at + 1]
        todo = np.flatnonzero(pos < end)
        while len(todo):
            p = pos[todo]
            got = self.hash[p]
            want = h[todo]
            hit = got == want
            out[todo[hit]] = p[hit]
            go = ~hit & (got < want)
            todo = todo[go]
            pos[todo] += 1
            todo = todo[pos[todo] < end[todo]]
        return out


class LanguageModel:
    """``letters``: sorted code points; ``grams``/``backoff``: per order, (keys, rows of log values)."""

    def __init__(self, langs: list[str], letters: np.ndarray, grams: list, backoff: list, limits: np.ndarray):
        self.langs, self.letters, self.grams, self.backoff, self.limits = langs, letters, grams, backoff, limits
        self._ready = None

    def __reduce__(self):
        return LanguageModel, (self.langs, self.letters, self.grams, self.backoff, self.limits)

    def _prepare(self):
        if self._ready is None:
            table = np.full(0x110000, OTHER, np.uint16)
            table[self.letters] = np.arange(FIRST, FIRST + len(self.letters), dtype=np.uint16)
            table[0] = SPACE
            self._ready = table, [_Hashed(*g) for g in self.grams], [_Hashed(*b) for b in self.backoff]
        return self._ready

    @property
    def uniform(self) -> float:
        """Cross-entropy of the uniform model."""
        return math.log(len(self.letters) + 2)

    def _log_probs(self, keys: np.ndarray) -> np.ndarray:
        """(symbols x languages) log probabilities."""
        _, grams, backoff = self._prepare()
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        todo = np.arange(len(keys))
        for n in range(ORDER, 0, -1):
            k = keys[todo] & np.uint64((1 << (16 * n)) - 1)
            at = grams[n - 1].find(k)
            hit = at >= 0
            out[todo[hit]] += grams[n - 1].rows[at[hit]]
            todo, k = todo[~hit], k[~hit]
            if not len(todo):
                break
            ctx = backoff[n - 1].find(k >> np.uint64(16))
            known = ctx >= 0
            out[todo[known]] += backoff[n - 1].rows[ctx[known]]
            if n == 1:
                out[todo] -= self.uniform
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) cross-entropies in nats per symbol, and the number of letters."""
        table, _, _ = self._prepare()
        total = np.zeros((len(texts), len(self.langs)))
        symbols, letters = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        pieces, owners = [], []
        for i, t in enumerate(texts):
            for p in _pieces(t or ""):
                pieces.append(p)
                owners.append(i)
        owners = np.array(owners, np.int64)
        a = 0
        while a < len(pieces):
            b, size = a, 0
            while b < len(pieces) and (b == a or size + len(pieces[b]) <= PIECE):
                size += len(pieces[b])
                b += 1
            cps, own = _letters(pieces[a:b])
            if len(cps):
                sym = table[cps]
                lp = self._log_probs(_ngrams(sym, own))
                who = owners[a + own]
                for j in range(len(self.langs)):
                    total[:, j] -= np.bincount(who, lp[:, j], len(texts))
                symbols += np.bincount(who, minlength=len(texts))
                letters += np.bincount(who, sym != SPACE, len(texts)).astype(np.int64)
            a = b
        return total / np.maximum(symbols, 1)[:, None], letters

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        if not self.langs:
            return [(UNKNOWN, 0.0, True)] * len(texts)
        h, letters = self.entropies(texts)
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        n = np.minimum(letters, EVIDENCE)[:, None]
        odds = np.exp(-np.minimum(700, n * (np.column_stack([h, np.full(len(h), self.uniform)]) - low[:, None])))
        score = 1 / odds.sum(axis=1)
        limit = np.maximum(self.limits[best] + SLACK, (self.limits[best] + self.uniform) / 2)
        return [(self.langs[b], float(min(max(s, 0.0), 1.0)), bool(r)) if c else (UNKNOWN, 0.0, True)
                for b, s, r, c in zip(best, score, low > limit, letters)]


def _estimate(langs: list[str], letters: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[list, list]:
    """Interpolated Kneser-Ney tables from packed ORDER-grams and their (n x languages) counts."""
    raw = [None] * ORDER
    raw[ORDER - 1] = (keys, counts)
    for n in range(ORDER - 1, 0, -1):                     # continuation counts: distinct left symbols
        up, c = raw[n]
        low, inv = np.unique(up & np.uint64((1 << (16 * n)) - 1), return_inverse=True)
        cont = np.zeros((len(low), len(langs)))
        np.add.at(cont, inv, c > 0)
        raw[n - 1] = (low, cont)
    vocab = len(letters) + 2
    grams, backoff = [], []
    below = np.full((1, len(langs)), 1.0 / vocab)
    below_keys = np.zeros(1, np.uint64)
    for n in range(1, ORDER + 1):
        k, c = raw[n - 1]
        ones, twos = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
        d = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)
        ctx, inv = np.unique(k >> np.uint64(16), return_inverse=True)
        tot, types = np.zeros((len(ctx), len(langs))), np.zeros((len(ctx), len(langs)))
        np.add.at(tot, inv, c)
        np.add.at(types, inv, c > 0)
        rest = np.where(tot > 0, d * types / np.maximum(tot, 1), 1.0)          # interpolation weight
        lower = below[np.searchsorted(below_keys, k & np.uint64((1 << (16 * (n - 1))) - 1))] if n > 1 else below
        p = np.where(tot[inv] > 0, np.maximum(c - d, 0) / np.maximum(tot[inv], 1), 0.0) + rest[inv] * lower
        grams.append((k, np.log(p).astype(np.float32)))
        backoff.append((ctx, np.log(rest).astype(np.float32)))
        below, below_keys = p, k
    return grams, backoff


def fit_languages(docs: DataFrame, train: Column | None = None, fit_rows: int = 2_000) -> LanguageModel:
    """Fit on rows with a language whose id satisfies ``train``, at most about ``fit_rows`` per
    language; one in eight of them calibrates the rejection instead of being counted."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                    F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and lang is not null and text is not null")
    if train is not None:
        d = d.filter(train)
    sizes = {r.lang: r["count"] for r in d.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros(0, np.uint32), [], [], np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1_000_000, int(1_000_000 * fit_rows / sizes[k]) + 1))])
    d = d.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")])
    path = f"{scratch_dir(docs.sparkSession, 'languages')}/rows"          # the bounded sample, read once
    d.write.parquet(path)
    d = docs.sparkSession.read.schema(d.schema).parquet(path)
    rest = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(8)) == 0

    def letters_of(batches):
        for b in batches:
            seen = np.zeros(0x110000, np.int64)
            for part in slices(b, 0):
                cps, _ = _letters([p for t in part.column(0).to_pylist() for p in _pieces(t or "")])
                seen += np.bincount(cps, minlength=0x110000)
            at = np.flatnonzero(seen)
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["cp", "n"])

    found = (d.select("text").mapInArrow(letters_of, "cp long, n long").filter("cp > 0").groupBy("cp").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "cp").limit(MAX_LETTERS).collect())
    letters = np.array(sorted(r.cp for r in found), np.uint32)

    def count(batches):
        table = np.full(0x110000, OTHER, np.uint16)
        table[letters] = np.arange(FIRST, FIRST + len(letters), dtype=np.uint16)
        table[0] = SPACE
        for b in batches:
            for part in slices(b, 0):
                of = np.array(part.column(1).to_pylist())
                texts = part.column(0).to_pylist()
                for lang in np.unique(of):
                    cps, own = _letters([p for t, o in zip(texts, of) if o == lang for p in _pieces(t or "")])
                    k, n = np.unique(_ngrams(table[cps], own), return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))],
                                          ["lang", "key", "n"])

    counted = (d.filter(~rest).select("text", "lang").mapInArrow(count, "lang string, key long, n long")
               .groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow())          # bounded by the sample
    key = counted.column("key").to_numpy().view(np.uint64)
    keys, inv = np.unique(key, return_inverse=True)
    counts = np.zeros((len(keys), len(langs)))
    lang_at = np.searchsorted(np.array(langs, object), np.array(counted.column("lang").to_pylist(), object)) if len(key) else np.zeros(0, int)
    counts[inv, lang_at] = counted.column("n").to_numpy()
    if not len(keys):
        return LanguageModel([], np.zeros(0, np.uint32), [], [], np.zeros(0))
    grams, backoff = _estimate(langs, letters, keys, counts)
    model = LanguageModel(langs, letters, grams, backoff, np.zeros(len(langs)))

    def measure(batches):
        for b in batches:
            for part in slices(b, 0):
                h, n = model.entropies(part.column(0).to_pylist())
                own = h[np.arange(len(h)), [langs.index(x) for x in part.column(1).to_pylist()]]
                yield pa.record_batch([part.column(1), pa.array(own)], ["lang", "h"]).filter(pa.array(n > 0))

    quant = d.filter(rest).select("text", "lang").mapInArrow(measure, "lang string, h double").groupBy("lang").agg(
        F.percentile_approx("h", 0.999, 10_000).alias("q")).collect()
    limits = {r.lang: r.q for r in quant}
    model.limits = np.array([limits.get(x, model.uniform) for x in langs])
    return model


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text",
                       out: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with the language, score and rejection of each whole text, in new columns ``out``."""
    if clash := set(out) & set(docs.columns):
        raise ValueError(f"columns exist: {sorted(clash)}")
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)      # bounded by the fitting rows

    def run(batches):
        m = shared.value
        for batch in batches:
            for b in slices(batch, at):
                got = m.predict(b.column(at).to_pylist())
                cols = list(zip(*got)) if got else ([], [], [])
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, *[pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.bool_()))]], [*b.schema.names, *out])

    new = [StructField(n, t) for n, t in zip(out, (StringType(), DoubleType(), BooleanType()))]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *new]))


def language_query(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), learnt from rows whose id's crc32 mod 4 is not 2."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    model = fit_languages(docs, train=crc % 4 != 2)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return identify_languages(d, model).select("doc_id", F.coalesce(crc % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The documents whose language is not rejected, with all their columns."""
    names = []
    for base in ("lang_pred", "lang_score", "lang_rejected"):
        names.append(next(n for n in (base, *(f"{base}_{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns))
    found = identify_languages(docs, fit_languages(docs), out=tuple(names))
    return found.filter(~F.col(names[2])).drop(*names)
