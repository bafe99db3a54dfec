"""M1: embed a text column.

An *embedder* maps a string Column to an ``array<float>`` Column (NULL when the
row cannot be embedded, so one bad row never fails a task).  Two kinds:

* :class:`HashingEmbedder` (default): deterministic hashed bag of words.  Token
  split, lower-casing and hashing are JVM built-ins; only the bucket count +
  L2 normalisation runs in an Arrow UDF over whole list buffers (numpy
  ``bincount`` on a batch, no per-row Python).
* :class:`BatchModelEmbedder`: wraps any ``fn(list[str]) -> list[list[float]]``
  (e.g. a model-server client) in an Arrow-batched pandas UDF with per-row
  failure isolation, mirroring the reference's per-row skip on embed error.
"""

from __future__ import annotations

from typing import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed tokenisation of the default embedder: runs of these whitespace characters.
TOKEN_SPLIT = "[\\t\\n\\x0B\\f\\r ]+"

_ROWS_PER_CHUNK = 2048


def _counts_to_unit(buckets: pa.Array, dim: int) -> pa.Array:
    """list<long> bucket ids -> list<float> L2-normalised counts (NULL if empty)."""
    if isinstance(buckets, pa.ChunkedArray):
        buckets = buckets.combine_chunks()
    n = len(buckets)
    lengths = pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(buckets).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    valid = lengths > 0
    out_vals = []
    for lo in range(0, n, _ROWS_PER_CHUNK):
        hi = min(n, lo + _ROWS_PER_CHUNK)
        seg = flat[starts[lo]:starts[hi]]
        rows = np.repeat(np.arange(hi - lo, dtype=np.int64), lengths[lo:hi])
        counts = np.bincount(rows * dim + seg, minlength=(hi - lo) * dim)
        counts = counts.reshape(hi - lo, dim).astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1))
        keep = valid[lo:hi]
        unit = counts[keep] / norms[keep, None]
        out_vals.append(unit.astype(np.float32).ravel())
    values = np.concatenate(out_vals) if out_vals else np.zeros(0, np.float32)
    offsets = np.concatenate([[0], np.cumsum(np.where(valid, dim, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.float32()),
                                    mask=pa.array(~valid))


def token_buckets(text, dim: int) -> Column:
    """Bucket id per whitespace token: first 32 bits of md5(token) mod dim (JVM-side)."""
    text = F.col(text) if isinstance(text, str) else text
    toks = F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != F.lit(""))
    return F.transform(
        toks, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))


class HashingEmbedder:
    """Deterministic hashed bag-of-words embedder (the default stand-in model)."""

    def __init__(self, dim: int = 64):
        self.dim = int(dim)
        d = self.dim

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def _unit(b: pa.Array) -> pa.Array:
            return _counts_to_unit(b, d)

        # Nondeterministic only for the optimizer: never duplicate or move the Python evaluation.
        self._unit = _unit.asNondeterministic()

    def embed(self, text) -> Column:
        return self._unit(token_buckets(text, self.dim))


# Fixed default of the reference's configuration: embedding batch size.
MODEL_BATCH = 32


def call_in_batches(fn, vals: list, batch_size: int, retries: int, one):
    """Call ``fn`` on consecutive sub-batches; a sub-batch that still fails after
    ``retries`` retries is redone row by row with ``one`` (row isolation)."""
    out = []
    for lo in range(0, len(vals), max(1, batch_size)):
        chunk = vals[lo:lo + batch_size]
        res = None
        for _ in range(retries + 1):
            try:
                res = list(fn(chunk))
                if len(res) != len(chunk):
                    raise ValueError("model returned wrong number of rows")
                break
            except Exception:  # noqa: BLE001 - retried, then isolated per row
                res = None
        out.extend(res if res is not None else [one(t) for t in chunk])
    return out


class BatchModelEmbedder:
    """Plug-in model: ``fn(texts) -> vectors``, called in sub-batches of ``batch_size``
    with ``retries``; a failing sub-batch is redone row by row, and a failing row (or
    one of the wrong dimension) yields NULL."""

    def __init__(self, fn: Callable[[Sequence[str]], Sequence[Sequence[float]]], dim: int,
                 batch_size: int = MODEL_BATCH, retries: int = 0):
        self.dim = int(dim)
        d = self.dim

        def _safe_one(t):
            if t is None:
                return None
            try:
                v = list(fn([t])[0])
                return v if len(v) == d else None
            except Exception:  # noqa: BLE001 - row isolation is the contract
                return None

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def _embed(texts):
            import pandas as pd
            vals = texts.where(texts.notna(), None).tolist()
            out = call_in_batches(fn, vals, batch_size, retries, _safe_one)
            out = [list(v) if v is not None and len(v) == d else None for v in out]
            return pd.Series(out)

        self._embed = _embed.asNondeterministic()

    def embed(self, text) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        return self._embed(text)


def embed_documents(df: DataFrame, text_col: str = "content", embedder=None,
                    out_col: str = "embedding", error_col: str | None = "embed_error") -> DataFrame:
    """Add ``out_col`` (array<float>, NULL on failure) embedding ``text_col``, and
    ``error_col``: NULL, ``blank text`` or ``embedding failed`` (the row is kept either way)."""
    from kbspark.functions.parallel import spread
    from kbspark.functions.text import has_text
    embedder = embedder or HashingEmbedder()
    out = spread(df).withColumn(out_col, embedder.embed(F.col(text_col)))
    if error_col:
        out = out.withColumn(error_col, F.when(F.col(out_col).isNull(), F.when(
            has_text(F.col(text_col)), F.lit("embedding failed")).otherwise(F.lit("blank text"))))
    return out
