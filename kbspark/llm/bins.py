"""Best-fit packing with several permitted sequence lengths.

A document of n words takes n tokens and a separator; one longer than the greatest capacity is cut
into consecutive pieces. Pieces are packed in decreasing length: each goes to the open bin with the
least room that holds it; if there is none, a bin is opened. All capacities that hold the piece
compete: the bin of least cost per token wins, when filled greedily with the smaller pieces that
are still to be placed (cost = capacity + ``overhead``; ties to the smaller). In the end each bin is
downsized to the smallest capacity that holds its contents.

Scale: packing needs no global order to be near its bound, so each task packs its own rows, in
buffers of ``buffer_rows`` pieces or ``buffer_bytes`` of text: no shuffle, bounded memory, and a lost
task repeats just its own bins. Only the last bins of a buffer can stay underfull, and those are
downsized.

Defined cases: null, empty and blank texts are pieces of a separator alone; repeated rows are packed
as rows of their own; null ids are carried along; ties in length go by the order of rows; an empty
table gives no bins; extra columns are ignored. Bin ids are unique in a result and follow the
input's partitions.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096, 8192)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BINS = ("bin_id long, capacity int, n_tokens int, doc_ids array<long>, pieces array<int>, starts array<long>, "
         "lengths array<int>, text string")


def pack(lengths: list[int], capacities: tuple[int, ...], overhead: int = 16) -> list[tuple[int, list[int]]]:
    """Bins as (capacity, positions of ``lengths``); no length may exceed the greatest capacity."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    ascending = [lengths[i] for i in reversed(order)]
    room: list[tuple[int, int]] = []               # (free, bin), sorted
    bins: list[tuple[int, list[int]]] = []
    for done, i in enumerate(order):
        n = lengths[i]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            left = len(order) - done - 1           # the pieces still to be placed are the smallest ones
            best = None
            for c in capacities:
                if c < n:
                    continue
                cost = (c + overhead) / (n + _fill(ascending, left, c - n))
                if best is None or cost < best[0]:
                    best = (cost, c)
            b, free = len(bins), best[1]
            bins.append((best[1], []))
        bins[b][1].append(i)
        if free > n:
            insort(room, (free - n, b))
    return [(min(c for c in capacities if c >= sum(lengths[i] for i in members)), members) for _, members in bins]


def _fill(ascending: list[int], left: int, free: int) -> int:
    """What the ``left`` smallest pieces come to in a bin that is free up to ``free``: the largest
    that fits, again and again."""
    filled, k = 0, left
    while (k := bisect_right(ascending, free - filled, 0, k)) > 0:
        k -= 1
        filled += ascending[k]
    return filled


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = 16, separator: int = 1,
                   buffer_rows: int = 8192, buffer_bytes: int = 32 << 20, with_text: bool = True,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per bin: bin_id, capacity, n_tokens, and per piece in bin order doc_ids, pieces (its
    number in the document), starts (first word), lengths (words), and the pieces' joined text."""
    sizes = tuple(sorted(capacities))
    most = sizes[-1] - separator
    if most < 1:
        raise ValueError("the greatest capacity must exceed the separator")

    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 36
        pieces: list[tuple] = []                   # (doc_id, piece, start, words, text)
        held = 0

        def flush():
            nonlocal number, pieces, held
            found = pack([p[3] + separator for p in pieces], sizes, overhead)
            rows = []
            for capacity, members in found:
                ps = [pieces[i] for i in members]
                rows.append((number, capacity, sum(p[3] + separator for p in ps), *[[p[k] for p in ps] for k in range(4)],
                             "\n\n".join(p[4] for p in ps) if with_text else None))
                number += 1
            pieces, held = [], 0
            types = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.string())
            names = [c.split()[0] for c in _BINS.split(", ")]
            for a in range(0, len(rows), 512):
                cols = list(zip(*rows[a:a + 512]))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                words = _count_words(text)
                if words <= most:
                    pieces.append((doc_id, 0, 0, words, text if with_text else ""))
                else:
                    at = cut = 0
                    for k, m in enumerate(_WORD.finditer(text)):
                        if k and k % most == 0:
                            pieces.append((doc_id, k // most - 1, k - most, most, text[cut:at] if with_text else ""))
                            cut = m.start()
                        at = m.end()
                    last = (words - 1) // most
                    pieces.append((doc_id, last, last * most, words - last * most, text[cut:] if with_text else ""))
                held += len(text)
                if len(pieces) >= buffer_rows or held >= buffer_bytes:
                    yield from flush()
        if pieces:
            yield from flush()

    return docs.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text").mapInArrow(run, _BINS)


def _count_words(text: str) -> int:
    return sum(1 for _ in _WORD.finditer(text)) if not text.isascii() else len(text.translate(_SEPARATORS).split())


#: str.split() also splits at U+001C to U+001F; they belong to words here.
_SEPARATORS = {c: "x" for c in range(0x1C, 0x20)}


def packed_pieces(docs: DataFrame, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start_word, n_words, bin_id, capacity, bin_offset."""
    separator = options.get("separator", 1)
    b = pack_documents(docs, with_text=False, **options)
    b = b.select("bin_id", "capacity", F.posexplode(F.arrays_zip("doc_ids", "pieces", "starts", "lengths")).alias("i", "p"), "lengths")
    offset = F.aggregate(F.slice("lengths", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, n: a + n + F.lit(separator))
    return b.select(F.col("p.doc_ids").alias("doc_id"), F.col("p.pieces").alias("piece"), F.col("p.starts").alias("start_word"),
                    F.col("p.lengths").alias("n_words"), "bin_id", "capacity", offset.alias("bin_offset"))
