"""MinHash near-duplicates: a chosen-path set similarity join.

Each document is its set of distinct word shingles. Equal sets collapse into one class first. A
class gets a sketch of minwise tokens; ``trees`` independent trees branch the classes recursively
by the tokens at chosen coordinates: the root of a tree chooses ``root_depth`` coordinates at once,
and every node below chooses its own, one for each child, by a hash of the node. At level k below the
root a record has (1 + 1/k) / p children on average, p being the chance that a linked pair agrees in a
coordinate: 1 / p keep the pair together in one child on average, and the rest makes up for the paths
that die out, so that the miss stays bounded (``miss``) however deep a large node branches. Nodes of
at most ``small`` classes are compared exhaustively; larger ones branch on. A pair at the threshold
meets in a root of 3 coordinates with probability 0.51, so 20 trees miss it less than once in a million.

A small node lies in one task, sorted by node, one node in memory at a time. It is met twice. First it
gives a forest: leaders (each the most central of the members that no leader has yet) take the members
whose sketches are surely alike, one candidate for each label that a leader takes over, so at most as many as there are
members. Links join labels (components so far), and a node whose members all have one label is closed,
as no link inside it is news. Then the full sets of the classes in nodes still open are sent to the
nodes, compared there exactly, and a forest of links is emitted, not the pairs; nodes of more than ``SET_ITEMS``
shingles give every pair of different labels that passes the filters instead. Trees run in passes of growing size (``_passes``), so that the labels of the first close the nodes of the rest,
and a pair that has met in a small root of an earlier tree is not given again.

Large nodes hardly shrink by branching if they are groups of near copies. They end another way, without
dropping rows: every member of a large node is compared with the node's leader, its most central member
(nearest to the majority of the sketch bits of about ``CENTRE_SAMPLE`` members; the source of a group
of copies, if it is there); one where at most ``minor`` members have another label than the most frequent
is closed once these few have been compared with all. Nodes whose classes agree in all coordinates
are finished by blocks of ``small`` / 2 members, each pair of blocks compared exhaustively.

Every candidate passes two sketch filters (128 bits, then 256 coordinates of 4 bits; five standard
deviations of slack) and is then confirmed on the full sets, once, so no false link exists;
components follow.

Scale: texts are read once for the sketches and once per level that has candidates, then only
those of candidates (a semi-join with their ids: broadcast while they are few, else shuffled).
What is shuffled per class and tree is 50 bytes at the root level, 250 for classes of open nodes, and only
large nodes below. Node sizes and labels are partial aggregates, and hot nodes are met by joins that AQE
can split; a task holds at most ``small`` members of a node (5 MB). Levels are cut by tables in the shared
checkpoint folder. The driver sees row counts only.

Defined cases: null, empty and blank texts have no set (``n_shingles`` 0) and link nothing; texts
with fewer words than a shingle are one shingle; rows that repeat a doc_id are judged row by row
and count as links of that id; a null doc_id stands for no document that could be reached: such
rows get the smallest non-null id of their component, or null, and are kept only in the latter
case; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from kbspark.llm.components import connected_components, in_few_tasks, small as small_table
from kbspark.llm.words import mix, seeds, shingle_sets, slices
from kbspark.session import scratch_dir

#: Coordinates to branch by (32-bit tokens) and to compare (the same and more).
COORDS, WIDE = 64, 256
CENTRE_SAMPLE = 64
#: Ids of candidate documents are broadcast up to this many, else shuffled.
BROADCAST_IDS = 1_000_000
#: Sketches are broadcast up to this many (up to 400 bytes each), else shuffled.
BROADCAST_SKETCHES = 40_000
#: Seed of the trees' choices.
SEED = 20_000
#: Nodes of at most this many members give all their pairs at once.
TINY = 32
#: Leaders chosen in a node before the rest of its members is compared pair by pair.
LEADERS = 128
#: A leader takes over what looks this much (in percentage points) above the threshold.
SURE = 4
#: Shingles of a node whose full sets are compared inside one task (8 bytes each).
SET_ITEMS = 2_000_000
#: Larger roots noted, so that their pairs may be given again; with more of them all pairs may be.
NOTED = 100_000


def _fingerprints(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """128-bit fingerprint (two uint64) of each non-empty set."""
    start = off[:-1]
    n = np.diff(off).astype(np.uint64)
    c = seeds(2, 300)
    with np.errstate(over="ignore"):
        f = [mix(np.add.reduceat(mix(sets ^ c[k]), start) + n * c[1 - k]) for k in range(2)]
    return np.stack(f, 1)


def _sketch(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per set, as bytes: COORDS 32-bit minwise tokens, then 4 bits of each of WIDE tokens."""
    mult, flip = seeds(WIDE, 400) | np.uint64(1), seeds(WIDE, 800)
    out = np.empty((len(off) - 1, WIDE), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(WIDE):
            out[:, i] = mix(np.minimum.reduceat((sets ^ flip[i]) * mult[i], off[:-1])) >> np.uint64(32)
    four = (out & np.uint32(15)).astype(np.uint8)
    return np.hstack([np.ascontiguousarray(out[:, :COORDS]).view(np.uint8), four[:, ::2] | four[:, 1::2] << 4])


def _fixed(a: np.ndarray) -> pa.Array:
    """Rows of a 2-d array as binary values."""
    a = np.ascontiguousarray(a)
    width = a.shape[1] * a.itemsize
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(0, (len(a) + 1) * width, width, dtype=np.int32)), pa.py_buffer(a)])


def _plain(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Binary values of equal size back to a 2-d array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for b in slices(batch, 1):
                sets, off = shingle_sets(b.column(1), words)
                n = np.diff(off)
                has = n > 0
                tight = np.concatenate([[0], np.cumsum(n[has])])
                cls, sketch = [None] * len(n), [None] * len(n)
                if has.any():
                    where = np.flatnonzero(has)
                    for i, c, s in zip(where, _fixed(_fingerprints(sets, tight)).to_pylist(), _fixed(_sketch(sets, tight)).to_pylist()):
                        cls[i], sketch[i] = c, s
                yield pa.record_batch({"doc_id": b.column(0), "n_shingles": pa.array(n, pa.int64()),
                                       "cls": pa.array(cls, pa.binary()), "sketch": pa.array(sketch, pa.binary())})

    return docs.mapInArrow(run, "doc_id long, n_shingles long, cls binary, sketch binary")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(cls, items array<long>) of each document."""
    def run(batches):
        for batch in batches:
            for b in slices(batch, 1):
                sets, off = shingle_sets(b.column(1), words)
                has = np.diff(off) > 0
                tight = np.concatenate([[0], np.cumsum(np.diff(off)[has])]).astype(np.int32)
                if has.any():
                    yield pa.record_batch({"cls": _fixed(_fingerprints(sets, tight.astype(np.int64))),
                                           "items": pa.ListArray.from_arrays(pa.array(tight), pa.array(sets.view(np.int64)))})

    return docs.mapInArrow(run, "cls binary, items array<long>")


def _tokens(sketches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows x COORDS) tokens, and one bit of each of the first 128 coordinates as two 64-bit words."""
    raw = _plain(sketches, np.uint8, 4 * COORDS + WIDE // 2)
    tokens = np.ascontiguousarray(raw[:, :4 * COORDS]).view(np.uint32)
    four = raw[:, 4 * COORDS:4 * COORDS + 64]
    bits = np.hstack([four & 1, four >> 4 & 1])
    words = np.packbits(bits, axis=1).view(np.int64)
    return tokens, words[:, 0].copy(), words[:, 1].copy()


def _far(similarity: float) -> int:
    """Most differing bits (of 128) that a linked pair is allowed: mean plus five deviations."""
    p = (1 - similarity) / 2
    return math.ceil(128 * p + 5 * math.sqrt(128 * p * (1 - p)))


def _least_equal(similarity: float) -> int:
    """Fewest equal 4-bit coordinates (of WIDE) of a linked pair: mean minus five deviations."""
    p = similarity + (1 - similarity) / 16
    return math.floor(WIDE * p - 5 * math.sqrt(WIDE * p * (1 - p)))


def _mean_equal(similarity: float) -> int:
    """Equal 4-bit coordinates (of WIDE) of a pair on average."""
    return math.floor(WIDE * (similarity + (1 - similarity) / 16))


def _choice(tree: int) -> np.ndarray:
    """The order in which a tree chooses coordinates."""
    return np.argsort(seeds(COORDS, SEED + tree * COORDS), kind="stable")


def _root(tokens: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """The root node of each row in a tree."""
    order, mult = _choice(tree), seeds(depth + 1, 700) | np.uint64(1)
    with np.errstate(over="ignore"):
        h = np.full(len(tokens), mix(np.array([tree + 1], np.uint64))[0] * mult[depth], np.uint64)
        for k in range(depth):
            h = mix(h + tokens[:, order[k]].astype(np.uint64) * mult[k])
    return h


def _passes(trees: int) -> list[range]:
    """The trees in passes: one, three, the rest."""
    cuts = [0, *(n for n in (1, 4) if n < trees), trees]
    return [range(a, z) for a, z in zip(cuts, cuts[1:])]


def _with_roots(sketches: DataFrame, trees: int, depth: int) -> DataFrame:
    """(cls, wide): the coordinates to compare, then 32 bits of the root in each tree."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                raw = _plain(b.column(1), np.uint8, 4 * COORDS + WIDE // 2)
                tokens = np.ascontiguousarray(raw[:, :4 * COORDS]).view(np.uint32)
                roots = np.stack([_root(tokens, r, depth).astype(np.uint32) for r in range(trees)], 1)
                yield pa.record_batch({"cls": b.column(0), "wide": pa.array(_fixed(np.hstack([raw[:, 4 * COORDS:], roots.view(np.uint8)])))})

    return sketches.mapInArrow(run, "cls binary, wide binary")


def _roots(classes: DataFrame, trees: int | range, depth: int) -> DataFrame:
    trees = range(trees) if isinstance(trees, int) else trees

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            s, lo, hi = _tokens(b.column(1))
            for r in trees:
                h = _root(s, r, depth)
                yield pa.record_batch({"tree": pa.array(np.full(len(s), r, np.int32)), "node": pa.array(h.view(np.int64)),
                                       "cls": b.column(0), "lo": pa.array(lo), "hi": pa.array(hi)})

    return classes.select("cls", "sketch").mapInArrow(run, "tree int, node long, cls binary, lo long, hi long")


def _children(similarity: float, level: int) -> float:
    """Average number of children of a record at a level (from 1) below the root."""
    return (1 + 1 / level) / (similarity + (1 - similarity) / 16)


def miss(similarity: float, trees: int, root_depth: int, levels: int) -> float:
    """Chance that a pair at the threshold shares no node ``levels`` below the roots of any tree."""
    p, apart = similarity + (1 - similarity) / 16, 0.0
    for level in range(levels, 0, -1):
        whole, part = divmod(_children(similarity, level), 1)
        u = 1 - p + p * apart
        apart = u ** whole * (1 - part + part * u)
    return (1 - similarity ** root_depth * (1 - apart)) ** trees


def _branch(rows: DataFrame, level: int, similarity: float) -> DataFrame:
    """The children of the rows' nodes (rows: tree, node, cls, lo, hi, label, wide)."""
    whole, part = divmod(_children(similarity, level), 1)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            wide, _ = _wide(b.column(6))
            node = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            chosen = mix(node)
            more = (chosen & np.uint64(0xFFFFF)) < np.uint64(int(part * (1 << 20)))
            for k in range(int(whole) + 1):
                at = np.arange(len(node)) if k < whole else np.flatnonzero(more)
                col = ((chosen[at] >> np.uint64(32)) + np.uint64(k)) % np.uint64(WIDE)       # another one for each child
                token = wide[at, col // np.uint64(2)] >> (col % np.uint64(2) * np.uint64(4)).astype(np.uint8) & 15
                with np.errstate(over="ignore"):
                    child = mix(node[at] * np.uint64(0x9E3779B97F4A7C15) + token + (col << np.uint64(40)))
                out = b.select(["tree", "cls", "lo", "hi", "label"]).take(pa.array(at))
                yield pa.record_batch({"tree": out.column(0), "node": pa.array(child.view(np.int64)), **{c: out.column(c) for c in ("cls", "lo", "hi", "label")}})

    return rows.select("tree", "node", "cls", "lo", "hi", "label", "wide").mapInArrow(
        run, "tree int, node long, cls binary, lo long, hi long, label binary")


def _wide(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates to compare (rows x WIDE / 2 bytes) and root keys (rows x trees; none if not given)."""
    width = len(column[0].as_buffer()) if len(column) else WIDE // 2
    raw = _plain(column, np.uint8, width)
    return np.ascontiguousarray(raw[:, :WIDE // 2]), np.ascontiguousarray(raw[:, WIDE // 2:]).view(np.uint32)


def _whole_nodes(batches, column: str = "part"):
    """The batches, sorted by ``column``, cut so that each group lies in one batch."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        at = b.column(column).to_numpy(zero_copy_only=False)
        if held and held[-1].column(column)[-1].as_py() == at[0]:
            first = int(np.argmax(at != at[0])) if at[-1] != at[0] else b.num_rows
            held.append(b.slice(0, first))
            b, at = b.slice(first), at[first:]
            if not b.num_rows:
                continue
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        last = int(np.argmax(at == at[-1]))
        if last:
            yield b.slice(0, last)
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Nodes:
    """Whole nodes of one batch (part, tree, cls, lo, hi, label, wide) with the filters of a pair."""

    def __init__(self, b: pa.RecordBatch, far: int, least_equal: int, noted: np.ndarray | None):
        part = b.column("part").to_numpy(zero_copy_only=False)
        self.cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        self.cls, self.far, self.least_equal, self.noted = b.column("cls"), far, least_equal, noted
        self.bits = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi")], 1).view(np.uint64)
        self.label = b.column("label").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        self.tree = b.column("tree").to_numpy(zero_copy_only=False)
        self.wide, self.keys = _wide(b.column("wide"))

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of rows are candidates: other labels, near sketches, no earlier small root in common."""
        ok = np.flatnonzero(self.label[i] != self.label[j])
        ok = ok[np.bitwise_count(self.bits[i[ok]] ^ self.bits[j[ok]]).sum(axis=1, dtype=np.int16) <= self.far]
        return self.sketched(i, j, ok)

    def sketched(self, i: np.ndarray, j: np.ndarray, ok: np.ndarray) -> np.ndarray:
        out = []
        for k in range(0, len(ok), 1 << 16):
            x = ok[k:k + (1 << 16)]
            x = x[_equal(self.wide[i[x]], self.wide[j[x]]) >= self.least_equal]
            if self.noted is not None and self.keys.shape[1]:
                met = (self.keys[i[x]] == self.keys[j[x]]) & (np.arange(self.keys.shape[1]) < self.tree[i[x], None])
                if len(self.noted):
                    met &= ~np.isin(self.keys[i[x]], self.noted)
                x = x[~met.any(axis=1)]
            out.append(x)
        return np.concatenate(out) if out else ok

    def batch(self, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"a": self.cls.take(pa.array(i)), "b": self.cls.take(pa.array(j))})

    def tiny(self):
        """All candidates of the nodes of at most ``TINY`` rows."""
        size = np.diff(self.cuts)
        start, n = self.cuts[:-1][size <= TINY], size[size <= TINY]
        row = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        after = np.repeat(start + n, n) - row - 1            # rows of the node behind each row
        i = np.repeat(row, after)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
        ok = self.alike(i, j)
        yield self.batch(i[ok], j[ok])

    def larger(self):
        return [(a, z) for a, z in zip(self.cuts[:-1], self.cuts[1:]) if z - a > TINY]

    def every(self):
        """All candidates of the larger nodes: rows without the most frequent label against all."""
        for a, z in self.larger():
            codes, of, n = np.unique(self.label[a:z], return_inverse=True, return_counts=True)
            other = of != np.argmax(n)
            rows, step = np.flatnonzero(other), max(1, (1 << 21) // (z - a))
            for k in range(0, len(rows), step):
                r = rows[k:k + step]
                near = np.bitwise_count(self.bits[a + r, None, 0] ^ self.bits[None, a:z, 0])
                near += np.bitwise_count(self.bits[a + r, None, 1] ^ self.bits[None, a:z, 1])
                i, j = np.nonzero((near <= self.far) & (of[r, None] != of[None, :]) & (~other[None, :] | (r[:, None] < np.arange(z - a))))
                i, j = r[i] + a, j + a
                ok = self.sketched(i, j, np.arange(len(i)))
                if len(ok):
                    yield self.batch(i[ok], j[ok])

    def forest(self, sure: int):
        """Of the larger nodes, a forest of candidates that are surely alike, found from leaders."""
        for a, z in self.larger():
            own = np.unique(self.label[a:z], return_inverse=True)[1]
            bits, wide = self.bits[a:z], self.wide[a:z]
            plain = np.unpackbits(bits.view(np.uint8).reshape(z - a, 16), axis=1)
            free = np.ones(z - a, bool)
            i, j = [], []
            for _ in range(LEADERS):
                left = np.flatnonzero(free)
                if not len(left):
                    break
                centre = np.packbits(plain[left].mean(axis=0) >= 0.5).view(np.uint64)
                lead = left[np.argmin(np.bitwise_count(bits[left] ^ centre).sum(axis=1))]
                near = np.flatnonzero((np.bitwise_count(bits ^ bits[lead]).sum(axis=1) <= self.far) & (own != own[lead]))
                equal = _equal(wide[near], wide[lead][None, :])
                near, equal = near[equal >= sure], equal[equal >= sure]
                near = near[np.argsort(-equal, kind="stable")]
                taken, best = np.unique(own[near], return_index=True)
                i.append(np.full(len(best), lead + a))
                j.append(near[best] + a)
                own[np.isin(own, taken)] = own[lead]
                free[own == own[lead]] = False
            yield self.batch(np.concatenate(i), np.concatenate(j))


def _linked_forest(b: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """Of whole nodes (part, cls, label, items), links enough to join all labels that are linked: intersections
    with all members are counted over the postings of a row's shingles."""
    part = b.column("part").to_numpy(zero_copy_only=False)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    labels = b.column("label").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    items, off = b.column("items").flatten().to_numpy(zero_copy_only=False), b.column("items").offsets.to_numpy()
    off = off - off[0]
    i, j = [], []
    for a, z in zip(cuts[:-1], cuts[1:]):
        own = np.unique(labels[a:z], return_inverse=True)[1]
        top, n, at = np.argmax(np.bincount(own)), np.diff(off[a:z + 1]), off[a:z + 1] - off[a]
        _, item, count = np.unique(items[off[a]:off[z]], return_inverse=True, return_counts=True)
        member = np.repeat(np.arange(z - a), n)[np.argsort(item, kind="stable")]
        first = np.cumsum(count) - count
        for u in np.flatnonzero(own != top):
            if own[u] == top:                    # joined by now
                continue
            mine = item[at[u]:at[u + 1]]
            size = count[mine]
            post = np.arange(size.sum()) + np.repeat(first[mine] - np.cumsum(size) + size, size)
            both = np.bincount(member[post], minlength=z - a)
            near = np.flatnonzero((100 * both >= percent * (n[u] + n - both)) & (own != own[u]))
            if len(near):
                taken, one = np.unique(own[near], return_index=True)
                i.append(np.full(len(one), u + a))
                j.append(near[one] + a)
                taken = np.append(taken, own[u])
                own[np.isin(own, taken)] = top if top in taken else own[u]
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i, j))
    return pa.record_batch({"a": b.column("cls").take(pa.array(i)), "b": b.column("cls").take(pa.array(j))})


def _members(lists: pa.ListArray, more: pa.Array | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of (cls, lo, hi, label, wide) flat: offsets, cls, (members x 2) bits, label codes (those
    of ``more`` labels follow), wide sketches."""
    off = lists.offsets.to_numpy()
    m = lists.flatten()
    bits = np.stack([m.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi")], 1).view(np.uint64) if len(m) else np.zeros((0, 2), np.uint64)
    labels = m.field("label") if more is None else pa.concat_arrays([m.field("label"), more])
    wide, _ = _wide(m.field("wide"))
    return off - off[0], m.field("cls"), bits, labels.dictionary_encode().indices.to_numpy(), wide


def _equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of equal 4-bit coordinates of each pair of rows."""
    d = x ^ y
    return (d & 15 == 0).sum(axis=1) + (d >> 4 == 0).sum(axis=1)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


class _Join:
    """One run of the similarity join: its tables and parameters."""

    def __init__(self, docs: DataFrame, words: int, percent: int, trees: int, root_depth: int, small: int):
        self.docs, self.words, self.percent, self.trees, self.root_depth, self.small = docs, words, percent, trees, root_depth, small
        self.spark = docs.sparkSession
        self.base = scratch_dir(self.spark, "chosen-path")
        self.n_stored = 0
        self.n_live = 1 << 60                  # rows of the nodes at hand; not known yet
        self.minor = max(1, min(32, small // 4))        # few, as they are sent to every row of their node
        self.noted: np.ndarray | None = np.zeros(0, np.uint32)       # keys of large roots
        self.far, self.least_equal = _far(percent / 100), _least_equal(percent / 100)

    def store(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``df`` written and read again; ``rows``: about how many rows it is made of, if known."""
        if rows is not None:
            df = in_few_tasks(df, rows)
        path = f"{self.base}/{self.n_stored}-{name}"
        self.n_stored += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # -- candidates -----------------------------------------------------------------------
    def prune(self, rows: DataFrame) -> DataFrame:
        """Rows of nodes that hold more than one label, with the node's size, its most frequent
        label and how many rows have another one."""
        by_label = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
        stat = (by_label.groupBy("node").agg(F.sum("n").alias("cnt"), F.max(F.struct("n", "label")).alias("m"), F.count(F.lit(1)).alias("labels"))
                .filter("labels > 1").select("node", "cnt", F.col("m.label").alias("top"), (F.col("cnt") - F.col("m.n")).alias("rest")))
        live = self.store(rows.drop("cnt", "top", "rest").join(stat, "node"), "live")
        self.n_live = live.count()
        return live

    def large(self, live: DataFrame) -> DataFrame:
        """Rows of nodes that are too large to be finished at once."""
        return live.filter((F.col("cnt") > self.small) & (F.col("rest") > self.minor))

    def with_wide(self, live: DataFrame) -> DataFrame:
        """Stored rows with their wide sketches, looked up only for classes in open nodes."""
        some = self.store(live.select("cls").distinct(), "open", self.n_live)
        sketches = self.classes.select("cls", "sketch").join(small_table(some), "cls", "left_semi")
        wide = self.store(_with_roots(sketches, self.trees, self.root_depth), "wide")
        return live.join(small_table(wide, BROADCAST_SKETCHES), "cls")

    def note(self, live: DataFrame) -> None:
        """Large roots: their pairs have not all been compared."""
        large = live.filter(F.col("cnt") > self.small).select("node").distinct().limit(NOTED + 1).toArrow().column(0).to_numpy()
        if self.noted is not None:
            self.noted = np.concatenate([self.noted, large.view(np.uint64).astype(np.uint32)]) if len(large) + len(self.noted) <= NOTED else None

    def in_tasks(self, live: DataFrame, bottom: bool, pairs) -> DataFrame:
        """Candidates by ``pairs(nodes)`` of each task's small nodes; at the bottom of all, by pairs of blocks."""
        far, least, noted = self.far, self.least_equal, self.noted
        g = live.filter(F.col("cnt") <= self.small).withColumn("part", F.col("node"))
        if bottom:
            g = g.unionByName(self.blocks(self.large(live)).withColumn("part", F.xxhash64("node", "part")))

        def compare(batches):
            for b in _whole_nodes(batches):
                yield from pairs(_Nodes(b, far, least, noted))

        g = g.select("part", "tree", "cls", "lo", "hi", "label", "wide").repartition("part").sortWithinPartitions("part")
        return _ordered(g.mapInArrow(compare, "a binary, b binary"))

    def forest_pairs(self, live: DataFrame) -> DataFrame:
        """In small nodes, candidates enough to join the labels that are surely alike."""
        sure = _mean_equal(min(1.0, (self.percent + SURE) / 100))

        def pairs(nodes):
            yield from nodes.tiny()
            yield from nodes.forest(sure)

        return self.in_tasks(live, False, pairs)

    def leader_pairs(self, live: DataFrame) -> DataFrame:
        """Pairs of the members of large nodes with the node's most central member."""
        large = self.large(live).select("node", "cnt", "cls", "lo", "hi", "wide")
        least = self.least_equal
        picked = F.pmod(F.xxhash64("cls", "node"), F.col("cnt")) < CENTRE_SAMPLE

        def majority(batches):
            for b in batches:
                c = [np.array([[m["lo"], m["hi"]] for m in ms], np.int64) for ms in b.column(1).to_pylist()]
                m = [np.packbits(np.unpackbits(x.view(np.uint8).reshape(len(x), 16), axis=1).mean(axis=0) >= 0.5).view(np.int64) for x in c]
                yield pa.record_batch({"node": b.column(0), "clo": pa.array([x[0] for x in m], pa.int64()), "chi": pa.array([x[1] for x in m], pa.int64())})

        centre = (large.filter(picked).groupBy("node").agg(F.collect_list(F.struct("lo", "hi")).alias("ms"))
                  .mapInArrow(majority, "node long, clo long, chi long"))
        off = F.expr("bit_count(lo ^ clo) + bit_count(hi ^ chi)")
        leader = (large.join(centre, "node").groupBy("node").agg(F.min(F.struct(off.alias("off"), "cls", "lo", "hi", "wide")).alias("leader")))
        m = large.join(leader, "node").filter("cls <> leader.cls").filter(
            f"bit_count(lo ^ leader.lo) + bit_count(hi ^ leader.hi) <= {self.far}")

        def alike(batches):
            for b in batches:
                equal = _equal(*(_wide(b.column(i))[0] for i in (2, 3)))
                yield b.select(["a", "b"]).filter(pa.array(equal >= least))

        m = m.select(F.col("cls").alias("a"), F.col("leader.cls").alias("b"), F.col("wide").alias("x"), F.col("leader.wide").alias("y"))
        return _ordered(m.mapInArrow(alike, "a binary, b binary"))

    def all_pairs(self, live: DataFrame, bottom: bool) -> DataFrame:
        """Pairs of different labels in nodes of at most ``small`` classes; at the bottom in all nodes,
        by pairs of blocks."""
        def pairs(nodes):
            yield from nodes.tiny()
            yield from nodes.every()

        return self.in_tasks(live, bottom, pairs)

    def minor_pairs(self, live: DataFrame) -> DataFrame:
        """Pairs of different labels in larger nodes where at most ``minor`` rows have another label
        than the most frequent one: these few against all."""
        far, least = self.far, self.least_equal
        rows = live.filter((F.col("cnt") > self.small) & (F.col("rest") <= self.minor)).select("node", "cls", "lo", "hi", "label", "top", "wide")
        few = rows.filter("label <> top").groupBy("node").agg(F.collect_list(F.struct("cls", "lo", "hi", "label", "wide")).alias("ms"))

        def compare(batches):
            for b in batches:
                off, cls, bits, label, wide = _members(b.column(4), b.column(3))
                own_wide, _ = _wide(b.column(5))
                label, own_label = label[:off[-1]], label[off[-1]:]
                own = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)], 1).view(np.uint64)
                row = np.repeat(np.arange(len(own)), np.diff(off))
                near = np.bitwise_count(bits ^ own[row]).sum(axis=1, dtype=np.int16) <= far
                at = np.flatnonzero(near & (label != own_label[row]))
                at = at[_equal(wide[at], own_wide[row[at]]) >= least]
                yield pa.record_batch({"a": b.column(0).take(pa.array(row[at])), "b": cls.take(pa.array(at))})

        return _ordered(rows.join(few, "node").select("cls", "lo", "hi", "label", "ms", "wide").mapInArrow(compare, "a binary, b binary"))

    def blocks(self, live: DataFrame) -> DataFrame:
        """Each row once for every pair of blocks of its node that holds the row's block."""
        k = F.ceil(F.col("cnt") / F.lit(max(1, self.small // 2))).cast("int")
        d = live.withColumn("k", k).withColumn("j", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
        d = d.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        return d.withColumn("part", F.concat_ws("-", F.least("j", "o"), F.greatest("j", "o"))).select(*live.columns, "part")

    # -- confirmation ---------------------------------------------------------------------
    def confirm(self, pairs: DataFrame) -> DataFrame | None:
        """The linked pairs, on the full sets of the texts. Each pair is confirmed only once."""
        pairs = pairs.distinct()
        if self.seen is not None:
            pairs = pairs.join(self.seen, ["a", "b"], "left_anti")
        pairs = self.store(pairs, "pairs", self.n_live)
        n = pairs.count()
        self.seen = pairs if self.seen is None else self.seen.unionByName(pairs)
        if n == 0:
            return None
        ends = self.ends(pairs, n)
        sets = self.sets_of(ends)
        a = sets.select(F.col("cls").alias("a"), F.col("items").alias("sa"))
        b = sets.select(F.col("cls").alias("b"), F.col("items").alias("sb"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"),
                                                      F.size(F.array_intersect("sa", "sb")).alias("both"))
        return self.store(both.filter(f"100L * both >= {self.percent}L * (na + nb - both)").select("a", "b"), "links", n)

    def ends(self, pairs: DataFrame, n: int) -> DataFrame:
        """The classes of stored pairs."""
        return self.store(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct(), "ends", n)

    def of_classes(self, some: DataFrame, column: str) -> DataFrame:
        """(cls, column) of some classes: a stored table of distinct ``cls``."""
        return self.store(self.classes.select("cls", column).join(small_table(some), "cls", "left_semi"), column)

    def relabel(self, links: DataFrame | None) -> None:
        if links is None or links.isEmpty():
            return
        if self.labels is not None:
            links = links.unionByName(self.labels.select(F.col("cls").alias("a"), F.col("label").alias("b")))
        self.labels = connected_components(links).select(F.col("id").alias("cls"), F.col("root").alias("label"))

    def labelled(self, rows: DataFrame) -> DataFrame:
        rows = rows.drop("label")
        if self.labels is None:
            return rows.withColumn("label", F.col("cls"))
        return rows.join(small_table(self.labels), "cls", "left").withColumn("label", F.coalesce("label", "cls"))

    # -- the whole join -------------------------------------------------------------------
    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, kept, cls) per document row."""
        sigs = self.store(_signatures(self.docs, self.words), "signatures")
        self.classes = self.store(sigs.filter("cls is not null").groupBy("cls").agg(
            F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
        self.labels = self.seen = None
        self.repeats = not sigs.groupBy("doc_id").count().filter("count > 1").isEmpty()
        linkable = self.classes.filter("rep is not null")
        roots = [self.meet(_roots(linkable, trees, self.root_depth), self.root_depth) for trees in _passes(self.trees)]
        large = [rows for rows in roots if rows is not None]
        depth = self.root_depth
        while large:
            depth += 1
            rows = _branch(reduce(DataFrame.unionByName, large), depth - self.root_depth, self.percent / 100)
            rest = self.meet(rows, depth)
            large = [] if rest is None else [rest]
        return self.result(sigs)

    def meet(self, rows: DataFrame, depth: int) -> DataFrame | None:
        """Finds and joins the links inside the nodes of a level; returns the rows that have to branch on."""
        bottom = depth >= COORDS
        self.n_live = 1 << 60
        live = self.prune(self.labelled(rows))
        if not self.n_live:
            return None
        if depth > self.root_depth:
            return self.meet_below(live, bottom)
        self.note(live)
        wide = self.with_wide(live)
        pairs, large = self.forest_pairs(wide), not self.large(live).isEmpty()
        if large:
            pairs = pairs.unionByName(self.leader_pairs(wide))
        self.relabel(self.confirm(pairs))
        live = self.prune(self.labelled(live).filter(F.col("cnt") > min(TINY, self.small)))       # tiny nodes are done
        if not self.n_live:
            return None
        heavy = self.compare_sets(live)
        live = self.store(self.labelled(live).join(small_table(heavy), "node", "left_semi"), "heavy")
        if live.isEmpty() and not (large and bottom):
            return None
        wide = self.with_wide(live)
        self.relabel(self.confirm(self.all_pairs(wide, bottom).unionByName(self.minor_pairs(wide))))
        return self.large(wide) if large and not bottom and not self.large(live).isEmpty() else None

    def meet_below(self, live: DataFrame, bottom: bool) -> DataFrame | None:
        """``meet`` below the roots, in one step: there, most labels are joined already."""
        tiny = F.col("cnt") <= min(TINY, self.small)
        if not live.filter(~tiny & (F.col("cnt") <= self.small)).isEmpty():
            left = self.compare_sets(live.filter(~tiny)).unionByName(live.filter(tiny).select("node").distinct())
            live = self.store(self.labelled(live).join(small_table(left), "node", "left_semi"), "heavy")
        wide, large = self.with_wide(live), not self.large(live).isEmpty()
        pairs = self.all_pairs(wide, bottom).unionByName(self.minor_pairs(wide))
        if large and not bottom:
            pairs = pairs.unionByName(self.leader_pairs(wide))
        self.relabel(self.confirm(pairs))
        return self.large(wide) if large and not bottom else None

    def compare_sets(self, live: DataFrame) -> DataFrame:
        """Joins the labels that are linked inside small nodes, by the full sets; returns the nodes (node) that are
        large, or whose sets are too large for a task."""
        low = F.col("cnt") <= self.small
        some = self.store(live.filter(low).select("cls").distinct(), "open")
        sets = self.sets_of(some)
        size = sets.select("cls", F.size("items").alias("n"))
        rows = live.filter(low).select("node", "cls", "label")
        total = self.store(rows.join(size, "cls").groupBy("node").agg(F.sum("n").alias("n")), "weights")
        light = rows.join(total.filter(F.col("n") <= SET_ITEMS).select("node"), "node", "left_semi")
        percent = self.percent

        def compare(batches):
            for b in _whole_nodes(batches):
                yield _linked_forest(b, percent)

        light = light.select(F.col("node").alias("part"), "cls", "label").join(sets, "cls").select("part", "cls", "label", "items")
        links = light.repartition("part").sortWithinPartitions("part").mapInArrow(compare, "a binary, b binary")
        self.relabel(self.store(_ordered(links).distinct(), "links"))
        return self.store(live.filter(~low).select("node").distinct().unionByName(
            total.filter(F.col("n") > SET_ITEMS).select("node")), "heavy-nodes")

    def sets_of(self, some: DataFrame) -> DataFrame:
        """(cls, items) of some classes, once each: a stored table of distinct ``cls``."""
        need = self.of_classes(some, "rep").select(F.col("rep").alias("doc_id"))
        if need.count() <= BROADCAST_IDS:
            need = F.broadcast(need)
        # Rows that repeat a doc_id may give a set twice, or another one that the semi-join drops.
        sets = _sets(self.docs.join(need, "doc_id", "left_semi"), self.words).join(small_table(some), "cls", "left_semi")
        return self.store(sets.groupBy("cls").agg(F.first("items").alias("items")) if self.repeats else sets, "sets")

    def result(self, sigs: DataFrame) -> DataFrame:
        own = self.labelled(self.classes.select("cls", "rep"))
        low = self.store(own.groupBy("label").agg(F.min("rep").alias("component_id")), "lowest")
        ids = own.select("cls", "label").join(low, "label").select("cls", "component_id")
        d = sigs.select("doc_id", "n_shingles", "cls").join(ids, "cls", "left")
        d = d.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        return d.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "cls")


def _judged(docs: DataFrame, words: int = 5, percent: int = 80, trees: int = 20, root_depth: int = 3,
            small: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``near_duplicates`` with the class (equal sets) of each."""
    if not 1 <= root_depth < COORDS:
        raise ValueError("root_depth must be at least 1 and less than COORDS")
    d = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return _Join(d, words, percent, trees, root_depth, small).run()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, trees: int = 20, root_depth: int = 3,
                    small: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate components of documents by Jaccard similarity of word-shingle sets.

    Two documents link if 100 * |intersection| >= ``percent`` * |union|. Returns one row per
    document: doc_id, n_shingles, component_id (smallest id reachable by links), kept (whether
    the document stands for its component).
    """
    return _judged(docs, words, percent, trees, root_depth, small, id_col, text_col).drop("cls")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, with all its columns: the one of the smallest id, rows without an id last.

    Rows are judged one by one. Where ids are null or repeated, all rows are numbered first (in a stored copy)
    and judged by their number, so that exact and near copies go whatever their ids are; of rows that agree in
    component and id one stays, of those without an id too. Texts without words are linked with nothing and stay."""
    id_col = options.get("id_col", "doc_id")
    spark = docs.sparkSession
    base = scratch_dir(spark, "dropped")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        gone = stored(_judged(docs, **options).filter("not kept").select(F.col("doc_id").alias("dropped_id")), "gone")
        return docs.join(small_table(gone, BROADCAST_IDS), docs[id_col].cast("long") == F.col("dropped_id"), "left_anti")
    taken = {c.lower() for c in docs.columns}
    key = next(n for n in ("row_key", *(f"row_key_{i}" for i in range(len(taken) + 1))) if n not in taken)
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    judged = stored(_judged(rows, **{**options, "id_col": key}).filter("n_shingles > 0").select("doc_id", "component_id"), "judged")
    shared = judged.filter("doc_id <> component_id").select("component_id").distinct()
    members = stored(judged.join(shared, "component_id", "left_semi")
                     .join(rows.select(F.col(key).alias("doc_id"), F.col(f"`{id_col}`").cast("long").alias("own_id")), "doc_id"), "members")
    first = (members.groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull().alias("none"), "own_id", "doc_id")).alias("first"))
             .select(F.col("first.doc_id").alias("doc_id")))
    gone = stored(members.join(first, "doc_id", "left_anti").select(F.col("doc_id").alias("dropped_key")), "gone")
    return rows.join(small_table(gone, BROADCAST_IDS), rows[key] == F.col("dropped_key"), "left_anti").drop(key)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 2 THEN [ws[1]]
             ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
c AS (SELECT min(doc_id) AS rep, list_sort(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)),
x AS (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
l AS (SELECT a, b FROM p WHERE 100 * m >= 80 * (na + nb - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT rep, rep FROM c UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
k AS (SELECT id, min(c) AS comp FROM r GROUP BY id),
f AS (SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(k.comp, s.doc_id) AS component_id
      FROM s LEFT JOIN c ON list_sort(s.sh) = c.sh LEFT JOIN k ON k.id = c.rep)
SELECT doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM f
"""
