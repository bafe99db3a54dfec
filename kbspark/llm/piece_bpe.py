"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

A SentencePiece BPE model merges the adjacent pair whose joint piece scores highest (leftmost of
equals) until none is left. Two facts make a left-to-right encoder exact:

* a sequence of pieces is the encoding of its text if and only if every two adjacent pieces are
  *compatible*, that is, merging the characters of just these two gives the two again;
* so one may take the longest piece at each position (Aho-Corasick), step to shorter ones while
  the neighbours are incompatible, and go back one piece when none is left. A bitfield of failed
  positions keeps the search linear: no position is tried again from another side.

Texts are first cut where no piece can reach across (before a run of spaces, and around
characters that occur in no longer piece), so recurring segments are encoded once per worker and
then found in a bounded table.

Scale: one narrow pass in Arrow batches, no shuffle; per worker the model, two bounded memo
tables and one text at a time (cut in segments lazily). Results do not depend on the memo tables.

Defined cases: null and empty texts encode to begin and end ids only; characters without a piece
become byte pieces; repeated rows and null ids give a result row each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bounds of the two memo tables of a worker (entries); at a bound a table starts anew.
MAX_SEGMENTS, MAX_PAIRS = 300_000, 500_000
#: Longer segments are encoded but not remembered.
MAX_REMEMBERED = 64


class PieceBpe:
    """Encoder and decoder of one SentencePiece BPE model file (identity normaliser)."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(model_path, "rb") as f:
            m.ParseFromString(f.read())
        norm = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models with the identity normaliser are supported")
        if any(p.type in (USER_DEFINED, UNUSED) for p in m.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.dummy_prefix = norm.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.pieces = [p.piece for p in m.pieces]
        self.types = [p.type for p in m.pieces]
        self.scores = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        self.unk = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
        byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.byte_ids = [byte_ids[i] for i in range(256)] if len(byte_ids) == 256 else None
        self.bos = self.pieces.index("<s>")
        self.eos = self.pieces.index("</s>")
        #: What an id adds to the decoded bytes; unknown pieces have a fixed surface.
        self.surface = [b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE
                        else m.trainer_spec.unk_surface.encode() if t == UNKNOWN
                        else p.replace(SPACE, " ").encode() for p, t in zip(self.pieces, self.types)]

        # Pieces that merging never reaches as a text of their own cannot occur in an encoding.
        whole = [p for p in self.ids if len(p) == 1 or self._merged(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in whole:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        #: The next shorter piece that a piece starts with.
        self.shorter: dict[str, str] = {}
        known = set(whole)
        for p in whole:
            n = next((n for n in range(len(p) - 1, 0, -1) if p[:n] in known), 0)
            if n:
                self.shorter[p] = p[:n]
        inner = {SPACE, *(c for p in self.ids if len(p) > 1 for c in p)}
        # A piece holds spaces only at its front (checked), so a run of spaces starts a segment.
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("pieces with inner spaces are not supported")
        # Characters of no longer piece (line ends, most rare characters) stand alone.
        word = "".join(re.escape(c) for c in sorted(inner - {SPACE}))
        self.segments = re.compile(f"{SPACE}*[{word}]+|{SPACE}+|(?s:.)")
        self._pairs: dict[tuple[str, str], bool] = {}
        self._seen: dict[str, tuple[bytes, int]] = {}

    # -- compatibility of neighbours ------------------------------------------------------
    def _merged(self, text: str) -> list[str]:
        """What merging makes of a short text: best score first, leftmost of equals."""
        parts, score = list(text), self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of ``left + right`` gives just these two pieces."""
        ok = self._pairs.get((left, right))
        if ok is None:
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            ok = self._pairs[left, right] = self._merged(left + right) == [left, right]
        return ok

    # -- encoding -------------------------------------------------------------------------
    def _pieces_of(self, seg: str) -> list[str]:
        """The pieces of a segment; a character without a piece is a piece of its own."""
        n = len(seg)
        longest = [1] * n
        for last, size in self.automaton.iter(seg):
            longest[last + 1 - size] = size        # ends ascend, so the longest comes last
        if longest[0] == n:
            return [seg]
        pairs, compatible, shorter = self._pairs, self.compatible, self.shorter
        failed = bytearray(n + 1)                  # positions from which no valid rest was found
        out: list[str] = []
        pos, piece = 0, seg[:longest[0]]
        while True:
            end = pos + len(piece)
            if not failed[end] and (not out or (pairs.get((out[-1], piece)) or compatible(out[-1], piece))):
                out.append(piece)
                if end == n:
                    return out
                pos = end
                piece = seg[pos:pos + longest[pos]]
                continue
            piece = shorter.get(piece)
            while piece is None:                   # nothing fits here: the piece before is wrong
                failed[pos] = 1
                piece = out.pop()
                pos -= len(piece)
                piece = shorter.get(piece)

    def _segment(self, seg: str) -> tuple[bytes, int]:
        ids = array("I")
        for p in self._pieces_of(seg):
            i = self.ids.get(p)
            if i is not None:
                ids.append(i)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in p.encode())
            else:
                ids.append(self.unk)
        found = (ids.tobytes(), len(ids))
        if len(seg) <= MAX_REMEMBERED:
            if len(self._seen) >= MAX_SEGMENTS:
                self._seen.clear()
            self._seen[seg] = found
        return found

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids (with begin and end ids) as unsigned 32-bit integers in machine order."""
        out = [array("I", [self.bos]).tobytes()]
        if text:
            text = text.replace(" ", SPACE)
            seen, segment = self._seen.get, self._segment
            for seg in self.segments.findall(SPACE + text if self.dummy_prefix else text):
                out.append((seen(seg) or segment(seg))[0])
        out.append(array("I", [self.eos]).tobytes())
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return array("I", self.encode_bytes(text)).tolist()

    # -- decoding -------------------------------------------------------------------------
    def decode(self, ids) -> str:
        """Text of a list of ids: control ids vanish, the dummy prefix goes, byte pieces join to
        characters (a byte that is part of none becomes U+FFFD)."""
        ids = list(ids)
        surface, types = self.surface, self.types
        raw = b"".join(map(surface.__getitem__, ids))
        first = next((i for i in ids if types[i] != CONTROL), None)
        if self.dummy_prefix and first is not None and types[first] == NORMAL and self.pieces[first][0] == SPACE:
            raw = raw[1:]
            strip = True
        else:
            strip = False
        # A control id between two byte pieces parts them, so only inner ones need the slow way.
        if not any(types[i] == CONTROL for i in set(ids[1:-1])):
            try:
                return raw.decode()
            except UnicodeDecodeError:
                pass
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and types[i] == BYTE:
                run += surface[i]
                continue
            out.append(_bytes_text(bytes(run)))
            run.clear()
            if i is not None:
                out.append(surface[i].decode())
        return "".join(out)[1 if strip else 0:]


def _bytes_text(run: bytes) -> str:
    """UTF-8 text of a run of byte pieces; every byte outside a valid character is one U+FFFD."""
    out, k = [], 0
    while k < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[k:k + size].decode())
                k += size
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            k += 1
    return "".join(out)


_MODELS: dict[str, PieceBpe] = {}


def load(model_path: str) -> PieceBpe:
    """The model of a path, read once per process."""
    if model_path not in _MODELS:
        _MODELS[model_path] = PieceBpe(model_path)
    return _MODELS[model_path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text. The model file must be readable
    at ``model_path`` on every executor."""
    def run(batches):
        bpe = load(model_path)
        for b in batches:
            ids = [array("I", bpe.encode_bytes(t)) for t in _texts(b.column(1))]
            yield pa.record_batch({"id": b.column(0), "ids": pa.array([i.tolist() for i in ids], pa.list_(pa.int32())),
                                   "decoded": pa.array([bpe.decode(i) for i in ids], pa.string())})

    return docs.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text").mapInArrow(
        run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, round_trip) per document, without keeping the ids."""
    def run(batches):
        bpe = load(model_path)
        for b in batches:
            rows = []
            for t in _texts(b.column(1)):
                ids = array("I", bpe.encode_bytes(t))
                decoded = bpe.decode(ids)
                if ids.itemsize != 4:
                    raise TypeError("array('I') must hold 32-bit integers")
                raw = ids.tobytes() if _LITTLE else _swapped(ids)
                rows.append((len(ids), hashlib.sha256(raw).hexdigest(),
                             hashlib.sha256(decoded.encode("utf-8")).hexdigest(), decoded == (t or "").replace(SPACE, " ")))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.record_batch({"id": b.column(0), "n_tokens": pa.array(cols[0], pa.int64()), "ids_sha256": pa.array(cols[1], pa.string()),
                                   "decoded_sha256": pa.array(cols[2], pa.string()), "round_trip": pa.array(cols[3], pa.bool_())})

    return docs.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text").mapInArrow(
        run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean").withColumnRenamed("id", id_col)


def _texts(column):
    """One text at a time, so that a batch of long texts is not held twice."""
    return (v.as_py() for v in column)


_LITTLE = sys.byteorder == "little"


def _swapped(ids: array) -> bytes:
    other = array("I", ids)
    other.byteswap()
    return other.tobytes()
