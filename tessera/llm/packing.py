"""Packing of token sequences by vector bin packing.

Every sequence has three limits at once: tokens, segments, and loss-bearing
tokens.  A piece is a vector (tokens, 1, loss tokens) and a sequence a vector of
what is left, both in units of the limits.  The dot-product heuristic places,
of the waiting pieces that fit, the one whose vector has the largest dot product
with what is left: pieces that use most of the plentiful limits.  Where none
fits, the longest waiting piece is cut to fill the sequence.

Sequences are ``length`` tokens long, or a power of two when a limit or the end
of a partition closes them early; what exceeds the power of two goes back to
wait.  Such a sequence needs no padding.

Each input partition is packed by itself, reading on while fewer than ``wait``
pieces wait, so memory is bounded by ``wait`` examples; a partition leaves at
most a few short sequences.  ``sequence_id`` holds the partition in its upper
bits, so it is unique and a repeated task gives the same ids.

Cases: a null or empty text is the end id alone; a null id is kept; repeated
rows are examples of their own; an empty table gives no pieces; long texts are
cut; ``loss_col`` null or absent makes every token loss-bearing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens as tok

LENGTH = 2048
SEGMENTS = 256
WAIT = 512
END_ID = 1


@dataclass
class Piece:
    """Tokens ``start`` to ``start + tokens`` of an example; the first
    ``plain`` of an example's tokens bear no loss."""

    example: object
    start: int
    tokens: int
    plain: int

    def loss(self, head: int | None = None) -> int:
        end = self.start + (self.tokens if head is None else head)
        return max(0, end - max(self.start, self.plain))


class Packer:
    """Places pieces one sequence at a time; ``place`` yields full sequences as
    lists of pieces in order."""

    def __init__(self, length: int, segments: int, loss: int, wait: int):
        self.limits = np.array([length, segments, loss], float)
        self.length, self.segments, self.loss, self.wait = length, segments, loss, wait
        self.size = np.zeros((1024, 3))
        self.pieces: list[Piece] = []

    def add(self, piece: Piece) -> None:
        n = len(self.pieces)
        if n == len(self.size):
            self.size = np.vstack([self.size, np.zeros_like(self.size)])
        self.size[n] = piece.tokens, 1, piece.loss()
        self.pieces.append(piece)

    def _take(self, i: int) -> Piece:
        piece, last = self.pieces[i], self.pieces.pop()
        if i < len(self.pieces):
            self.pieces[i] = last
            self.size[i] = self.size[len(self.pieces)]
        return piece

    def _best(self, left: np.ndarray) -> int:
        size = self.size[: len(self.pieces)]
        fits = (size <= left).all(axis=1)
        if not fits.any():
            return -1
        return int(np.argmax(np.where(fits, (size / self.limits) @ (left / self.limits), -1.0)))

    def _head(self, piece: Piece, left: np.ndarray) -> int:
        """The most tokens of the piece that the sequence takes."""
        n = min(piece.tokens, int(left[0]))
        free = max(0, piece.plain - piece.start)
        return min(n, free + int(left[2]))

    def _sequence(self) -> list[Piece]:
        out: list[Piece] = []
        left = self.limits.copy()
        while self.pieces and left[0] > 0 and left[1] > 0:
            i = self._best(left)
            if i < 0:
                i = int(np.argmax(self.size[: len(self.pieces), 0]))
                head = self._head(self.pieces[i], left)
                if head <= 0:
                    break
                piece = self._take(i)
                self.add(Piece(piece.example, piece.start + head, piece.tokens - head, piece.plain))
                piece = Piece(piece.example, piece.start, head, piece.plain)
            else:
                piece = self._take(i)
            out.append(piece)
            left -= (piece.tokens, 1, piece.loss())
        total = int(self.limits[0] - left[0])
        if total and total != self.length:  # close at a power of two
            extra = total - (1 << (total.bit_length() - 1))
            while extra:
                piece = out.pop()
                back = min(extra, piece.tokens)
                self.add(Piece(piece.example, piece.start + piece.tokens - back, back, piece.plain))
                if back < piece.tokens:
                    out.append(Piece(piece.example, piece.start, piece.tokens - back, piece.plain))
                extra -= back
        return out

    def place(self, end: bool = False) -> Iterator[list[Piece]]:
        while len(self.pieces) > (0 if end else self.wait):
            got = self._sequence()
            if not got:
                raise ValueError("a limit is too small for any token")
            yield got


def pack_examples(examples: Iterable[tuple[object, int, int]], length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, wait: int = WAIT) -> Iterator[list[Piece]]:
    """Sequences of (example, tokens, tokens without loss at the front)."""
    packer = Packer(length, segments, loss or length, wait)
    for example, n, plain in examples:
        packer.add(Piece(example, 0, n, plain))
        yield from packer.place()
    yield from packer.place(end=True)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, loss_col: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, wait: int = WAIT) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian 32-bit ids),
    doc_tokens, loss_tokens, sequence_id, offset.

    ``loss_col`` counts the tokens at an example's front that bear no loss (the
    prompt of an instruction)."""
    path = tokenizer or tok.default_path()
    plain = F.coalesce(docs[loss_col].cast("int"), F.lit(0)) if loss_col else F.lit(0)
    rows = docs.select(docs[id_col].alias(id_col), F.coalesce(docs[text_col].cast("string"), F.lit("")), plain)
    names = [id_col, "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"]
    kinds = [rows.schema[id_col].dataType, T.LongType(), T.LongType(), T.BinaryType(), T.LongType(), T.LongType(), T.LongType(), T.LongType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])

    def run(batches):
        encode = tok.encoder(path).encode
        first = TaskContext.get().partitionId() << 40
        id_type = None

        def examples():
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                for x, text, skip in zip(batch.column(0), batch.column(1), batch.column(2)):
                    ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                    yield (x.as_py(), ids), len(ids), min(skip.as_py(), len(ids))

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [id_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4])], names=names)

        out: list[tuple] = []
        for n, sequence in enumerate(pack_examples(examples(), length, segments, loss, wait)):
            offset = 0
            for p in sequence:
                key, ids = p.example
                out.append((key, p.start, p.tokens, ids[p.start : p.start + p.tokens].tobytes(), len(ids), p.loss(), first + n, offset))
                offset += p.tokens
            if len(out) >= 2000:
                yield table(out)
                out = []
        if out:
            yield table(out)

    return rows.mapInArrow(run, schema)
