"""Operator 5: hierarchical packing of documents into windows of several lengths.

Each document's ids and its end id are routed to the smallest tier (TIERS) that
holds them; longer documents first fill whole windows of the largest tier.  From the
longest tier down, every piece opens a window of its tier, whose gap takes the
longest shorter pieces that fit and at last the head of one more, so windows are
full.  What a task has left is carried to its next slice and, at its end, cut at
powers of two; so nothing is padded.  Windows of one tier wait until GROUPS step groups
of GROUP_TOKENS tokens are full and are dealt to them in serpentine order of attention
work (sum of squared piece lengths), so a step's groups cost alike.  Only the end of a task
has smaller groups: at most GROUPS a tier, and one for its last pieces.

A task packs its own rows (no shuffle), in slices of bounded size.  Null and empty
texts are one token, the end id.  Very long texts fill whole windows.  Null doc_ids and
repeated rows are packed like any other row; pieces of equal length are taken last in,
first out.  An empty table gives none.  Other columns are ignored, whatever their names.
sequence_id and step_group are unique over all tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from marginalia.llm import textkernel as tk
from marginalia.llm.encoding import SLICE_BYTES, worker_encoder

TIERS = (4096, 2048, 1024, 512, 256)
GROUP_TOKENS = 8 * 4096
#: Step groups of a tier that are filled together.
GROUPS = 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

Piece = tuple  # (doc_id, start, ids, doc_tokens)
Window = tuple  # (tier, pieces)


class Pool:
    """Pieces by length, with the longest that fits a gap found by one bit scan."""

    def __init__(self) -> None:
        self.by_length: dict[int, list[Piece]] = {}
        self.mask = 0

    def add(self, piece: Piece) -> None:
        n = len(piece[2])
        self.by_length.setdefault(n, []).append(piece)
        self.mask |= 1 << n

    def longest(self, most: int) -> Piece | None:
        n = (self.mask & ((2 << most) - 1)).bit_length() - 1
        if n < 1:
            return None
        piece = self.by_length[n].pop()
        if not self.by_length[n]:
            self.mask ^= 1 << n
        return piece

    def shortest(self) -> Piece | None:
        if not self.mask:
            return None
        return self.longest((self.mask & -self.mask).bit_length() - 1)


def cut(piece: Piece, at: int) -> tuple[Piece, Piece]:
    doc_id, start, ids, total = piece
    return (doc_id, start, ids[:at], total), (doc_id, start + at, ids[at:], total)


def pack(pool: Pool, tiers: tuple[int, ...] = TIERS) -> tuple[list[Window], list[Piece]]:
    """Full windows from all pieces of the pool, and the pieces of at most one unfilled window."""
    windows: list[Window] = []
    while (piece := pool.longest(tiers[0])) is not None:
        tier = min(t for t in tiers if t >= len(piece[2]))
        held, gap = [piece], tier - len(piece[2])
        while gap:
            piece = pool.longest(gap)
            if piece is None:  # every piece left is longer than the gap
                piece = pool.shortest()
                if piece is None:
                    return windows, held
                piece, rest = cut(piece, gap)
                pool.add(rest)
            held.append(piece)
            gap -= len(piece[2])
        windows.append((tier, held))
    return windows, []


def powers(pieces: list[Piece]) -> list[Window]:
    """The last pieces of a task as full windows whose lengths are powers of two."""
    left, out = sum(len(p[2]) for p in pieces), []
    pieces = pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        held, gap = [], size
        while gap:
            piece = pieces.pop()
            if len(piece[2]) > gap:
                piece, rest = cut(piece, gap)
                pieces.append(rest)
            held.append(piece)
            gap -= len(piece[2])
        out.append((size, held))
        left -= size
    return out


def serpentine(work: list[int], groups: int) -> list[int]:
    """A group for each window: by falling work, dealt there and back, so groups differ by one window at most."""
    out = [0] * len(work)
    for place, i in enumerate(sorted(range(len(work)), key=lambda i: -work[i])):
        turn, col = divmod(place, groups)
        out[i] = col if turn % 2 == 0 else groups - 1 - col
    return out


class StepGroups:
    """Windows of a task wait by tier until GROUPS whole step groups can be balanced over them."""

    def __init__(self) -> None:
        self.waiting: dict[int, list[Window]] = {}
        self.used = 0

    def add(self, windows: list[Window]) -> Iterator[tuple[Window, int]]:
        """The given windows join; (window, group) of those that now make up whole groups."""
        for window in windows:
            tier = window[0]
            held = self.waiting.setdefault(tier, [])
            held.append(window)
            if len(held) == GROUPS * max(1, GROUP_TOKENS // tier):
                yield from self._dealt(held, GROUPS)
                self.waiting[tier] = []

    def rest(self, last: list[Window]) -> Iterator[tuple[Window, int]]:
        """What waits, in as few groups as hold it; ``last``, the task's unfilled end, is one group."""
        for tier, held in self.waiting.items():
            if held:
                yield from self._dealt(held, -(-len(held) // max(1, GROUP_TOKENS // tier)))
        self.waiting = {}
        if last:
            yield from self._dealt(last, 1)

    def _dealt(self, windows: list[Window], groups: int) -> Iterator[tuple[Window, int]]:
        own = serpentine([sum(len(p[2]) ** 2 for p in pieces) for _, pieces in windows], groups)
        yield from zip(windows, (self.used + g for g in own), strict=True)
        self.used += groups


def packed(documents: DataFrame, tokenizer_path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece, with its window and step group; ``with_ids`` adds the ids (uint32 LE)."""
    columns = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].cast("string").alias("text"))
    largest = tiers[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path)
        task = TaskContext.get().partitionId() << 36
        n_windows, groups = 0, StepGroups()
        left: list[Piece] = []

        def rows(windows: Iterator[tuple[Window, int]]) -> pa.RecordBatch:
            nonlocal n_windows
            out: list[list] = [[] for _ in range(9 + with_ids)]
            for (tier, pieces), group in windows:
                offset = 0
                for doc_id, start, ids, total in pieces:
                    raw = ids.astype("<u4").tobytes()
                    row = [doc_id, start, len(ids), zlib.crc32(raw), total, task + n_windows, offset, tier, task + group]
                    for column, value in zip(out, [*row, raw] if with_ids else row, strict=True):
                        column.append(value)
                    offset += len(ids)
                n_windows += 1
            kinds = [*[pa.int64()] * 7, pa.int32(), pa.int64(), *[pa.binary()] * with_ids]
            names = [c.split()[0] for c in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

        for batch in batches:
            doc_ids, texts = tk.take_columns(batch, ["doc_id", "text"])
            doc_ids = doc_ids.to_pylist()
            for part in tk.slices(texts, SLICE_BYTES):
                ids, lengths = encoder.encode_with_end(part, end_id)
                pool, windows = Pool(), []
                for piece in left:
                    pool.add(piece)
                ends = np.cumsum(lengths).tolist()
                for k, end in enumerate(ends):
                    own = ids[end - int(lengths[k]) : end].copy()
                    whole = len(own) // largest * largest
                    for at in range(0, whole, largest):
                        windows.append((largest, [(doc_ids[part.lo + k], at, own[at : at + largest], len(own))]))
                    if len(own) > whole:
                        pool.add((doc_ids[part.lo + k], whole, own[whole:], len(own)))
                more, left = pack(pool, tiers)
                windows += more
                yield rows(groups.add(windows))
        yield rows(groups.rest(powers(left)))

    schema = SCHEMA + (", ids binary" if with_ids else "")
    return columns.mapInArrow(tk.task("packing", run), schema)
