"""Operator 8: token counts by rank-synchronous array merging.

Texts are cut into pre-tokens: a space that follows another character opens one, as
no piece of the vocabulary joins a character to a following space.  The distinct
pre-tokens of a slice lie in ragged numpy arrays (one flat symbol array and a
sequence id per symbol).  Each round finds every sequence's lowest-rank adjacent
pair and merges it in all sequences at once; the symbols that survive are counted,
a symbol outside the vocabulary as its UTF-8 bytes (byte fallback).

A pair's occurrences inside one sequence merge together, leftmost first, unless the
rank is shared by several pieces or a product could outrank its parts; then one
occurrence merges a round.  Both follow the order in which a queue of best pairs
with leftmost ties would run.

Null and empty texts have 0 bytes and 0 tokens.  Rows are kept as they come, with
repeated rows counted each; other columns of the input are ignored.  Long texts are read
whole.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm import textkernel as tk

MAX_TOKENS = 4096
#: Entries of a task's memo of pre-token counts; it is emptied when full.
MEMO_ENTRIES = 400_000
SPACE = 0x2581
_NONE = np.iinfo(np.int32).max


class PieceMerger:
    """Merge tables of a sentencepiece BPE model, and counting by rounds."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not special(i)}
        scores = {i: model.get_score(i) for i in pieces.values()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = {i: order[s] for i, s in scores.items()}
        symbol = dict(pieces)
        for piece in pieces:
            for ch in piece:
                symbol.setdefault(ch, len(symbol) + model.get_piece_size())
        self.radix = 2 * max(symbol.values()) + 4
        self.char_symbol = np.full(0x110000, -1, dtype=np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.char_symbol[ord(s)] = i
        self.known = np.zeros(self.radix, dtype=bool)
        self.known[list(pieces.values())] = True
        keys, ranks, products = [], [], []
        shared = np.bincount(list(rank.values()), minlength=len(order)) > 1
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                left, right = symbol.get(piece[:cut]), symbol.get(piece[cut:])
                if left is None or right is None:
                    continue
                keys.append(left * self.radix + right)
                ranks.append(rank[i])
                products.append(i)
                for part, text in ((left, piece[:cut]), (right, piece[cut:])):
                    if len(text) > 1 and rank[part] >= rank[i]:
                        shared[rank[part]] = True
        by = np.argsort(keys)
        self.keys = np.array(keys, dtype=np.int64)[by]
        self.ranks = np.array(ranks, dtype=np.int32)[by]
        self.products = np.array(products, dtype=np.int32)[by]
        #: Ranks of which one occurrence a round may merge.
        self.stepwise = shared

    def count(self, codepoints: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Surviving symbols of each sequence of code points."""
        n = len(lengths)
        seq = np.repeat(np.arange(n, dtype=np.int64), lengths)
        sym = self.char_symbol[codepoints].astype(np.int64)
        width = 1 + (codepoints >= 0x80) + (codepoints >= 0x800) + (codepoints >= 0x10000)
        outside = sym < 0
        total = np.bincount(seq[outside], weights=width[outside], minlength=n).astype(np.int64)
        sym[outside] = self.radix - 1
        char_bytes = np.where(outside, 0, width)
        while len(sym) > 1:
            key = sym[:-1] * self.radix + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (seq[:-1] == seq[1:])
            rank = np.where(hit, self.ranks[at], _NONE)
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            lengths = np.diff(np.concatenate((first, [len(sym)])))
            best = np.minimum.reduceat(np.concatenate((rank, [_NONE])), first)
            live = best != _NONE
            if not live.all():
                alive = np.repeat(live, lengths)
                total += self._survivors(seq[~alive], sym[~alive], char_bytes[~alive], n)
                # the rank at a live sequence's last symbol is _NONE, so filtering keeps pairs aligned
                rank = np.concatenate((rank, [_NONE]))[alive][:-1]
                at = np.concatenate((at, [0]))[alive][:-1]
                seq, sym, char_bytes = seq[alive], sym[alive], char_bytes[alive]
                best, lengths = best[live], lengths[live]
                if not len(sym):
                    return total
            low = np.repeat(best, lengths)[: len(rank)]
            chosen = np.flatnonzero((rank == low) & (rank != _NONE))
            step = self.stepwise[rank[chosen]]
            if step.any():
                leftmost = np.ones(len(chosen), dtype=bool)
                leftmost[1:] = seq[chosen[1:]] != seq[chosen[:-1]]
                chosen = chosen[~step | leftmost]
            run = np.concatenate(([True], np.diff(chosen) != 1))
            start = np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - start) % 2 == 0]
            sym[chosen] = self.products[at[chosen]]
            char_bytes[chosen] = 0
            keep = np.ones(len(sym), dtype=bool)
            keep[chosen + 1] = False
            seq, sym, char_bytes = seq[keep], sym[keep], char_bytes[keep]
        return total + self._survivors(seq, sym, char_bytes, n)

    def _survivors(self, seq: np.ndarray, sym: np.ndarray, char_bytes: np.ndarray, n: int) -> np.ndarray:
        weight = np.where(self.known[sym], 1, char_bytes)
        return np.bincount(seq, weights=weight, minlength=n).astype(np.int64)


def pretokens(part: tk.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a space before each text, starts, ends, document) of the pre-tokens."""
    lengths = part.text_lengths()
    doc = np.repeat(np.arange(part.size), lengths)
    data = np.full(len(part.data) + part.size, 0x20, dtype=np.uint8)
    data[np.arange(len(part.data)) + doc + 1] = part.data
    offsets = part.offsets + np.arange(part.size + 1)
    opens = data == 0x20
    opens[1:] &= data[:-1] != 0x20
    for end in np.flatnonzero(data == 0xE2):  # a written U+2581 counts as a space
        if data[end : end + 4].tobytes() == b"\xe2\x96\x81 ":
            opens[end + 3] = False
    opens[offsets[:-1]] = True
    starts = np.flatnonzero(opens)
    ends = np.concatenate((starts[1:], [len(data)]))
    owner = tk.owner(offsets, starts)
    real = lengths[owner] > 0
    return data, starts[real], ends[real], owner[real]


def count_slice(part: tk.Slice, merger: PieceMerger, memo: dict[int, int]) -> np.ndarray:
    """Tokens of each document of a slice."""
    data, starts, ends, doc = pretokens(part)
    if not len(starts):
        return np.zeros(part.size, dtype=np.int64)
    code, distinct = pd.factorize(tk.span_hashes(data, starts, ends))
    known = np.fromiter((memo.get(h, -1) for h in distinct.tolist()), dtype=np.int64, count=len(distinct))
    fresh = np.flatnonzero(known < 0)
    if len(fresh):
        seen = np.zeros(len(distinct), dtype=np.int64)
        seen[code[::-1]] = np.arange(len(code))[::-1]  # the first place of each
        at = seen[fresh]
        lengths = ends[at] - starts[at]
        flat = data[tk.ragged_gather(starts[at], lengths)]
        head = (flat & 0xC0) != 0x80
        points = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        points[points == 0x20] = SPACE
        chars = np.add.reduceat(head.astype(np.int64), np.concatenate(([0], np.cumsum(lengths)[:-1])))
        known[fresh] = merger.count(points, chars)
        if len(memo) + len(fresh) > MEMO_ENTRIES:
            memo.clear()
        memo.update(zip(distinct[fresh].tolist(), known[fresh].tolist(), strict=True))
    return np.bincount(doc, weights=known[code], minlength=part.size).astype(np.int64)


def token_counts(documents: DataFrame, model_path: str, max_tokens: int = MAX_TOKENS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text; no shuffle."""
    columns = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, memo = PieceMerger(model_path), {}
        for batch in batches:
            ids, texts = tk.take_columns(batch, ["doc_id", "text"])
            tokens, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for part in tk.slices(texts):
                tokens.append(count_slice(part, merger, memo))
                sizes.append(part.text_lengths())
            n_tokens = np.concatenate(tokens)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.concatenate(sizes)), pa.array(n_tokens), pa.array(n_tokens > max_tokens)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return columns.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
