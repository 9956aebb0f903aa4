"""Whole texts to token ids with the tokenizers library, each distinct chunk once.

A text is cut where the pre-tokenizers of KNOWN always break (a tokenizer with any other one
encodes whole texts): at an
ASCII space after a character other than white space, at one of ``.,!#$%&*`` after a
letter, at a newline after such a character, and after a lone newline that a letter
follows.  The ids of a text are then the ids of its chunks in order.  The library
encodes each distinct chunk that a worker does not remember; the rest is array
gathering.  Most chunks are a blank and letters of ASCII or Latin-1: the library gets
thousands of these words as one text, and their ids are told apart by the mark that the
vocabulary puts on a word's first or last piece.  Where the tokenizer lower-cases and
drops blanks, words are remembered without either, and not normalized again.  A worker
remembers two generations of MEMO_ENTRIES chunks: when the young one is full it becomes
the old one, and what is used again moves up."""

from __future__ import annotations

import json
import os
import string
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd

from marginalia.llm import textkernel as tk

#: Distinct chunks of each of the two generations that a worker remembers.
MEMO_ENTRIES = 400_000
#: Text that a task encodes at once, and chunks in one call of the library.
SLICE_BYTES = 1 << 20
CALL_CHUNKS = 8192
#: Longer chunks are no words, so a text of CALL_CHUNKS words stays small.
WORD_BYTES = 1024


#: Pre-tokenizers and normalizers (as tokenizer files spell them) for which texts may be cut into chunks.
KNOWN = (
    ({"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, None),
    (
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    ),
)

_SILENT = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
#: The code point by which ByteLevel spells a byte: those that Latin-1 does not print are 256 and on, in their order.
_SPELT = np.arange(256, dtype="<u4")
_SPELT[_SILENT] = 256 + np.arange(len(_SILENT))
_STOP = np.zeros(256, bool)
_STOP[list(b".,!#$%&*")] = True


def letters(data: np.ndarray) -> np.ndarray:
    """True for the bytes of ASCII and Latin-1 letters."""
    found = (data | 0x20) - np.uint8(97) < 26
    wide = np.flatnonzero(data[:-1] == 0xC3)
    wide = wide[(data[wide + 1] != 0x97) & (data[wide + 1] != 0xB7)]
    found[wide] = found[wide + 1] = True
    return found


def chunk_starts(part: tk.Slice, letter: np.ndarray) -> np.ndarray:
    """Byte positions of the chunk starts of a slice whose ``letters`` are given."""
    data = part.data
    opens = np.zeros(len(data), bool)
    at = np.flatnonzero(data == 0x20)
    before = data[np.maximum(at - 1, 0)]
    keep = (before > 0x20) & (before != 0x7F)
    wide = np.flatnonzero(before >= 0x80)
    if len(wide):
        b1, b2, b3 = (data[np.maximum(at[wide] - k, 0)] for k in (1, 2, 3))
        blank = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
        blank |= (b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80)
        blank |= (b3 == 0xE2) & (b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF))
        blank |= (b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F)
        blank |= (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80)
        keep[wide[blank]] = False
    opens[at[keep]] = True
    at = np.flatnonzero(~letter & (data != 0x20))
    at = at[at > 0]
    here, before = data[at], data[at - 1]
    opens[at[_STOP[here] & letter[at - 1]]] = True
    newline = at[(here == 0x0A) & (before > 0x20) & (before < 0x7F)]
    opens[newline] = True
    newline = newline[newline < len(data) - 1] + 1
    opens[newline[letter[newline]]] = True
    first = part.offsets[:-1]
    opens[first[first < len(data)]] = True
    return np.flatnonzero(opens)


def word_chunks(data: np.ndarray, letter: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each chunk: whether it is a word (letters alone, after one space at most); whether it begins with a space."""
    others = np.cumsum(~letter, dtype=np.int32)
    blank = data[starts] == 0x20
    size = ends - starts
    return (others[ends - 1] == others[starts]) & (letter[starts] | blank) & (size > blank) & (size <= WORD_BYTES), blank


def folded(data: np.ndarray, starts: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The text with the words among its chunks in lower case (letters of ASCII and Latin-1, which lower-case one by one)."""
    wide = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    upper = np.concatenate((np.flatnonzero(data - np.uint8(65) < 26), wide))
    out = data.copy()
    out[upper[word[np.searchsorted(starts, upper, side="right") - 1]]] += 0x20
    return out


class _Words:
    """The library's ids of many words (letters of ASCII and Latin-1), as ByteLevel spells them, from one text of them.

    ``folds``: the tokenizer lower-cases words and drops blanks, and marks a word's last
    piece; otherwise it keeps the space before a word, with which its first piece begins."""

    def __init__(self, tokenizer, folds: bool, mark: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.folds = folds
        self.tokenizer = Tokenizer(tokenizer.model)  # shares the vocabulary
        self.tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.marked = np.zeros(max(vocabulary.values()) + 1, bool)
        self.marked[[i for token, i in vocabulary.items() if (token.endswith(mark) if folds else token.startswith(mark))]] = True

    @staticmethod
    def of(tokenizer, spec: dict) -> _Words | None:
        """None if the tokenizer is not of KNOWN, or may leave out or not mark a byte of a letter."""
        model, pieces = spec["model"], (spec["pre_tokenizer"], spec["normalizer"])
        if pieces not in KNOWN or model["type"] != "BPE" or model["dropout"] or model["continuing_subword_prefix"]:
            return None
        folds, suffix = pieces == KNOWN[1], model["end_of_word_suffix"] or ""
        blank, *used = (chr(_SPELT[b]) for b in (0x20, 0xC3, *range(0x80, 0xC0), *string.ascii_letters.encode()))
        if folds != bool(suffix) or not model["vocab"].keys() >= {blank, *used, *(c + suffix for c in used)}:
            return None
        return _Words(tokenizer, folds, suffix or blank)

    def keys(self, data: np.ndarray, letter: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text and the chunk starts by which chunks are remembered; which chunks are words."""
        word, blank = word_chunks(data, letter, starts, ends)
        if not self.folds:
            return data, starts, word & blank
        return folded(data, starts, word), starts + (word & blank), word

    def call(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of words, given by ``keys``."""
        lengths = ends - starts + 1
        text = _SPELT[data[tk.ragged_gather(starts - 1, lengths)]]
        text[np.cumsum(lengths) - lengths] = 0x20
        ids = np.array(self.tokenizer.encode_batch_fast([text.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, np.int32)
        edges = np.flatnonzero(self.marked[ids])
        if len(edges) != len(starts):
            raise ValueError(f"{len(starts)} words have {len(edges)} marked pieces")
        return (np.diff(edges, prepend=-1) if self.folds else np.diff(edges, append=len(ids))), ids


class _Pool:
    """Ids of remembered chunks in one flat array, found by binary search among sorted hashes."""

    def __init__(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each chunk, -1 if unknown."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        by = np.argsort(hashes)
        hashes = hashes[by]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        out = np.empty(len(hashes), np.int64)
        out[by] = np.where(self.hashes[at] == hashes, self.place[at], -1)
        return out

    def add(self, hashes: np.ndarray, length: np.ndarray, flat: np.ndarray) -> np.ndarray:
        where = np.arange(len(self.start), len(self.start) + len(hashes))
        by = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[by])
        self.hashes, self.place = np.insert(self.hashes, at, hashes[by]), np.insert(self.place, at, where[by])
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length.astype(np.int32)))
        self.flat = np.concatenate((self.flat, flat))
        return where

    def ids(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = self.length[where].astype(np.int64)
        return length, self.flat[tk.ragged_gather(self.start[where], length)]


class ChunkEncoder:
    """Encodes slices with one tokenizer file."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        spec = json.loads(self.tokenizer.to_str())
        self.chunked = (spec["pre_tokenizer"], spec["normalizer"]) in KNOWN
        self.words = _Words.of(self.tokenizer, spec)
        self.young, self.old = _Pool(), _Pool()

    def encode(self, part: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of the slice in order, ids of each document)."""
        letter = letters(part.data)
        starts = chunk_starts(part, letter) if self.chunked else np.unique(part.offsets[:-1][part.text_lengths() > 0])
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(part.size, np.int64)
        ends = np.concatenate((starts[1:], [len(part.data)]))
        data, begins, word = self.words.keys(part.data, letter, starts, ends) if self.words else (part.data, starts, np.zeros(len(starts), bool))
        code, distinct = pd.factorize(tk.span_hashes(data, begins, ends))
        if len(self.young.hashes) >= MEMO_ENTRIES:
            self.young, self.old = _Pool(), self.young
        where = self.young.find(distinct)
        missing = np.flatnonzero(where < 0)
        if len(missing):
            before = self.old.find(distinct[missing])
            again = missing[before >= 0]
            if len(again):
                where[again] = self.young.add(distinct[again], *self.old.ids(before[before >= 0]))
            fresh = missing[before < 0]
            seen = np.zeros(len(distinct), np.int64)
            seen[code[::-1]] = np.arange(len(code))[::-1]
            fresh = fresh[np.argsort(word[seen[fresh]], kind="stable")]
            at = seen[fresh]
            where[fresh] = self.young.add(distinct[fresh], *self._called(data, begins[at], ends[at], int(word[at].sum())))
        length, ids = self.young.ids(where[code])
        return ids, np.bincount(tk.owner(part.offsets, starts), weights=length, minlength=part.size).astype(np.int64)

    def _called(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of the given chunks from the library; the last ``n_words`` are words."""
        raw, lengths, ids, others = data.tobytes(), [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], len(starts) - n_words
        for lo in range(0, others, CALL_CHUNKS):
            hi = min(lo + CALL_CHUNKS, others)
            spans = zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)
            found = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in spans], add_special_tokens=False)]
            lengths.append(np.array([len(x) for x in found], np.int64))
            ids.append(np.array(list(chain.from_iterable(found)), np.int32))
        for lo in range(others, len(starts), CALL_CHUNKS):
            more = self.words.call(data, starts[lo : lo + CALL_CHUNKS], ends[lo : lo + CALL_CHUNKS])
            lengths.append(more[0])
            ids.append(more[1])
        return np.concatenate(lengths), np.concatenate(ids)

    def encode_with_end(self, part: tk.Slice, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with ``end_id`` after each document."""
        ids, lengths = self.encode(part)
        return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1


def vocabulary_size(tokenizer_path: str) -> int:
    """Ids below this one."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer_path).get_vocab().values()) + 1


@lru_cache(maxsize=2)
def worker_encoder(tokenizer_path: str) -> ChunkEncoder:
    """One encoder a worker process and file; Spark reuses its workers for many tasks."""
    return ChunkEncoder(tokenizer_path)


tk.forget_with(worker_encoder.cache_clear)
