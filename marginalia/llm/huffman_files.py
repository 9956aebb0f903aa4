"""Operator 1: token ids in Huffman-coded files.

Global counts give a canonical, length-limited Huffman code (package-merge, at most
CODE_BITS bits).  Files hold independent blocks of whole documents; each block has
its documents' ids and lengths, the coded bits, and the bit offset of every
CHECKPOINT-th token.  A block decodes by one table lookup per token, all its
checkpoints in step, without any other block.

File format: a Parquet folder, one row a block, files in ascending doc_id order.

    part       int     the file's place; parts ascend with doc_id
    block      int     the block's place in its part
    part_start long    tokens before the block in its part
    n_tokens   long
    doc_ids    binary  int64 LE a document, ascending
    doc_sizes  binary  uint32 LE tokens a document (its end id included)
    bits       binary  codes, most significant bit first, zero-padded to a byte
    checkpoints binary uint32 LE bit offset of tokens 0, CHECKPOINT, 2*CHECKPOINT, ...

and beside it the codebook: (token, bits) for every token that occurs; codes are
assigned in order of (bits, token).  Parquet is the container because Spark commits
its files atomically when tasks are retried or executors lost.

Null and empty texts are documents of one token, the end id.  Very long texts are encoded
whole and lie in one block.  Null doc_ids sort first.  Repeated doc_ids stay separate
documents, ordered by their token bytes; tokens of equal counts get their codes by id.  An
empty table gives no blocks.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import scratch
from marginalia.llm import textkernel as tk
from marginalia.llm.encoding import SLICE_BYTES, vocabulary_size, worker_encoder

CODE_BITS = 18
CHECKPOINT = 128
BLOCK_TOKENS = 1 << 18
#: Ids are held in 16 bits.
MOST_TOKENS = 1 << 16
NO_ID = np.iinfo(np.int64).min
BLOCK_SCHEMA = "part int, block int, part_start long, n_tokens long, doc_ids binary, doc_sizes binary, bits binary, checkpoints binary"


def code_lengths(counts: np.ndarray, limit: int = CODE_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 where the count is 0."""
    lengths = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    if n <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    packages = np.zeros(0)
    is_leaf = []
    for _ in range(limit):
        merged = np.concatenate((leaves, packages))
        by = np.argsort(merged, kind="stable")
        is_leaf.append(by < n)
        merged = merged[by]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, depth = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for flags in reversed(is_leaf):
        taken = int(flags[:take].sum())
        depth[:taken] += 1
        take = 2 * (take - taken)
    lengths[order] = depth
    return lengths


@dataclass
class Code:
    """Canonical codes from code lengths, and the decoding table."""

    lengths: np.ndarray
    limit: int = CODE_BITS

    def __post_init__(self) -> None:
        used = np.flatnonzero(self.lengths)
        used = used[np.argsort(self.lengths[used], kind="stable")]
        size = np.left_shift(1, self.limit - self.lengths[used])
        first = np.cumsum(size) - size
        self.codes = np.zeros(len(self.lengths), dtype=np.int64)
        self.codes[used] = first >> (self.limit - self.lengths[used])
        self.table_token = np.zeros(1 << self.limit, dtype=np.int32)
        self.table_bits = np.ones(1 << self.limit, dtype=np.int64)
        self.table_token[: int(size.sum())] = np.repeat(used, size)
        self.table_bits[: int(size.sum())] = np.repeat(self.lengths[used], size)

    def encode(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(packed bytes, bit offsets of the checkpoints)."""
        bits = self.lengths[tokens]
        ends = np.cumsum(bits)
        offsets = ends - bits
        total = int(ends[-1]) if len(ends) else 0
        window = self.codes[tokens] << (32 - bits - (offsets & 7))
        at = offsets >> 3
        out = np.zeros((total + 7) // 8 + 4)
        for lane in range(4):
            out += np.bincount(at + lane, weights=(window >> (24 - 8 * lane)) & 255, minlength=len(out))
        return out[: (total + 7) // 8].astype(np.uint8), offsets[::CHECKPOINT].astype("<u4")

    def decode(self, packed: np.ndarray, checkpoints: np.ndarray, n_tokens: int) -> np.ndarray:
        """All tokens of a block; every checkpoint's run advances one token a step."""
        padded = np.concatenate((packed, np.zeros(8, np.uint8))).astype(np.uint32)
        window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
        out = np.zeros((CHECKPOINT, len(checkpoints)), dtype=np.int32)
        at = checkpoints.astype(np.int64)
        last = len(window) - 1
        for step in range(CHECKPOINT):
            index = ((window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - self.limit)).astype(np.int64)
            out[step] = self.table_token[index]
            at += self.table_bits[index]
        return out.T.reshape(-1)[:n_tokens]


def tokenised(documents: DataFrame, tokenizer_path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (uint16 LE); a vocabulary or end id beyond that is refused."""
    if max(vocabulary_size(tokenizer_path), end_id + 1) > MOST_TOKENS:
        raise ValueError(f"ids beyond {MOST_TOKENS - 1} do not fit the files")
    columns = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path)
        for batch in batches:
            doc_ids, texts = tk.take_columns(batch, ["doc_id", "text"])
            for part in tk.slices(texts, SLICE_BYTES):
                ids, lengths = encoder.encode_with_end(part, end_id)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(part.lo, part.size), pa.array(lengths), tk.binary_array(ids.astype("<u2"), lengths)],
                    names=["doc_id", "n_tokens", "ids"],
                )

    return columns.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def token_histogram(ids: DataFrame) -> np.ndarray:
    """Occurrences of every token: partial counts per task, one row a token to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(MOST_TOKENS, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), "<u2"), minlength=len(total)) if len(value.as_buffer()) > 1 << 16 else 0
            small = [v.as_buffer() for v in batch.column(0) if len(v.as_buffer()) <= 1 << 16]
            if small:
                total += np.bincount(np.frombuffer(b"".join(small), "<u2"), minlength=len(total))
        token = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int32)), pa.array(total[token])], names=["token", "n"])

    rows = ids.select("ids").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(MOST_TOKENS, dtype=np.int64)
    counts[rows["token"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts


def write_blocks(ids: DataFrame, lengths: np.ndarray, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The coded files of all documents, in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int] = []
        tokens: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(tokens), "<u2").astype(np.int64)
            packed, checkpoints = code.encode(flat)
            sizes = np.array([len(t) // 2 for t in tokens], dtype="<u4")
            row = [part, block, before, len(flat), np.array(doc_ids, "<i8").tobytes(), sizes.tobytes(), packed.tobytes(), checkpoints.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(NO_ID if doc_id is None else doc_id)
                tokens.append(value.as_py())
                held += len(tokens[-1]) // 2
                if held >= block_tokens:
                    yield flush()
                    block, before, held = block + 1, before + held, 0
                    doc_ids.clear(), tokens.clear()
        if tokens:
            yield flush()

    ordered = ids.select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    return scratch.written(ordered.mapInArrow(run, BLOCK_SCHEMA), "token-blocks")


def read_blocks(blocks: DataFrame, lengths: np.ndarray) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32."""
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a file
    starts, before = {}, 0
    for row in totals:
        starts[row["part"]] = before
        before += row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["doc_sizes"], "<u4").astype(np.int64)
                tokens = code.decode(np.frombuffer(row["bits"], np.uint8), np.frombuffer(row["checkpoints"], "<u4"), row["n_tokens"])
                raw, at = tokens.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(sizes)))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                doc_ids = np.frombuffer(row["doc_ids"], "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(starts[row["part"]] + row["part_start"] + at[:-1]), pa.array(sizes), pa.array(np.array(crc, np.int64))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_corpus(documents: DataFrame, tokenizer_path: str, end_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, np.ndarray]:
    """Write the coded files of a corpus; returns (blocks, code lengths)."""
    ids = scratch.written(tokenised(documents, tokenizer_path, end_id), "token-ids")
    lengths = code_lengths(token_histogram(ids))
    blocks = write_blocks(ids, lengths, block_tokens)
    scratch.drop(ids)
    return blocks, lengths
