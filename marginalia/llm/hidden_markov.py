"""Operator 7: hidden Markov language model over words.

Training texts give exact counts of every token (words, A-Z lower-cased, then one end
token).  The model has STATES latent states that emit symbols: one for the end, one for
each of the OWN most frequent words, and ENDINGS classes, by a word's last bytes, for all
others.  Baum-Welch trains it: every task runs scaled forward-backward over its training
sequences and emits expected counts, which Spark sums across partitions; ROUNDS rounds
over all training texts.  The last round also sums the expected counts of every other
word by state (a byte a state, beside the exact count), in a table that grows with the
vocabulary: in state k, word w of class g has
the share (c_k(w) + a) / (c_k(g) + a (V_g + 1)) of its class, with c the expected counts,
V_g the distinct words of the class and a = 1 / STATES; unseen words share one such place.
So every word of the training texts has emissions of its own.  The scaled forward
recursion then gives a text's exact likelihood.

Frequent words (a bounded table) are looked up in the task.  Texts lie in blocks of about
BLOCK_BYTES; a block's other words, once each, meet the table of counts in a join, so a
frequent word of held-out texts costs one row a block.

The add-one unigram base score is exact for every token.  Null and empty texts are the end
token alone.  Very long texts are one block.  Null doc_ids are in training (they have no
crc32).  Repeated rows train and are scored each; equally frequent words are taken by hash.
Without training texts (or with an empty table) every count is 0 and the model is uniform.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm import scratch
from marginalia.llm import textkernel as tk

STATES = 8
OWN = 16_384
ENDINGS = 1024
ROUNDS = 3
#: Tokens whose recursions a task holds at once; a longer text is a group of its own.
GROUP_TOKENS = 400_000
#: Text of a block of sequences, which a task holds at once.
BLOCK_BYTES = 8 << 20
#: Steps between two scalings of a recursion, and rows whose emissions are looked up at once (they stay in the cache).
SCALED, RUN_ROWS = 8, 16_384
SMOOTH_MOVE, SMOOTH_EMIT = 1.0, 0.05
END = 0
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def endings(data: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A class for each word from its last two bytes, A-Z lower-cased."""
    code = tk.byte_codes(True)
    last = code[data[ends - 1]]
    before = np.where(ends - starts > 1, code[data[np.maximum(ends - 2, 0)]], _U(0))
    return ((last * _U(3) + before * _U(5)) >> _U(40)).astype(np.int64) % ENDINGS


def word_counts(documents: DataFrame) -> DataFrame:
    """word (hash), ending and n over the given rows: partial counts in each task, then one shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []

        def merged() -> pd.DataFrame:
            return pd.concat(held).groupby(["word", "ending"], sort=False, as_index=False)["n"].sum()

        for batch in batches:
            for part in tk.slices(batch.column(0)):
                w = tk.words(part)
                if not len(w.starts):
                    continue
                code, distinct = pd.factorize(tk.span_hashes(part.data, w.starts, w.ends, lower=True))
                first = np.zeros(len(distinct), np.int64)
                first[code[::-1]] = np.arange(len(code))[::-1]
                kind = endings(part.data, w.ends[first], w.starts[first])
                held.append(pd.DataFrame({"word": distinct.view(np.int64), "ending": kind, "n": np.bincount(code, minlength=len(distinct))}))
                if len(held) > 12:
                    held = [merged()]
        if held:
            yield pa.RecordBatch.from_pandas(merged(), preserve_index=False)

    texts = documents.where("text is not null").select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "word long, ending long, n long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Frequent words by hash (sorted), their counts, the rest's classes, and the totals."""

    words: np.ndarray
    counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    n_end: int
    n_tokens: int
    n_distinct: int

    @property
    def symbols(self) -> int:
        return 1 + len(self.words) + ENDINGS

    def read(self, part: tk.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each document, their symbols (ends included), the other words' hashes in order, and each
        document's known frequent tokens and their part of the base score."""
        w = tk.words(part)
        hashes = tk.span_hashes(part.data, w.starts, w.ends, lower=True).view(np.int64)
        symbol, own, log = 1 + len(self.words) + endings(part.data, w.ends, w.starts), np.zeros(len(hashes), bool), np.zeros(len(hashes))
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            own = self.words[at] == hashes
            symbol = np.where(own, 1 + at, symbol)
            log = np.where(own, np.log10(self.counts[at] + 1), 0.0)
        total = lambda x: np.bincount(w.doc, weights=x, minlength=part.size)
        known = total(own).astype(np.int64) + (self.n_end > 0)
        return w.counts + 1, np.insert(symbol, np.cumsum(w.counts), END), hashes[~own], known, total(log) + np.log10(self.n_end + 1)


def vocabulary(counts: DataFrame, n_train: int, own: int = OWN) -> Vocabulary:
    """From the written counts: at most ``own`` words and ENDINGS classes come to the driver."""
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(own).toPandas()
    classes = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    tokens, distinct = np.zeros(ENDINGS), np.zeros(ENDINGS)
    tokens[classes["ending"].to_numpy(np.int64)] = classes["n"]
    distinct[classes["ending"].to_numpy(np.int64)] = classes["v"]
    kind = top["ending"].to_numpy(np.int64)
    tokens -= np.bincount(kind, weights=top["n"].to_numpy(np.float64), minlength=ENDINGS)
    distinct -= np.bincount(kind, minlength=ENDINGS)
    by = np.argsort(top["word"].to_numpy(np.int64))
    return Vocabulary(top["word"].to_numpy(np.int64)[by], top["n"].to_numpy(np.int64)[by], tokens, distinct, n_train, (whole["n"] or 0) + n_train, whole["v"] + (n_train > 0))


BLOCKS = "block long, doc_ids array<long>, held binary, lengths binary, symbols binary, known binary, base binary, words array<long>, word_at binary"


@dataclass
class Block:
    """Sequences of a block in order.  ``words``: distinct words without a symbol of their own; ``word_at``: their
    place in ``words`` for each token of a class, in order."""

    held: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    words: np.ndarray
    word_at: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        read = lambda c, kind: np.frombuffer(row[c], kind)
        return cls(read("held", bool), read("lengths", "<i8"), read("symbols", "<u2").astype(np.int64), np.array(row["words"], np.int64), read("word_at", "<i4").astype(np.int64))

    def extended(self, symbols: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with one more for each of ``words`` from ``symbols`` on, and the class of each of these."""
        out, at = self.symbols.copy(), np.flatnonzero(self.symbols >= symbols - ENDINGS)
        kind = np.zeros(len(self.words), np.int64)
        kind[self.word_at] = out[at]
        out[at] = symbols + self.word_at
        return out, kind

    def groups(self, symbols: np.ndarray, which: np.ndarray) -> Iterator[tuple[np.ndarray, Group]]:
        """The chosen sequences in groups of like length, so few steps serve few sequences."""
        first = np.cumsum(self.lengths) - self.lengths
        chosen = np.flatnonzero(which)
        chosen = chosen[np.argsort(self.lengths[chosen], kind="stable")]
        lo = held = 0
        for hi, n in enumerate(self.lengths[chosen].tolist()):
            if held and held + n > GROUP_TOKENS:
                yield chosen[lo:hi], Group([symbols[first[d] : first[d] + self.lengths[d]] for d in chosen[lo:hi]])
                lo, held = hi, 0
            held += n
        if len(chosen):
            yield chosen[lo:], Group([symbols[first[d] : first[d] + self.lengths[d]] for d in chosen[lo:]])


def blocks(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The documents' sequences, one row a block."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by OWN and ENDINGS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        block, size = TaskContext.get().partitionId() << 36, 0
        parts: list[tuple] = []

        def flush() -> pa.RecordBatch:
            doc_ids, held, lengths, symbols, words, known, base = (x if i == 0 else np.concatenate(x) for i, x in enumerate(zip(*parts, strict=True)))
            words, at = np.unique(words, return_inverse=True)
            raw = [held.tobytes(), lengths.astype("<i8").tobytes(), symbols.astype("<u2").tobytes(), known.astype("<i8").tobytes(), base.tobytes()]
            values = [block, [i for ids in doc_ids for i in ids], *raw, words, at.astype("<i4").tobytes()]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            ids, held, texts = tk.take_columns(batch, ["doc_id", "held_out", "text"])
            held = np.asarray(held)
            for part in tk.slices(texts):
                lengths, symbols, words, known, base = shared.value.read(part)
                parts.append((ids.slice(part.lo, part.size).to_pylist(), held[part.lo : part.hi], lengths, symbols.astype(np.uint16), words, known, base))
                size += len(part.data)
                if size >= BLOCK_BYTES:
                    yield flush()
                    block, size = block + 1, 0
                    parts.clear()
        if parts:
            yield flush()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return scratch.written(rows.mapInArrow(run, BLOCKS), "sequences")


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states

    @cached_property
    def relative(self) -> tuple[np.ndarray, np.ndarray]:
        """Each symbol's largest emission, and its emissions as shares of that."""
        top = self.emit.max(axis=1)
        return top, self.emit / top[:, None]

    @classmethod
    def initial(cls, vocabulary: Vocabulary, states: int = STATES) -> Hmm:
        """Unigram emissions, tilted by a fixed pseudo-random factor for each state and symbol; states mostly stay."""
        counts = np.concatenate(([vocabulary.n_end], vocabulary.counts, vocabulary.class_tokens)) + SMOOTH_EMIT
        tilt = tk.mix64(np.arange(len(counts) * states, dtype=_U) + _U(7)).astype(np.float64).reshape(len(counts), states) / 2.0**64
        emit = counts[:, None] * (0.02 + tilt**4)
        move = np.full((states, states), 0.05 / states) + 0.95 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Hmm:
        """From summed expected counts: a row of states for the start, each state's moves, and each symbol."""
        states = counts.shape[1]
        start, move, emit = counts[0] + SMOOTH_MOVE, counts[1 : 1 + states] + SMOOTH_MOVE, counts[1 + states :] + SMOOTH_EMIT
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Group:
    """Sequences in step, longest first; arrays are time-major, ``begin[t]`` the first row of step t."""

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([len(t) for t in texts])
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        self.steps = int(ordered[0])
        self.active = np.searchsorted(-ordered, -np.arange(1, self.steps + 1), side="right")
        self.begin = np.concatenate(([0], np.cumsum(self.active)))
        flat = np.concatenate([texts[i] for i in self.order]).astype(np.int64)
        step = tk.ragged_gather(np.zeros(len(ordered), np.int64), ordered)
        sequence = np.repeat(np.arange(len(ordered)), ordered)
        place = self.begin[step] + sequence
        self.symbols, self.sequence = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
        self.symbols[place], self.sequence[place] = flat, sequence
        #: The first row of each step that is scaled: all of every SCALED-th step, else those whose sequences end.
        self.first = np.append(self.active[1:], 0)
        self.first[SCALED - 1 :: SCALED] = 0

    def _runs(self) -> Iterator[tuple[int, int]]:
        """Runs of steps of RUN_ROWS rows (or one step), whose emissions are looked up at once."""
        lo = 0
        while lo < self.steps:
            hi = max(lo + 1, int(np.searchsorted(self.begin, self.begin[lo] + RUN_ROWS, side="right")) - 1)
            yield lo, hi
            lo = hi

    def forward(self, model: Hmm, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Natural log likelihood of each sequence, in the given order; with ``keep``, the alphas; and the scales.

        Emissions are shares of their symbol's largest, so that every SCALED-th step only is scaled to a sum of one;
        the rows of a sequence's last step are, too.  Scales of the others are one."""
        top, share = model.relative
        begin, active, first = self.begin.tolist(), self.active.tolist(), self.first.tolist()
        alphas = np.empty((len(self.symbols), len(model.start))) if keep else None
        scales, ones, moved = np.ones(len(self.symbols)), np.ones(len(model.start)), np.empty((active[0], len(model.start)))
        last = None
        for lo, hi in self._runs():
            run = share.take(self.symbols[begin[lo] : begin[hi]], axis=0)
            for t in range(lo, hi):
                m, after = active[t], first[t]
                alpha = run[begin[t] - begin[lo] : begin[t + 1] - begin[lo]]
                alpha *= model.start if t == 0 else np.dot(last[:m], model.move, out=moved[:m])
                if after < m:
                    scale = np.dot(alpha[after:], ones, out=scales[begin[t] + after : begin[t + 1]])
                    alpha[after:] /= scale[:, None]
                last = alpha
            if keep:
                alphas[begin[lo] : begin[hi]] = run
        logs = np.log(scales)
        logs += np.log(top)[self.symbols]
        out = np.empty(active[0])
        out[self.order] = np.bincount(self.sequence, weights=logs, minlength=len(out))
        return out, alphas, scales

    def expected(self, model: Hmm) -> np.ndarray:
        """Expected counts: a row of states for the start, each state's moves, and each symbol."""
        _, alphas, scales = self.forward(model, keep=True)
        begin, active, first = self.begin.tolist(), self.active.tolist(), self.first.tolist()
        share, k, back = model.relative[1], len(model.start), np.ascontiguousarray(model.move.T)
        moves, carried = np.zeros((k, k)), None
        for lo, hi in reversed(list(self._runs())):
            run = share.take(self.symbols[begin[lo] : begin[hi]], axis=0)
            betas = np.ones_like(run)
            if carried is not None:
                betas[begin[hi - 1] - begin[lo] :][: len(carried)] = carried
            for t in range(hi - 1, lo - 1, -1):
                if t:
                    m, after, at = active[t], first[t], begin[t] - begin[lo]
                    ahead = run[at : at + m]
                    ahead *= betas[at : at + m]
                    if after < m:
                        ahead[after:] /= scales[begin[t] + after : begin[t + 1], None]
                    moves += np.dot(alphas[begin[t - 1] : begin[t - 1] + m].T, ahead)
                    if t > lo:
                        np.dot(ahead, back, out=betas[begin[t - 1] - begin[lo] :][:m])
                    else:
                        carried = np.dot(ahead, back)
            alphas[begin[lo] : begin[hi]] *= betas
        emit = np.stack([np.bincount(self.symbols, weights=alphas[:, s], minlength=len(model.emit)) for s in range(k)], axis=1)
        return np.concatenate((alphas[: active[0]].sum(axis=0)[None], moves * model.move, emit))


COUNTS = "own boolean, key long, kind int, n double, shares long"


def packed_shares(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each row's counts by state as shares of ``n``, one byte a state, in one long."""
    share = np.round(255 * counts / np.maximum(n, 1e-300)[:, None]).astype(_U)
    return np.bitwise_or.reduce(share << (_U(8) * np.arange(counts.shape[1], dtype=_U)), axis=1).view(np.int64)


def unpacked_shares(shares: np.ndarray, states: int) -> np.ndarray:
    return (shares.view(_U)[:, None] >> (_U(8) * np.arange(states, dtype=_U)) & _U(255)) / 255.0


def train(rows: DataFrame, vocabulary: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> tuple[Hmm, np.ndarray, DataFrame]:
    """Baum-Welch over all training rows: the model, the classes' expected counts (ENDINGS x states), and the table
    (word, n, shares) of every word without a symbol: its occurrences, and by state their expected share in bytes.

    A round's sums for start, moves and symbols come to the driver.  Rows are (own, key, n): a parameter's place and
    sum, or (own) a word's hash and occurrences; both kinds are summed in one shuffle."""
    if states > 8:
        raise ValueError("at most 8 states have a byte each")
    model = Hmm.initial(vocabulary, states)
    context = rows.sparkSession.sparkContext
    fixed = (1 + states + vocabulary.symbols) * states
    classes, summed = np.zeros((ENDINGS, states)), None
    for turn in range(rounds):
        shared, last = context.broadcast(model), turn + 1 == rounds

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            def sent(own: bool, key: np.ndarray, kind: np.ndarray, n: np.ndarray, shares: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), own)), pa.array(key), pa.array(kind.astype(np.int32)), pa.array(n.astype(np.float64)), pa.array(shares)], names=[c.split()[0] for c in COUNTS.split(", ")])

            total = np.zeros((fixed // states, states))
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block.of(row)
                    model, symbols = shared.value, block.symbols
                    if last:
                        symbols, kind = block.extended(len(model.emit))
                        model = Hmm(model.start, model.move, np.concatenate((model.emit, model.emit[kind])))
                    counts = np.zeros((1 + states + len(model.emit), states))
                    for _, group in block.groups(symbols, ~block.held):
                        counts += group.expected(model)
                    total += counts[: len(total)]
                    if last:
                        own = counts[len(total) :]
                        np.add.at(total, 1 + states + kind, own)
                        n = np.round(own.sum(axis=1))
                        met = np.flatnonzero(n)
                        yield sent(True, block.words[met], kind[met] - (vocabulary.symbols - ENDINGS), n[met], packed_shares(own[met], n[met]))
            place = np.flatnonzero(total)
            zeros = np.zeros(len(place), np.int64)
            yield sent(False, place, zeros, total.ravel()[place], zeros)

        found = rows.select("held", "lengths", "symbols", "words", "word_at").mapInArrow(run, COUNTS)
        share = lambda k: F.shiftrightunsigned("shares", 8 * k).bitwiseAND(F.lit(255))
        # a task's keys are distinct but for its few blocks, so rows are shuffled as they are: sums by state are wider
        found = found.repartition("key").groupBy("own", "key").agg(F.first("kind").alias("kind"), F.sum("n").alias("n"), *[F.sum(F.col("n") * share(k)).alias(f"s{k}") for k in range(states)])
        bytes_of = [F.shiftleft(F.round(F.col(f"s{k}") / F.col("n")).cast("long"), 8 * k) for k in range(states)]
        summed = scratch.written(found.select("own", "key", "kind", "n", F.when(F.col("own"), reduce(lambda a, b: a.bitwiseOR(b), bytes_of)).alias("shares")), "expected-counts")
        table = summed.where("not own").select("key", "n").toPandas()
        shared.unpersist()
        if len(table):
            flat = np.zeros(fixed)
            flat[table["key"].to_numpy(np.int64)] = table["n"].to_numpy(np.float64)
            model = Hmm.from_counts(flat.reshape(-1, states))
        if last:
            whole = summed.where("own").groupBy("kind").agg(*[F.sum(F.col("n") * share(k)).alias(f"s{k}") for k in range(states)]).toPandas()  # ENDINGS rows
            classes[whole["kind"].to_numpy(np.int64)] = whole[[f"s{k}" for k in range(states)]].to_numpy(np.float64) / 255
        else:
            scratch.drop(summed)
    return model, classes, summed.where("own").select(F.col("key").alias("word"), "n", "shares")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def scores(rows: DataFrame, vocabulary: Vocabulary, model: Hmm, classes: np.ndarray, words: DataFrame) -> DataFrame:
    """SCORES of every document; ``base`` still lacks the logarithm of the total, once a token."""
    states = classes.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((model, classes))  # bounded by OWN and ENDINGS
    met = rows.select(F.col("block").alias("of"), F.posexplode("words").alias("pos", "word")).join(words, "word").select("of", "pos", "n", "shares")
    distinct, add = vocabulary.class_words, 1 / states

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model, classes = shared.value
        out: list[pa.Table] = []
        for row in left.to_pylist():
            block = Block.of(row)
            symbols, kind = block.extended(len(model.emit))
            counts, seen = np.zeros((len(block.words), states)), np.zeros(len(block.words))
            at = right.column("pos").to_numpy()
            seen[at] = right.column("n").to_numpy()
            counts[at] = seen[at, None] * unpacked_shares(right.column("shares").to_numpy(), states)
            place = kind - (len(model.emit) - ENDINGS)
            share = (counts + add) / (classes[place] + add * (distinct[place] + 1)[:, None])
            full = Hmm(model.start, model.move, np.concatenate((model.emit, model.emit[kind] * share)))
            score = np.zeros(len(block.lengths))
            for which, group in block.groups(symbols, np.ones(len(score), bool)):
                score[which] = group.forward(full)[0] / np.log(10)
            n = seen[block.word_at]
            doc = np.repeat(np.arange(len(score)), block.lengths)[block.symbols >= len(model.emit) - ENDINGS]
            known = np.frombuffer(row["known"], "<i8") + np.bincount(doc, weights=n > 0, minlength=len(score)).astype(np.int64)
            base = np.frombuffer(row["base"], "<f8") + np.bincount(doc, weights=np.log10(n + 1), minlength=len(score))
            values = [pa.array(row["doc_ids"], pa.int64()), pa.array(block.held), pa.array(block.lengths), pa.array(known), pa.array(base), pa.array(score)]
            out.append(pa.table(values, names=[c.split()[0] for c in SCORES.split(", ")]))
        return pa.concat_tables(out)

    return rows.groupBy("block").cogroup(met.groupBy("of")).applyInArrow(run, SCORES)


def scored(documents: DataFrame, states: int = STATES, rounds: int = ROUNDS, own: int = OWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    training = documents.where(~held_out(F.col("doc_id")))
    n_train = training.count()
    counts = scratch.written(word_counts(training), "word-counts")
    words = vocabulary(counts, n_train, own)
    scratch.drop(counts)
    rows = blocks(documents, words)
    out = scores(rows, words, *train(rows, words, states, rounds))
    each = float(np.log10(words.n_tokens + words.n_distinct + 1))
    base = F.col("base") - F.col("n_tokens") * F.lit(each)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(words.n_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
