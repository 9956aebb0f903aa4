"""Operator 4: personal data, and the terms that disclose it.

Base spans (email, ip, card, phone) come from fixed patterns.  Each distinct base value
is a protected entity.  Corpus co-occurrence then estimates how strongly a term (a run
of letters) reveals an entity e: p(e|t), the chance that a text with t is one about e.
The evidence for it are the different contexts in which t stands within CONTEXT terms of e
(all of a document; copies of one passage count once; a term that is part of an email's own
local part has one more), the evidence against it the documents that hold t but not beside
e.  The disclosure is the lower bound of p(e|t), DEVIATIONS standard deviations below the
mean of its posterior (a beta distribution with half a case for and against), so it says the
same in a corpus of any size: with k for and m against, k = 2 and m = 0 give 0.65, 2 and 1
give 0.41, 11 and 0 give 0.90.  A term with at least LEAST_CONTEXTS contexts whose
disclosure exceeds the entity's share of all documents (chance) and is at least GENERALISE
gets a span of kind ``term`` wherever it occurs: generalised to [TERM], or removed from
REMOVE on.  Base spans stay as they are and become [EMAIL], [IP], [CARD], [PHONE].

One context is no evidence: every rare word has some neighbours.  An entity that stands in
one context in the whole corpus is therefore protected by its base span alone, unless its
address holds the term.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased, of at least
MIN_TERM bytes.  Positions are code points, ends exclusive.  Null and empty texts have
no spans; very long texts are read whole.  Rows are judged one by one; repeated rows count
as documents each, null doc_ids like any other.  A term that discloses several entities
counts by the highest; at exactly GENERALISE or REMOVE the stronger rule holds.  An empty
table gives none.  Other columns are ignored, whatever their names; ``sanitised`` returns
them.

Pairs are counted after a partial aggregation per task; terms under judgement are
looked up by hash in every task if at most BROADCAST_TERMS, else joined.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm import scratch
from marginalia.llm import textkernel as tk
from marginalia.llm.scratch import unused

KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT = 6
MIN_TERM = 3
LEAST_CONTEXTS = 2
#: Standard deviations of the lower bound, and the least bounds of what is generalised and removed.
DEVIATIONS = 1.0
GENERALISE = 0.4
REMOVE = 0.9
BROADCAST_TERMS = 2_000_000
_U = np.uint64

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

Span = tuple  # (start, kind index, end)


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost match around each @: the longest local part after the last match, then the domain."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """All base spans of a text by start, then kind."""
    out: list[Span] = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m.group()))
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(text: str, span: Span) -> str:
    """The protected value of a base span: lower-cased, digits only for numbers."""
    value = text[span[0] : span[2]]
    return f"{KINDS[span[1]]}:{value.lower() if span[1] < 2 else ''.join(_DIGITS.findall(value))}"


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_TERM_BYTE = np.zeros(256, bool)
_TERM_BYTE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Terms:
    """Terms of a slice: byte spans, document and hash; code point positions on demand."""

    def __init__(self, part: tk.Slice):
        starts, ends = tk._spans(part.data, part.offsets, _TERM_BYTE[part.data])
        long = ends - starts >= MIN_TERM
        self.starts, self.ends = starts[long], ends[long]
        self.doc = tk.owner(part.offsets, self.starts)
        self.hash = tk.span_hashes(part.data, self.starts, self.ends, lower=True)
        self.first = np.searchsorted(self.doc, np.arange(part.size + 1))
        points = np.concatenate(([0], np.cumsum((part.data & 0xC0) != 0x80)))
        base = points[part.offsets[self.doc]]
        self.from_point, self.to_point = points[self.starts] - base, points[self.ends] - base


def _texts(part: tk.Slice) -> list[str]:
    raw = part.data.tobytes()
    return [raw[a:b].decode() for a, b in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist(), strict=True)]


def _interesting(part: tk.Slice) -> np.ndarray:
    """Documents that can hold a base span: with an @ or a digit."""
    mark = (part.data == 0x40) | ((part.data >= 0x30) & (part.data <= 0x39))
    total = np.concatenate(([0], np.cumsum(mark)))
    return total[part.offsets[1:]] > total[part.offsets[:-1]]


def found_spans(part: tk.Slice) -> dict[int, tuple[str, list[Span]]]:
    """(text, base spans) of the slice's documents that have any."""
    raw, out = part.data.tobytes(), {}
    for d in np.flatnonzero(_interesting(part)).tolist():
        text = raw[part.offsets[d] : part.offsets[d + 1]].decode()
        if spans := base_spans(text):
            out[d] = (text, spans)
    return out


def _hash_text(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


#: Stands for the context that an address gives a term of its own.
OWN = 1


def own_words(address: str) -> set[int]:
    """Hashes of the terms in an email's local part."""
    local = address.rpartition("@")[0].encode()
    whole = tk.Slice(0, 1, np.frombuffer(local, np.uint8), np.array([0, len(local)], np.int64))
    return set(Terms(whole).hash.view(np.int64).tolist()) if local else set()


def _columns(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def cooccurrences(documents: DataFrame) -> DataFrame:
    """One row a document, entity, term beside it (term 0: the entity's presence) and context; ``first`` is 1 in
    one row of each document, entity and term, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch.column(0)):
                spans = found_spans(part)
                if not spans:
                    continue
                terms, rows = Terms(part), []
                for d, (text, own) in spans.items():
                    lo, hi = terms.first[d], terms.first[d + 1]
                    begin, end, code = terms.from_point[lo:hi], terms.to_point[lo:hi], terms.hash[lo:hi].view(np.int64)
                    outside = np.ones(hi - lo, bool)
                    for a, _, b in own:
                        outside &= (end <= a) | (begin >= b)
                    begin, code = begin[outside], code[outside]
                    met: dict[tuple[int, int], set[int]] = {}
                    for span in own:
                        e, at = _hash_text(entity(text, span)), int(np.searchsorted(begin, span[0]))
                        near = code[max(0, at - CONTEXT) : at + CONTEXT]
                        context = int(tk.mix64(np.cumsum(near.view(_U) * np.arange(1, len(near) + 1, dtype=_U)))[-1:].view(np.int64).sum())
                        met[e, 0] = {0}
                        for t in near.tolist():
                            met.setdefault((e, t), set()).add(context)
                        if span[1] == 0:
                            for t in own_words(text[span[0] : span[2]]) & set(near.tolist()):
                                met[e, t].add(OWN)
                    rows += [(e, t, c, int(i == 0)) for (e, t), seen in met.items() for i, c in enumerate(seen)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["entity", "term", "context", "first"])

    return documents.select(F.col("text").cast("string").alias("text")).mapInArrow(tk.task("disclosure", run), "entity long, term long, context long, first long")


def _sorted_hashes(terms: DataFrame, most: int) -> np.ndarray | None:
    """The terms' hashes for every task, or None if there are more than ``most``."""
    if terms.count() > most:
        return None
    return np.sort(terms.select("term").toPandas()["term"].to_numpy(np.int64)).view(np.int64)


def _among(sorted_hashes: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, values), len(sorted_hashes) - 1)
    return sorted_hashes[at] == values


def document_frequencies(documents: DataFrame, terms: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """term, df: in how many documents each of ``terms`` occurs."""
    wanted = _sorted_hashes(terms, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None if wanted is None else np.zeros(len(wanted), np.int64)  # ``most`` at most; sent once a task
        for batch in batches:
            for part in tk.slices(batch.column(0)):
                found = Terms(part)
                code = found.hash.view(np.int64)
                keep = np.ones(len(code), bool) if wanted is None else _among(wanted, code)
                _, values, _ = tk.distinct_per_doc(found.doc[keep], code[keep], part.size)
                value, n = np.unique(values, return_counts=True)
                if total is not None:
                    total[np.searchsorted(wanted, value)] += n
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], names=["term", "df"])
        if total is not None:
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[held]), pa.array(total[held])], names=["term", "df"])

    counted = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(tk.task("disclosure", run), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return counted if wanted is not None else counted.join(terms.select("term").distinct(), "term", "left_semi")


def lower_bound(for_it: Column, against: Column) -> Column:
    """DEVIATIONS below the mean of the posterior of a share, 0 at least."""
    a, b = for_it + 0.5, against + 0.5
    mean = a / (a + b)
    return F.greatest(F.lit(0.0), mean - DEVIATIONS * F.sqrt(mean * (1 - mean) / (a + b + 1)))


def disclosing_terms(documents: DataFrame, threshold: float = GENERALISE, most: int = BROADCAST_TERMS) -> DataFrame:
    """term and its highest disclosure of any entity, for the terms at or above the threshold; written, so found once."""
    met = cooccurrences(documents).groupBy("entity", "term", "context").agg(F.sum("first").alias("n"))
    pairs = scratch.written(met.groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count("*").alias("contexts")), "cooccurrences")
    total = documents.count()
    present = pairs.where("term = 0").select("entity", F.col("n").alias("n_entity"))
    near = pairs.where((F.col("term") != 0) & (F.col("contexts") >= LEAST_CONTEXTS))
    df = document_frequencies(documents, near.select("term").distinct(), most)
    told = near.join(present, "entity").join(df, "term")
    score = lower_bound(F.col("contexts"), F.greatest(F.col("df") - F.col("n"), F.lit(0)))
    told = told.select("term", score.alias("disclosure"), (F.col("n_entity") / F.lit(float(max(total, 1)))).alias("chance")).where((F.col("disclosure") >= threshold) & (F.col("disclosure") > F.col("chance")))
    found = scratch.written(told.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "disclosing-terms")
    scratch.drop(pairs)
    return found


class Marker:
    """Base and term spans of a slice, given the disclosing terms' sorted hashes."""

    def __init__(self, hashes: np.ndarray, disclosure: np.ndarray):
        by = np.argsort(hashes)
        self.hashes, self.disclosure = hashes[by], disclosure[by]

    def spans(self, part: tk.Slice) -> tuple[dict[int, tuple[str, list[Span]]], dict[int, list[tuple[Span, float]]]]:
        base = found_spans(part)
        more: dict[int, list[tuple[Span, float]]] = {}
        if len(self.hashes):
            terms = Terms(part)
            code = terms.hash.view(np.int64)
            for i in np.flatnonzero(_among(self.hashes, code)).tolist():
                d, a, b = int(terms.doc[i]), int(terms.from_point[i]), int(terms.to_point[i])
                if all(b <= s or a >= e for s, _, e in base.get(d, ("", []))[1]):
                    score = self.disclosure[np.searchsorted(self.hashes, code[i])]
                    more.setdefault(d, []).append(((a, 4, b), float(score)))
        return base, more


def _with_terms(documents: DataFrame, terms: DataFrame, most: int) -> tuple[DataFrame, Marker | None]:
    """The documents and a marker for every task; beyond ``most`` terms, no marker but a last column
    with each document's own disclosing terms, found by a join on its distinct term hashes."""
    rows = terms.limit(most + 1).toPandas()
    if len(rows) <= most:
        return documents, Marker(rows["term"].to_numpy(np.int64), rows["disclosure"].to_numpy(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch.column(1)):
                found = Terms(part)
                doc, values, _ = tk.distinct_per_doc(found.doc, found.hash.view(np.int64), part.size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, part.size).take(pa.array(doc)), pa.array(values)], names=["key", "term"])

    key, own_terms = unused(documents, "key", "terms")
    keyed = documents.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    own = keyed.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")).dropDuplicates(["key"]).mapInArrow(tk.task("disclosure", run), "key long, term long")
    told = own.join(terms, "term").groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("term", "disclosure")).alias(own_terms))  # a document's own terms
    return keyed.join(told, key, "left").select(*documents.columns, own_terms), None


def _marker_of(shared, batch: pa.RecordBatch, part: tk.Slice) -> Marker:
    if shared is not None:
        return shared.value
    found = batch.column(batch.num_columns - 1).slice(part.lo, part.size).flatten()
    hashes, first = np.unique(found.field("term").to_numpy(zero_copy_only=False), return_index=True)
    return Marker(hashes, found.field("disclosure").to_numpy(zero_copy_only=False)[first])


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long"


def digests(documents: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """Counts and digests of every document's spans."""
    rows, marker = _with_terms(_columns(documents), disclosing_terms(documents, most=most), most)
    shared = documents.sparkSession.sparkContext.broadcast(marker) if marker is not None else None
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = tk.take_columns(batch, ["doc_id", "text"])
            for part in tk.slices(texts):
                base, more = _marker_of(shared, batch, part).spans(part)
                n = part.size
                counts = np.zeros((5, n), np.int64)
                sha, joined = [empty] * n, [""] * n
                for d in base.keys() | more.keys():
                    own, extra = base.get(d, ("", []))[1], [s for s, _ in more.get(d, [])]
                    for _, k, _ in [*own, *extra]:
                        counts[k, d] += 1
                    sha[d] = hashlib.sha256(written_spans(own).encode()).hexdigest()
                    joined[d] = written_spans(sorted([*own, *extra]))
                yield pa.RecordBatch.from_arrays([ids.slice(part.lo, n), *(pa.array(c) for c in counts[:4]), pa.array(sha), pa.array(joined), pa.array(counts[4])], names=[c.split()[0] for c in DIGEST.split(", ")])

    return rows.mapInArrow(tk.task("disclosure", run), DIGEST)


def sanitised_text(text: str, spans: list[tuple[Span, float]]) -> str:
    """The text with each span generalised or removed; of overlapping spans the first one counts."""
    out, at = [], 0
    for (a, k, b), disclosure in sorted(spans):
        if a < at:
            at = max(at, b)
            continue
        out.append(text[at:a])
        out.append("" if k == 4 and disclosure >= REMOVE else f"[{KINDS[k].upper()}]")
        at = b
    return "".join([*out, text[at:]])


def sanitised(documents: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """The documents (all columns) with sanitised texts; null texts stay null."""
    rows, marker = _with_terms(documents, disclosing_terms(documents, most=most), most)
    shared = documents.sparkSession.sparkContext.broadcast(marker) if marker is not None else None
    width, schema = len(documents.columns), documents.schema
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            texts: list[str | None] = column.to_pylist()
            for part in tk.slices(column):
                base, more = _marker_of(shared, batch, part).spans(part)
                for d in base.keys() | more.keys():
                    spans = [(s, 0.0) for s in base.get(d, ("", []))[1]] + more.get(d, [])
                    texts[part.lo + d] = sanitised_text(texts[part.lo + d], spans)
            columns = list(batch.columns)[:width]
            columns[place] = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width])

    return rows.mapInArrow(tk.task("disclosure", run), schema)
