"""Operator 2: near-duplicate groups from bottom-k MinHash sketches of one hash.

Documents whose distinct 5-word shingle sets have 100 * intersection >= 75 * union are
linked; groups are the connected components.

1. One pass gives each document its set size, a 128-bit digest of its set and its
   sketch: the SKETCH smallest values of one 64-bit hash (the whole set if smaller).
2. Documents with equal sets form a class, which is one node.
3. Retained values of the nodes go into inverted lists.  A linked pair has at least
   ``least_common`` retained values in common (exact where sketches are whole sets, else a
   bound whose failure has a chance near 1e-9), so a node needs to be listed only under
   its rarest values, in one global order by list length: passages that many documents
   share come last and mostly open no list.
4. Nodes that meet in a list of more than LONG_LIST are sketched anew with FINE values,
   where the same bound is much tighter, and listed among themselves; a pair that meets in
   a long list only meets there again.
5. Overlaps in the lists generate pairs.  A group of copies is not expanded: each list
   pairs its members with one hub; the union sketch's estimate filters these pairs, exact
   Jaccard on the full shingle sets verifies them, and what is linked is one component.
   The pairs of one hub are dealt to several tasks, each with its own copy of the hub.
6. Lists that still hold several components are gathered by their largest one.  A
   gathering is dealt into blocks of about BLOCK shingles, members of one list together.
   Members outside of the largest component meet the blocks that share a list with theirs;
   a task counts exact overlaps from postings and emits only links.  Skipped pairs join
   members of one component, or nodes that share no list and so cannot be linked.

Words are maximal runs outside 0x20 and 0x09-0x0D, A-Z lower-cased.  Fewer than five
words: the whole sequence is the one shingle.  Null, empty and blank texts have none
and are linked with nothing.  A null doc_id is linked with nothing, has a null
component and is kept.  Rows that repeat a doc_id are one document: each is answered
with its own set size, and all with one component, reached through any of their texts.
Very long texts are sketched in one piece (a task holds one text at a time beyond 0.5 MB).
Ties (equal sets) have the smallest doc_id as their component.  An empty table gives
none.  Other columns are ignored, whatever their names; ``one_of_each`` returns them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm import scratch
from marginalia.llm import textkernel as tk
from marginalia.llm.components import components
from marginalia.llm.idfilter import id_filter, may_hold
from marginalia.llm.scratch import unused

WIDTH = 5
PERCENT = 75
SKETCH = 64
FINE = 512
LONG_LIST = 32
#: Retained values in common of a linked pair whose sketches are samples: Binomial(k, 0.75) falls below with a chance near 2e-9.
SAMPLE_COMMON = {SKETCH: 24, FINE: 324}
#: Shingles of a block whose members are compared in memory (two blocks a task), and of a hub's pairs in one task.
BLOCK = 60_000
_U = np.uint64


def least_common(n: Column, k: int) -> Column:
    """Sets up to 3/4 k can only be linked with sets that are retained whole, so the bound is exact."""
    return F.when(n <= k * PERCENT // 100, F.ceil(n * PERCENT / 100)).otherwise(F.lit(SAMPLE_COMMON[k])).cast("int")


def _columns(documents: DataFrame) -> DataFrame:
    """doc_id, text and the text's key."""
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def _sets(part: tk.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a slice's documents (int64, sorted in each), their counts and digests."""
    doc, values = tk.shingles(part, WIDTH)
    doc, values, counts = tk.distinct_per_doc(doc, values.view(np.int64), part.size)
    full, first = values.view(_U), np.cumsum(counts) - counts
    total = [np.concatenate((np.zeros(1, _U), np.cumsum(tk.mix64(full + _U(salt)), dtype=_U))) for salt in (0x1D, 0x2E)]
    h1, h2 = ((t[first + counts] - t[first]).view(np.int64) for t in total)
    return values, counts, h1, h2


def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, n, digest (h1, h2) and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, keys = tk.take_columns(batch, ["doc_id", "text", "text_key"])
            for part in tk.slices(texts):
                values, counts, h1, h2 = _sets(part)
                kept = np.minimum(counts, SKETCH)
                sketch = tk.list_array(values[tk.ragged_gather(np.cumsum(counts) - counts, kept)], kept, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(part.lo, part.size), keys.slice(part.lo, part.size), pa.array(counts), pa.array(h1), pa.array(h2), sketch],
                    names=["doc_id", "text_key", "n", "h1", "h2", "sketch"],
                )

    return _columns(documents).mapInArrow(tk.task("near_duplicates", run), "doc_id long, text_key long, n long, h1 long, h2 long, sketch array<long>")


def full_sets(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and all distinct shingle hashes, sorted, of the given nodes (node, id and digest), once each."""
    shared = documents.sparkSession.sparkContext.broadcast(id_filter(nodes.select("id")))  # 8 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = batch.filter(pa.array(may_hold(shared.value, batch.column(0))))
            ids, texts = tk.take_columns(chosen, ["doc_id", "text"])
            for part in tk.slices(texts):
                values, counts, h1, h2 = _sets(part)
                yield pa.RecordBatch.from_arrays([ids.slice(part.lo, part.size), pa.array(h1), pa.array(h2), tk.list_array(values, counts, pa.int64())], names=["id", "h1", "h2", "shingles"])

    key = ["id", "h1", "h2"]
    found = _columns(documents).select("doc_id", "text").mapInArrow(tk.task("near_duplicates", run), "id long, h1 long, h2 long, shingles array<long>")
    once = found.groupBy(*key).agg(F.first("shingles").alias("shingles"))  # a row may be repeated
    return once.join(nodes.select("node", *key), key).select("node", "shingles")


def inverted_lists(nodes: DataFrame, k: int = SKETCH) -> DataFrame:
    """(value, node, n, members, hub, n_hub): each node under its rarest retained values, lists of one left out.

    What is counted a value is kept before it is joined, so that Spark can split a frequent value's rows."""
    sized = nodes.select("node", "n", F.size("sketch").alias("s"), "sketch")
    listed = sized.select("node", F.explode("sketch").alias("value"))
    frequent = scratch.kept(listed.groupBy("value").count().where("count > 1"))
    shared = listed.join(frequent, "value")
    own = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("ordered"))  # at most k entries
    own = own.join(sized.drop("sketch"), "node")
    prefix = F.col("s") - least_common(F.col("n"), k) + 1 - (F.col("s") - F.size("ordered"))
    lists = own.where(prefix > 0).select("node", "n", F.explode(F.slice("ordered", 1, F.greatest(prefix, F.lit(1)))).alias("x")).select("x.value", "node", "n")
    lists = scratch.written(lists, "lists")
    heads = lists.groupBy("value").agg(F.count("*").alias("members"), F.min(F.struct("node", "n")).alias("hub")).where("members > 1")
    heads = scratch.kept(heads.select("value", "members", F.col("hub.node").alias("hub"), F.col("hub.n").alias("n_hub")))
    out = scratch.written(lists.join(heads, "value"), "shared-lists")
    scratch.drop(frequent, lists, heads)
    return out


def _alike(a: str, b: str) -> Column:
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * PERCENT)


def hub_pairs(lists: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): each list's members b paired with its smallest node a."""
    met = lists.where("node <> hub").where(_alike("n", "n_hub"))
    return met.select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("n_hub").alias("n_a"), F.col("n").alias("n_b")).distinct()


def verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, block: int, held: list[DataFrame]) -> DataFrame:
    """Links (a, b) among written pairs that the union sketch admits and the full sets confirm.

    A hub with pairs of more than ``block`` shingles is copied: each copy meets a share of them.  ``held`` gets the
    kept tables, to be dropped once the links are written."""
    hubs = scratch.kept(pairs.groupBy("a").agg(F.ceil(F.sum("n_b") / block).cast("int").alias("copies")))
    held.append(hubs)
    dealt = pairs.join(hubs, "a").withColumn("copy", F.pmod(F.xxhash64("b"), "copies").cast("int")).drop("copies")

    def met(left: DataFrame, table: DataFrame, column: str) -> DataFrame:
        side = lambda c: table.select(F.col("node").alias(c), F.col(column).alias(f"{column}_{c}"))
        copied = side("a").join(hubs, "a").select("a", f"{column}_a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
        return left.join(side("b"), "b").join(copied, ["a", "copy"])

    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    both = F.array_intersect("sketch_a", "sketch_b")
    common = F.size(F.array_intersect(union, both))
    whole = (F.col("n_a") <= SKETCH) & (F.col("n_b") <= SKETCH)
    exact = F.size(both) * 100 >= (F.col("n_a") + F.col("n_b") - F.size(both)) * PERCENT
    likely = met(dealt, nodes, "sketch").where(F.when(whole, exact).otherwise(common >= SAMPLE_COMMON[SKETCH])).select("a", "b", "copy", "n_a", "n_b")
    shared = met(likely, sets, "shingles").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("shingles_a", "shingles_b")).alias("k"))
    return shared.where(F.col("k") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("k")) * PERCENT).select("a", "b")


def open_lists(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """(gathering, value, node, n, component): members of the lists that hold several components, gathered by
    their list's largest component."""
    labelled = lists.join(groups.withColumnRenamed("id", "node"), "node", "left").select("value", "node", "n", F.coalesce("component", "node").alias("component"))
    sizes = labelled.groupBy("value", "component").count()
    largest = sizes.groupBy("value").agg(F.count("*").alias("different"), F.max_by("component", F.struct("count", "component")).alias("gathering"))
    largest = scratch.kept(largest.where("different > 1").select("value", "gathering"))
    out = scratch.written(labelled.join(largest, "value").select("gathering", "value", "node", "n", "component"), "open-lists")
    scratch.drop(largest)
    return out


def block_links(met: DataFrame, sets: DataFrame, block: int, held: list[DataFrame]) -> DataFrame:
    """Links (a, b) between members of different components of written open lists, exact, one for two components
    and a unit.  A unit is a block of members outside the largest component, which ask, and a block of members."""
    members = scratch.kept(met.groupBy("gathering", "node").agg(F.min("value").alias("home"), F.first("n").alias("n"), F.first("component").alias("component")))
    sizes = scratch.kept(members.groupBy("gathering").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks")))
    homes = scratch.kept(members.groupBy("gathering", "home").agg(F.ceil(F.sum("n") / block).alias("parts")))
    own = F.pmod(F.xxhash64("home", F.pmod(F.xxhash64("node"), "parts")), F.col("blocks")).cast("int")
    dealt = members.join(homes, ["gathering", "home"]).join(sizes, "gathering").select("gathering", "node", "component", own.alias("own"))
    dealt = scratch.kept(dealt)
    placed = met.select("gathering", "value", "node").join(dealt, ["gathering", "node"])
    placed = placed.groupBy("gathering", "value", "own").agg(F.bool_or(F.col("component") != F.col("gathering")).alias("asks"))
    placed = scratch.kept(placed)
    few = placed.where("asks").select("gathering", "value", F.col("own").alias("i"))
    units = few.join(placed.select("gathering", "value", F.col("own").alias("j")), ["gathering", "value"]).select("gathering", "i", "j").distinct()
    units = scratch.kept(units)
    held += [members, sizes, homes, dealt, placed, units]
    left = dealt.where("component <> gathering").withColumnRenamed("own", "i").join(units, ["gathering", "i"]).withColumn("asks", F.lit(True))
    right = dealt.withColumnRenamed("own", "j").join(units, ["gathering", "j"]).withColumn("asks", F.lit(False))
    sent = left.unionByName(right).join(sets, "node")

    def run(table: pa.Table) -> pa.Table:
        a, b = linked(table)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sent.select("gathering", "i", "j", "node", "component", "asks", "shingles").groupBy("gathering", "i", "j").applyInArrow(run, "a long, b long")


def linked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Linked nodes of different components: rows that ask against the rows that do not, one link for two components."""
    node, component = (table.column(c).to_numpy() for c in ("node", "component"))
    asks = np.asarray(table.column("asks").combine_chunks())
    lists = table.column("shingles").combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    code = np.unique(lists.values.to_numpy()[offsets[0] : offsets[-1]], return_inverse=True)[1]
    offsets -= offsets[0]
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(node)), n)
    answers = np.flatnonzero(~asks[row])
    answers = answers[np.argsort(code[answers], kind="stable")]
    postings = row[answers]
    begin = np.concatenate(([0], np.cumsum(np.bincount(code[answers], minlength=1 + int(code.max(initial=0))))))
    label = np.unique(component, return_inverse=True)[1]
    out_a, out_b, seen = [], [], set()
    for d in np.flatnonzero(asks).tolist():
        mine = code[offsets[d] : offsets[d + 1]]
        common = np.bincount(postings[tk.ragged_gather(begin[mine], begin[mine + 1] - begin[mine])], minlength=len(node))
        found = (common * 100 >= (n + n[d] - common) * PERCENT) & (common > 0) & (label != label[d])
        for e in np.flatnonzero(found).tolist():
            pair = (min(label[d], label[e]), max(label[d], label[e]))
            if pair not in seen:
                seen.add(pair)
                out_a.append(min(node[d], node[e]))
                out_b.append(max(node[d], node[e]))
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def grouped(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (as ``sketches`` has them, less the sketch), and (h1, h2, n, root, component) of every class of equal
    sets: ``root`` is the same in all classes that reach each other, ``component`` the smallest doc_id in them."""
    rows = scratch.written(sketches(documents), "sketches")
    usable = rows.where("n > 0 and doc_id is not null")
    equal = usable.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"))
    classes = scratch.written(equal.withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = classes.select("node", "n", "sketch")
    coarse = inverted_lists(nodes)
    listed = classes.select("node", "id", "h1", "h2").join(coarse.select("node").distinct(), "node", "left_semi")
    sets = scratch.written(full_sets(documents, listed), "sets")
    long = coarse.where(F.col("members") > LONG_LIST).select("node").distinct()
    fine = sets.join(long, "node", "left_semi").select("node", F.size("shingles").cast("long").alias("n"), F.slice("shingles", 1, FINE).alias("sketch"))
    closer = inverted_lists(fine, FINE)
    lists = coarse.where(F.col("members") <= LONG_LIST).unionByName(closer)

    pairs = scratch.written(hub_pairs(lists), "pairs")
    held: list[DataFrame] = []
    found = components(verified(pairs, nodes, sets, BLOCK, held))
    met = open_lists(lists, found)
    more = block_links(met, sets, BLOCK, held)
    found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")))
    scratch.drop(coarse, closer, sets, pairs, met, *held)

    ids = classes.select("node", "id")
    reached = found.select(F.col("id").alias("node"), "component").union(found.select(F.col("component").alias("node"), "component").distinct())
    least = reached.join(ids, "node").groupBy("component").agg(F.min("id").alias("least"))
    reached = reached.join(least, "component").select("node", F.col("component").alias("root"), "least")
    by_set = classes.select("h1", "h2", "n", "node", "id").join(reached, "node", "left")
    by_set = by_set.select("h1", "h2", "n", F.coalesce("root", "node").alias("root"), F.coalesce("least", "id").alias("component"))
    by_set = scratch.written(by_set, "by-set")
    scratch.drop(classes)
    return rows.select("doc_id", "text_key", "n", "h1", "h2"), by_set


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    rows, by_set = grouped(documents)
    key = ["h1", "h2", "n"]
    digest = F.struct(*key)
    several = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").select("doc_id")
    of_repeated = scratch.kept(rows.join(several, "doc_id").join(by_set, key).select("doc_id", "component").distinct())
    first = of_repeated.groupBy("doc_id").agg(F.min("component").alias("a"))
    merged = components(of_repeated.join(first, "doc_id").select("a", F.col("component").alias("b")))
    scratch.drop(of_repeated)
    whole = by_set.join(merged.select(F.col("id").alias("component"), F.col("component").alias("into")), "component", "left").select(*key, F.coalesce("into", "component").alias("component"))
    out = rows.join(whole, key, "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents (all columns) with one row of each group of linked texts: that of the smallest doc_id.

    Rows are told apart by doc_id and text; where both are repeated, one row stays.  Texts that share only their
    doc_id are not linked, so each stays.  Rows without doc_id or words are linked with nothing and all stay."""
    rows, by_set = grouped(documents)
    own_id, own_key, found = unused(documents, "id", "key", "found")
    usable = rows.where("n > 0 and doc_id is not null").join(by_set, ["h1", "h2", "n"])
    chosen = usable.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("x"))
    chosen = chosen.select(F.col("x.doc_id").alias(own_id), F.col("x.text_key").alias(own_key), F.lit(True).alias(found))
    text = F.col("text").cast("string")
    linkable = F.col("doc_id").isNotNull() & F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = documents.withColumns({own_id: F.when(linkable, F.col("doc_id").cast("long")), own_key: F.when(linkable, F.xxhash64(text)).otherwise(F.monotonically_increasing_id())})
    place = F.row_number().over(Window.partitionBy(own_id, own_key).orderBy(own_key))
    once = keyed.withColumn(found, place).where(F.col(found) == 1).drop(found)  # limited in each task before the shuffle
    kept = once.join(chosen, [own_id, own_key], "left").where(F.col(own_id).isNull() | F.col(found))
    return kept.select(*documents.columns)
