"""Operator 11: how quality filters interact, from decision diagrams of failure masks.

Every document gets a mask of the filters it fails.  Masks are counted per part (with the
documents labelled good and toxic), and each part's few counts become a diagram: one level
a filter, a pass and a fail branch a node, equal subdiagrams shared, empty ones absent, and
every node weighted with the counts of the documents that reach a terminal under it.
Swapping two adjacent levels changes the order of the filters without touching the levels
above or below; a sequence of such swaps visits all orders.  In each order the path that
passes every level has the counts of each step: its pass branch is kept, its fail branch
removed.  The first level of an order counts all failures of a filter, the last one the
documents that fail nothing else.

Only masks cross the network: rows are counted before each shuffle, so a text that a third
of all rows share is one row a task.  A part is at most 2^5 masks by four label cases.

Null texts are empty; empty texts have no word, so they fail A and pass B and C.  Long
texts are read whole.  Null languages share the part of the empty string.  A null doc_id is
neither smaller nor larger than another: its row passes E and removes no other; its labels
are none.  Rows that repeat a doc_id each count, and pass or fail E together where their
texts are equal.  A doc_id with several label rows is good or toxic if one of them says so;
null labels say nothing.  Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.vectors import bound
from marginalia.llm import scratch

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at one text: A few words, B repetitive, C capitals, D symbols."""

    def of(t: Column) -> Column:
        words = F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), 0)
        counts = bound(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
        few = bound(counts, lambda c: F.when(c["n"] < LEAST_WORDS, 1).otherwise(0) + F.when(F.lit(100) * c["distinct"] < F.lit(LEAST_DISTINCT) * c["n"], 2).otherwise(0))
        capitals = F.octet_length(t) - F.octet_length(F.regexp_replace(t, "[A-Z]+", ""))
        many = F.when(F.lit(100).cast("long") * capitals > F.lit(MOST_CAPITALS).cast("long") * F.length(t), 4).otherwise(0)
        return few + many + F.when(t.rlike(r"[#$%&*|]"), 8).otherwise(0)

    return bound(F.coalesce(text, F.lit("")), of)


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: how many documents of a part fail exactly the filters of the mask."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text_mask(F.col("text")).alias("mask"))
    read = scratch.written(read, "masks")
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = read.where("doc_id is not null").join(marked, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    group = ["same", "part", "mask", "good", "toxic"]
    known = known.groupBy("doc_id", *group).agg(F.count("*").alias("n"))
    unknown = read.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)}).groupBy("doc_id", *group).agg(F.count("*").alias("n"))
    sums = known.unionByName(unknown).groupBy(*group).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnumbered"))
    # a text has a row a part and label case here, however many documents share it
    smallest = F.min("first").over(Window.partitionBy("same"))
    passes = F.col("unnumbered") + F.when(F.col("first") == smallest, F.col("at_first")).otherwise(0)
    split = sums.select("part", "mask", "good", "toxic", "n", passes.alias("passes"))
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("passes").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passes")).alias("n"))))
    each = split.select("part", "good", "toxic", both.alias("x")).select("part", "good", "toxic", "x.mask", "x.n")
    return each.where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


class Diagram:
    """A reduced diagram over filters, in an order that adjacent swaps change.

    Node 0 of every level is the empty one.  ``children[i]`` holds (pass, fail) of level i's nodes as nodes of
    level i + 1; below the last level stand the terminals, one a distinct count.  ``weight[i]`` has their counts."""

    def __init__(self, counts: dict[int, np.ndarray], n_filters: int, width: int):
        self.order = list(range(n_filters))
        self.children: list[list[tuple[int, int]]] = [[(0, 0)] for _ in self.order]
        self.weight: list[list[np.ndarray]] = [[np.zeros(width, np.int64)] for _ in range(n_filters + 1)]
        self._index: list[dict] = [{(0, 0): 0} for _ in self.order]
        terminals: dict[bytes, int] = {self.weight[-1][0].tobytes(): 0}

        def below(level: int, mask: int) -> int:
            if level == n_filters:
                found = counts.get(mask, self.weight[-1][0])
                if found.tobytes() not in terminals:
                    terminals[found.tobytes()] = len(self.weight[-1])
                    self.weight[-1].append(found)
                return terminals[found.tobytes()]
            return self._node(level, below(level + 1, mask), below(level + 1, mask | 1 << level))

        self.root = below(0, 0)

    def _node(self, level: int, passed: int, failed: int) -> int:
        key = (passed, failed)
        if key not in self._index[level]:
            self._index[level][key] = len(self.children[level])
            self.children[level].append(key)
            self.weight[level].append(self.weight[level + 1][passed] + self.weight[level + 1][failed])
        return self._index[level][key]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next: only these two levels' nodes change, and the upper ones keep their numbers."""
        lower = self.children[level + 1]
        cases = [(lower[passed], lower[failed]) for passed, failed in self.children[level]]
        self.children[level + 1], self.weight[level + 1], self._index[level + 1] = [(0, 0)], self.weight[level + 1][:1], {(0, 0): 0}
        self.children[level] = [(self._node(level + 1, p[0], f[0]), self._node(level + 1, p[1], f[1])) for p, f in cases]
        self._index[level] = {key: i for i, key in enumerate(self.children[level])}
        self.order[level : level + 2] = reversed(self.order[level : level + 2])

    def all_pass(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(filter, counts kept, counts removed) of each step of the current order."""
        out, node = [], self.root
        for level, which in enumerate(self.order):
            passed, failed = self.children[level][node]
            out.append((which, self.weight[level + 1][passed], self.weight[level + 1][failed]))
            node = passed
        return out


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places of the adjacent swaps that visit every order of n things once (plain changes)."""
    if n < 2:
        return
    inner = adjacent_swaps(n - 1)
    down = True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + (1 if down else 0)
        down = not down


def orders_of(counts: dict[int, np.ndarray], n_filters: int = len(FILTERS)) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """The all-pass path of every order, by swaps of one diagram; counts' first component is the number of documents."""
    diagram = Diagram(counts, n_filters, len(next(iter(counts.values()))))
    out = [diagram.all_pass()]
    for place in adjacent_swaps(n_filters):
        diagram.swap(place)
        out.append(diagram.all_pass())
    return out


def _part_rows(rows: pd.DataFrame) -> pd.DataFrame:
    counts: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(3, np.int64))
    for mask, good, toxic, n in rows[["mask", "good", "toxic", "n"]].itertuples(index=False):
        counts[int(mask)] += np.array([n, n * good, n * toxic], np.int64)
    paths = orders_of(dict(counts))
    total = {path[0][0]: path[0][2][0] for path in paths}
    alone = {path[-1][0]: path[-1][2][0] for path in paths}
    shapley: dict[int, int] = defaultdict(int)
    for path in paths:
        for which, _, removed in path:
            shapley[which] += int(removed[0])
    out = [
        (rows["part"].iat[0], "".join(FILTERS[w] for w, _, _ in path), step, int(kept[0]), int(gone[0]), int(total[w] - gone[0]), int(alone[w]), int(gone[1]), int(gone[2]), shapley[w])
        for path in paths
        for step, (w, kept, gone) in enumerate(path, 1)
    ]
    return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order of the five filters and step: what the step's filter removes, and what it costs."""
    return failure_counts(docs, labels).groupBy("part").applyInPandas(_part_rows, SCHEMA)
