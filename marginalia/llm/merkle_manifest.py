"""Operator 13: a Merkle manifest of a dataset, levels held as strings of digests.

A row's digest is the SHA-256 of its columns, each as ``-`` or its UTF-8 length, ``:`` and
value.  Each language's rows ascend by doc_id; every 8 consecutive digests are hashed to
one until a single one, the language's subroot, remains; subroots in the order of their
language become the root the same way.

Rows are sorted over ranges once, which gives each its place in its language.  Aligned
blocks of 512 rows then keep every level as one string of 64-character digests: a parent is
the hash of one fixed-width substring of 512 characters, and a digest's siblings are the
substrings that flank it in its run.  A block's last digest is one row of the next round,
whose blocks stand over 512 blocks of this one, so all rounds after the first together hold
a 500th of the rows, and the number of rounds is a logarithm of the largest language.  Going
back down, every block gets the siblings between it and the root, and proves its rows in
place: no row is joined with its ancestors one by one, and no group is larger than a block.

Nulls of any column are written ``-``; an empty text is ``0:``.  Null doc_ids stand first,
null languages first.  Rows that repeat a doc_id in a language follow their digests; rows that are
equal throughout are interchangeable.  Long texts are hashed whole.  An empty table gives
no rows; a table of one row has its digest as root and the hash of nothing as proof.  Other
columns are not part of a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm import scratch

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, DIGEST, LEVELS = 8, 64, 3
RUN, BLOCK = ARITY * DIGEST, ARITY**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a sorted range, about; ranges are cut by sampling.
RANGE_ROWS = 1 << 18


def hashed(*parts: Column) -> Column:
    """H: the digest of the inputs one after the other, as 64 bytes of lowercase hex."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256).cast("binary")


def leaf(columns: dict[str, Column]) -> Column:
    texts = {c: v.cast("string") for c, v in columns.items()}
    return hashed(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in texts.values()])


def substring(level: Column, start: Column, length: Column | int) -> Column:
    """``length`` bytes from the 0-based ``start``."""
    return F.substring(level, start + 1, length if isinstance(length, Column) else F.lit(length))


def parents(level: Column) -> Column:
    """The next level: the hashes of the runs of 8 digests, in order, as one string."""
    runs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / F.lit(RUN)).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(substring(level, i * RUN, RUN), 256)), "").cast("binary")


def flanks(level: Column, place: Column, depth: int) -> Column:
    """The siblings of a digest's ancestor at ``depth`` of its block: (left, right) of it in its run."""
    own = F.shiftright(place, 3 * depth) * DIGEST
    run = F.shiftright(place, 3 * depth + 3) * RUN
    return F.struct(substring(level, run, own - run).alias("left"), substring(level, own + DIGEST, run + RUN - own - DIGEST).alias("right"))


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest and the flanks on its way up give."""
    return F.aggregate(path, digest, lambda at, s: hashed(s["left"], at, s["right"]))


def siblings(path: Column) -> Column:
    """The flanks of a path, level by level, as one string."""
    return F.aggregate(path, F.lit(b""), lambda at, s: F.concat(at, s["left"], s["right"]))


@dataclass
class Round:
    """Blocks of one round: tree, block, size (nodes of the tree), level0 to level2, top, members."""

    blocks: DataFrame
    most: int


def _placed(nodes: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Nodes with ``place``, their 0-based place in their tree by ``order``, and ``size``, the tree's number of nodes.

    A sort over ranges numbers the rows inside each range; a tree's counts a range, added up, are where each begins."""
    spark, n = nodes.sparkSession, nodes.count()
    ranges = max(1, n // RANGE_ROWS, min(n // 64, spark.sparkContext.defaultParallelism))
    keys = [F.col("tree").asc_nulls_first(), *order]
    numbered = nodes.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("number", F.monotonically_increasing_id())
    numbered = scratch.written(numbered, name).withColumn("range", F.shiftright("number", 33))
    counts = numbered.groupBy("tree", "range").agg(F.count("*").alias("n"), F.min("number").alias("least"))
    tree = Window.partitionBy("tree")  # a row a range
    starts = counts.select("tree", "range", "least", F.sum("n").over(tree).alias("size"), (F.sum("n").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    starts = starts.select(F.col("tree").alias("_t"), F.col("range").alias("_r"), "least", "size", F.coalesce("before", F.lit(0)).alias("before"))
    joined = numbered.join(starts, (F.col("range") == F.col("_r")) & F.col("tree").eqNullSafe(F.col("_t")))
    return joined.withColumn("place", F.col("before") + F.col("number") - F.col("least")).drop("_t", "_r", "least", "before", "number", "range")


def _round(nodes: DataFrame, payload: list[str], name: str) -> Round:
    """Blocks over placed nodes: tree, place, size, digest and the payload columns."""
    member = F.struct((F.col("place") % BLOCK).cast("int").alias("at"), "digest", *payload)
    blocks = nodes.groupBy("tree", (F.col("place").cast("long") - F.col("place") % BLOCK).alias("first"), "size").agg(F.array_sort(F.collect_list(member)).alias("members"))  # BLOCK rows at most
    held = F.transform("members", lambda m: m.dropFields("digest"))
    level0 = F.array_join(F.transform("members", lambda m: m["digest"].cast("string")), "").cast("binary")
    blocks = blocks.select("tree", (F.col("first") / BLOCK).cast("long").alias("block"), "size", held.alias("members"), level0.alias("level0"))
    for depth in range(1, LEVELS + 1):
        blocks = blocks.withColumn(f"level{depth}", parents(F.col(f"level{depth - 1}")))
    height = F.when(F.col("size") > BLOCK, LEVELS).otherwise(sum((F.when(F.col("size") > ARITY**d, 1).otherwise(0) for d in range(LEVELS)), F.lit(0)))
    top = F.element_at(F.array(*[f"level{d}" for d in range(LEVELS + 1)]), height + 1)
    blocks = scratch.written(blocks.select("tree", "block", "size", height.alias("height"), "members", *[f"level{d}" for d in range(LEVELS)], top.alias("top")), name)
    return Round(blocks, blocks.agg(F.max("size")).first()[0] or 0)


def _raised(nodes: DataFrame, payload: list[str], name: str) -> tuple[list[Round], DataFrame]:
    """All rounds over placed nodes, and tree and digest of every root."""
    rounds = [_round(nodes, payload, f"{name}-0")]
    size = rounds[0].most
    while size > BLOCK:
        under = rounds[-1].blocks.where(F.col("size") > BLOCK)
        above = under.select("tree", F.col("block").alias("place"), F.ceil(F.col("size") / BLOCK).cast("long").alias("size"), F.col("top").alias("digest"))
        rounds.append(_round(above, [], f"{name}-{len(rounds)}"))
        size = rounds[-1].most
    roots = None
    for one in rounds:
        found = one.blocks.where(F.col("size") <= BLOCK).select("tree", F.col("top").alias("digest"))
        roots = found if roots is None else roots.unionByName(found)
    return rounds, roots


def _path(place: Column) -> Column:
    """The flanks inside a block, as far as the block rises."""
    return F.slice(F.array(*[flanks(F.col(f"level{d}"), place, d) for d in range(LEVELS)]), F.lit(1), F.col("height"))


def _block_paths(rounds: list[Round], above: DataFrame) -> DataFrame:
    """tree, block and path of every block of the first round: the flanks from its top to the root.

    ``above``: tree and path (of the tree's root)."""
    done = above.select(F.col("tree").alias("_t"), "path")
    path_of = None
    for one in reversed(rounds):
        alone = one.blocks.where(F.col("size") <= BLOCK).join(done, F.col("tree").eqNullSafe(F.col("_t"))).drop("_t")
        if path_of is None:
            here = alone
        else:
            up = path_of.select(F.col("tree").alias("_t"), F.col("block").alias("_b"), "path")
            under = one.blocks.where(F.col("size") > BLOCK).join(up, (F.col("block") == F.col("_b")) & F.col("tree").eqNullSafe(F.col("_t"))).drop("_t", "_b")
            here = alone.unionByName(under)
        if one is rounds[0]:
            return here
        each = F.explode(F.transform("members", lambda m: F.struct((F.col("block") * BLOCK + m["at"]).alias("block"), F.concat(_path(m["at"]), F.col("path")).alias("path"))))
        path_of = here.select("tree", each.alias("x")).select("tree", "x.block", "x.path")
    raise AssertionError("no rounds")


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text with A-Z lower-cased where 3 divides the CRC-32 of the decimal doc_id, else null."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.translate(text, UPPER, LOWER))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``folded_root`` is computed from the row as it reads after tampering, with the original siblings."""
    own = {c: F.col(c) for c in COLUMNS}
    changed = tampered_text(own["doc_id"], own["text"])
    other = F.when(changed != own["text"], leaf(own | {"text": changed}))
    leaves = docs.select(F.col("lang").cast("string").alias("tree"), F.col("doc_id"), leaf(own).alias("digest"), other.alias("other"))
    placed = _placed(leaves, [F.col("doc_id").asc_nulls_first(), F.col("digest")], "leaves")
    rounds, roots = _raised(placed, ["doc_id", "other"], "blocks")

    # the subroots, in the order of their language, are the nodes of one more tree
    languages = scratch.written(roots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("digest")), "subroots")
    by_bytes = F.col("lang").cast("binary").asc_nulls_first()
    upper, root = _raised(_placed(languages, [by_bytes], "ordered-subroots"), ["lang"], "languages")
    none = F.array().cast("array<struct<left: binary, right: binary>>")
    tops = _block_paths(upper, root.select("tree", none.alias("path")))
    member = F.explode(F.transform("members", lambda m: F.struct(m["lang"].alias("lang"), substring(F.col("level0"), m["at"] * DIGEST, DIGEST).alias("subroot"), F.concat(_path(m["at"]), F.col("path")).alias("path"))))
    above = tops.select(member.alias("x")).select("x.*").join(root.select(F.col("digest").alias("root")))  # one root
    above = scratch.written(above, "subroot-paths")

    blocks = _block_paths(rounds, above.select(F.col("lang").alias("tree"), "path"))
    known = above.select(F.col("lang").alias("_t"), "subroot", "root")
    blocks = blocks.join(known, F.col("tree").eqNullSafe(F.col("_t"))).withColumn("rest", siblings(F.col("path")))

    def proved(m: Column) -> Column:
        at, path = m["at"], _path(m["at"])
        digest = substring(F.col("level0"), at * DIGEST, DIGEST)
        proof = hashed(*[part for d in range(LEVELS) for s in [flanks(F.col(f"level{d}"), at, d)] for part in (s["left"], s["right"])], F.col("rest"))
        end = folded(folded(F.coalesce(m["other"], digest), path), F.col("path"))
        return F.struct(m["doc_id"].alias("doc_id"), digest.cast("string").alias("leaf"), proof.cast("string").alias("proof_sha256"), end.cast("string").alias("folded_root"))

    rows = blocks.select(F.col("subroot").cast("string").alias("subroot"), F.col("root").cast("string").alias("root"), F.inline(F.transform("members", proved)))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
