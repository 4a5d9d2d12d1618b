"""A Merkle manifest of a table: leaves hashed by row, runs of siblings hashed level by level, proofs for every row.

Every level is an equijoin of nodes with computed sibling indices: a node of index i lies in run i div width at slot i mod width, its siblings have the run's first index
plus the other slots' offsets (for width 2 that is i XOR 1). What stands at slot zero, joined with its siblings, emits the parent. Nodes are keyed by (tree, index), with at most width - 1 rows
a key to join, so a tree with a third of all rows, or all of them, is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import SMALL, checkpointed, lower_ascii, written

#: What a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value (integers decimal)."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def digest(*parts: Column | str) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf(text: str | Column = "text") -> Column:
    return digest(*(field(F.col(f) if f != "text" or isinstance(text, str) else text) for f in FIELDS))


def tree_of(lang: Column) -> Column:
    """The key of a language's tree: the language after ``=``, or nothing for null, which so sorts first and joins as any other."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """``rows``, a written table, with ``_idx``, from 0 within their ``_tree`` in the order of ``by`` (nulls first), and ``_n``, the rows of the tree.

    Ranges of rows are sorted apart and numbered by their place; a place becomes an index by sums over (tree, range), of which there are few more than ranges.
    """
    ranges = rows.repartitionByRange("_tree", *by, F.rand(1)).sortWithinPartitions("_tree", *by)
    table = written(ranges.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    sizes = table.groupBy("_tree", part).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    so_far = W.partitionBy("_tree").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("_tree", "_part", (F.coalesce(F.sum("_rows").over(so_far), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(W.partitionBy("_tree")).alias("_n"))
    sizes = checkpointed(sizes)
    if sizes.count() <= SMALL:
        sizes = F.broadcast(sizes)
    placed = table.withColumn("_part", part).join(sizes, ["_tree", "_part"])
    return placed.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("_idx"), "_n")


def sibling_places(width: int) -> Column:
    """The indices of a node's siblings: _idx XOR 1 in runs of two, else its run's first index plus each other slot's offset; those beyond the tree's end aren't there."""
    if width == 2:
        places = F.array(F.col("_idx").bitwiseXOR(F.lit(1)))
    else:
        places = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda s: F.col("_idx") - F.col("_idx") % width + s)
    return F.filter(places, lambda i: (i != F.col("_idx")) & (i < F.col("_n")))


def with_siblings(nodes: DataFrame, width: int, zero: bool = False, *keep: str) -> DataFrame:
    """The ``nodes``, or those at slot ``zero`` alone, with ``_run``, ``_slot``, the ``keep`` columns, and ``_before`` and ``_after``, their siblings' digests by index.

    Nodes equijoin nodes by (tree, sibling index): every node has a row for each of its siblings' indices, at most width - 1. The join and the sum over a node's siblings are
    partitioned alike, so the nodes and these rows are shuffled once.
    """
    at = nodes.select("_tree", F.col("_idx").alias("_of"), "_digest", F.explode(sibling_places(width)).alias("_idx"))
    placed = nodes.select("_tree", "_idx", "_n", "_digest", *keep)
    if zero:
        at, placed = (d.filter(F.col("_idx") % width == 0) for d in (at, placed))
    met = placed.join(at.select("_tree", "_idx", F.struct("_of", "_digest").alias("_at")), ["_tree", "_idx"], "left")
    kept = [F.first(c).alias(c) for c in dict.fromkeys(("_n", "_digest", *keep))]
    all_of = met.groupBy("_tree", "_idx").agg(*kept, F.array_sort(F.collect_list("_at")).alias("_all"))
    side = lambda which: F.array_join(F.transform(F.filter("_all", which), lambda x: x["_digest"]), "")
    sides = {"_before": side(lambda x: x["_of"] < F.col("_idx")), "_after": side(lambda x: x["_of"] > F.col("_idx"))}
    return all_of.withColumns({"_run": F.expr(f"_idx div {width}"), "_slot": (F.col("_idx") % width).cast("int"), **sides}).drop("_all")


def parents(nodes: DataFrame, width: int) -> DataFrame:
    """The next level: the rows at slot zero hash their run."""
    n = F.expr(f"(_n + {width - 1}) div {width}")
    return with_siblings(nodes, width, True).select("_tree", F.col("_run").alias("_idx"), n.alias("_n"), digest("_digest", "_after").alias("_digest"))


def levels_of(nodes: DataFrame, width: int) -> list[DataFrame]:
    """``nodes`` (_tree, _idx, _n, _digest) and each level above, until every tree has one node; a tree that has is in no further level."""
    out, most = [nodes], nodes.agg(F.max("_n")).first()[0] or 0
    while most > 1:
        out.append(written(parents(out[-1].filter("_n > 1"), width)))
        most = -(-most // width)
    return out


def paths(levels: list[DataFrame], tops: DataFrame, width: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each node of the first level: its ``keep`` columns, what ``tops`` has for its tree, and ``_steps``, from the node to the root.

    A step has the digests ``before`` and ``after`` the node in its run. ``tops`` (_tree, _steps and further columns) has one row a
    tree. Going down, a level takes its steps from its parents; all but the first level is written.
    """
    extra = [c for c in tops.columns if c not in ("_tree", "_steps")]
    known = None
    for i, nodes in reversed([*enumerate(levels)]):
        own = keep if i == 0 else ()
        out = nodes.filter("_n = 1").join(tops, "_tree").select("_tree", "_idx", "_digest", *own, *extra, "_steps")
        if known is not None:
            below = with_siblings(nodes.filter("_n > 1"), width, False, *own)
            above = known.select("_tree", F.col("_idx").alias("_run"), *extra, F.col("_steps").alias("_above"))
            step = F.struct(F.col("_before").alias("before"), F.col("_after").alias("after"))
            below = below.join(above, ["_tree", "_run"]).withColumn("_steps", F.concat(F.array(step), "_above"))
            out = out.unionByName(below.select(out.columns))
        known = out if i == 0 else written(out)
    return known


def forest(docs: DataFrame, width: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels of the languages' trees over ``docs`` and those of the tree over their tops; leaves also have doc_id and ``_tampered``."""
    row = docs.select(*FIELDS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(lower_ascii(F.col("text"))))
    leaves = written(row.select("doc_id", tree_of(F.col("lang")).alias("_tree"), leaf().alias("_digest"), tampered.alias("_tampered")))
    low = levels_of(numbered(leaves, "doc_id", "_digest"), width)
    tops = low[0].filter("_n = 1").select("_tree", "_digest")
    for nodes in low[1:]:
        tops = tops.union(nodes.filter("_n = 1").select("_tree", "_digest"))
    tops = written(tops.select(F.lit("").alias("_tree"), F.col("_tree").alias("_of"), "_digest"))
    return low, levels_of(numbered(tops, "_of"), width)


def manifest(docs: DataFrame, width: int = 8) -> DataFrame:
    """All nodes: part (``lang`` or ``root``), tree (null for the null language's and the root's), level from 0, idx, digest."""
    low, high = forest(docs, width)
    out = None
    for part, levels in (("lang", low), ("root", high)):
        for i, nodes in enumerate(levels):
            one = nodes.select(F.lit(part).alias("part"), F.expr("nullif(substr(_tree, 2), '')" if part == "root" else "if(_tree = '', null, substr(_tree, 2))").alias("tree"), F.lit(i).alias("level"), F.col("_idx").alias("idx"), F.col("_digest").alias("digest"))
            out = one if out is None else out.union(one)
    return out


def proofs(docs: DataFrame, width: int = 8) -> DataFrame:
    """doc_id, leaf, tampered (null where nothing is tampered with), subroot, root and ``steps``, the array of (before, after) from leaf to root."""
    low, high = forest(docs, width)
    root = high[-1].filter("_n = 1").select("_tree", F.col("_digest").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("_steps"))
    tops = paths(high, root, width, ("_of",))
    tops = written(tops.select(F.col("_of").alias("_tree"), F.col("_digest").alias("subroot"), "root", "_steps"))
    out = paths(low, tops, width, ("doc_id", "_tampered"))
    return out.select("doc_id", F.col("_digest").alias("leaf"), F.col("_tampered").alias("tampered"), "subroot", "root", F.col("_steps").alias("steps"))


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and the steps of its proof give."""
    return F.aggregate(steps, start, lambda now, s: F.sha2(F.concat(s["before"], now, s["after"]), 256))


def merkle_manifest(docs: DataFrame, width: int = 8) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs``.

    A row's leaf covers its doc_id, source, lang, n_chars and text alone; other columns aren't read. Null fields hash as ``-``, an empty text as
    ``0:``, and texts are hashed whole however long. Leaves of a language (null is one of its own) go by doc_id, null first, rows
    of one doc_id by their leaf: equal rows have equal leaves, so the digests don't depend on which of them stands first. Every row, repeated ones too,
    is a leaf. A language of one row has its leaf as subroot, one language alone has its subroot as root, and a proof without siblings is that of nothing.
    Tampering lower-cases A-Z of the texts of rows with crc32(doc_id) divisible by 3; such a row verifies only if that changes nothing.
    Null doc_ids and texts aren't tampered with. An empty table gives no rows.
    """
    p = proofs(docs, width)
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    out = p.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
