"""Trees and graphs by pointer doubling: a round joins every node that isn't done with the node it points to, so rounds are logarithmic in depth. Each is checkpointed: plans stay flat, and lost executors cost one round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import checkpointed

NODE = ["doc_id", "node_id"]


def union_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def one_parent(tree: DataFrame) -> DataFrame:
    """The rows of a tree that count where nodes are named more than once: of each node the row nearest the root, of those on one level the first by its path.

    Only documents that name a node twice are walked level by level for this; all other rows stay as they are.
    """
    twice = checkpointed(tree.groupBy(*NODE).agg(F.count("*").alias("_n")).filter("_n > 1").select("doc_id").distinct())
    if twice.isEmpty():
        return tree
    odd = checkpointed(tree.join(twice, "doc_id", "left_semi"))
    step = lambda r: F.struct(F.col(f"{r}ordinal").alias("o"), F.col(f"{r}node_id").cast("string").alias("n"))
    first = F.row_number().over(Window.partitionBy(*NODE).orderBy("_path"))
    once = lambda rows: checkpointed(rows.withColumn("_nth", first).filter("_nth = 1").drop("_nth"))
    front = once(odd.filter("parent_id IS NULL").withColumn("_path", F.array(step(""))))
    found = [front]
    while not front.isEmpty():
        met = odd.alias("c").join(front.alias("p"), (F.col("c.doc_id") == F.col("p.doc_id")) & (F.col("c.parent_id") == F.col("p.node_id")))
        below = met.select("c.*", F.concat("p._path", F.array(step("c."))).alias("_path"))
        front = once(below.join(union_of(found).select(*NODE), NODE, "left_anti"))
        found.append(front)
    return tree.join(twice, "doc_id", "left_anti").unionByName(union_of(found).drop("_path"))


def levels(tree: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """The nodes that roots reach in a tree (doc_id, node_id, parent_id, ...), each once, with their level and path: the places among siblings, by (ordinal, node_id), from the root on.

    ``carry`` names columns that a node gets from itself and its parent (``c.`` and ``p.``), by an associative rule such as the nearest that isn't null.
    Every node points to its parent; a round puts the parent's path before its own and takes over the parent's pointer, so a chain of n nodes takes about log2(n) rounds. What
    points to a node that isn't there, or has a path longer than its document has nodes, as in and below cycles, is never reached and dropped.
    """
    tree = tree if "ordinal" in tree.columns else tree.withColumn("ordinal", F.col("node_id"))
    names = tree.columns
    place = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("ordinal", F.col("node_id").cast("string")))
    sizes = F.count("*").over(Window.partitionBy("doc_id"))
    rows = one_parent(tree).withColumns({"path": F.array(place), "_to": F.col("parent_id"), "_most": sizes})
    left = checkpointed(rows.filter("_to IS NULL OR _to <> node_id"))
    done = [left.filter("_to IS NULL")]
    left = left.filter("_to IS NOT NULL")
    kept = [c for c in left.columns if c not in ("path", "_to", *(carry or {}))]
    while not left.isEmpty():
        there = union_of([*done, left]).alias("p")
        met = left.alias("c").join(there.hint("merge"), (F.col("c.doc_id") == F.col("p.doc_id")) & (F.col("c._to") == F.col("p.node_id")))
        met = met.select(*(F.col(f"c.{c}") for c in kept), *(e.alias(n) for n, e in (carry or {}).items()), F.concat("p.path", "c.path").alias("path"), F.col("p._to").alias("_to"))
        now = checkpointed(met.filter(F.size("path") <= F.col("_most")))
        done.append(now.filter("_to IS NULL"))
        left = now.filter("_to IS NOT NULL")
    return union_of(done).select(*names, (F.size("path") - 1).alias("level"), "path")


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All (doc_id, node) that ``start`` (doc_id, node) reaches along edges (doc_id, src, dst), itself included, each once.

    A node with one predecessor is reached if that is: such nodes point to it, and by doubling to their head, the next node before them that is in ``start`` or has several predecessors or none. What is
    left, a graph of heads alone, is walked by a frontier; found heads are appended, never written again. So chains and trees take about log2(depth) rounds, and only nodes with several
    predecessors take rounds of the frontier. A pointer that meets its own node is in a cycle that nothing enters, and is dropped.
    """
    start = checkpointed(start.select("doc_id", "node").distinct())
    e = checkpointed(edges.select("doc_id", "src", "dst").filter("src <> dst").distinct())
    before = e.groupBy("doc_id", F.col("dst").alias("node")).agg(F.count("*").alias("_n"), F.min("src").alias("to"))
    single = before.filter("_n = 1").join(start, ["doc_id", "node"], "left_anti").select("doc_id", "node", "to")
    left, heads, reach = checkpointed(single), [], 1
    most = left.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while not left.isEmpty() and reach <= 2 * most:
        there = union_of([*(h.withColumn("_done", F.lit(True)) for h in heads), left.withColumn("_done", F.lit(False))])
        met = left.join(there.select("doc_id", F.col("node").alias("to"), F.col("to").alias("_on"), "_done"), ["doc_id", "to"], "left")
        now = checkpointed(met.select("doc_id", "node", F.coalesce("_on", "to").alias("to"), F.coalesce("_done", F.lit(True)).alias("_done")))
        heads.append(now.filter("_done").drop("_done"))
        left, reach = now.filter("NOT _done AND node <> to").drop("_done"), reach * 2
    headed = checkpointed(union_of(heads)) if heads else left
    # an edge into a head leads there from its source's head
    into = e.withColumnRenamed("dst", "node").join(single.select("doc_id", "node"), ["doc_id", "node"], "left_anti")
    into = into.join(headed.select("doc_id", F.col("node").alias("src"), F.col("to").alias("_h")), ["doc_id", "src"], "left")
    into = checkpointed(into.select("doc_id", F.coalesce("_h", "src").alias("src"), "node").filter("src <> node").distinct())
    front, known = start, [start]
    while not front.isEmpty():
        met = into.join(front.withColumnRenamed("node", "src"), ["doc_id", "src"]).select("doc_id", "node").distinct()
        front = checkpointed(met.join(union_of(known), ["doc_id", "node"], "left_anti"))
        known.append(front)
    found = union_of(known)
    below = headed.join(found.withColumnRenamed("node", "to"), ["doc_id", "to"], "left_semi").select("doc_id", "node")
    return found.union(below)


def tree_preorder(tree: DataFrame) -> DataFrame:
    """G1: leaves of kind Page in preorder of their siblings' ordinals, numbered from 0 in each document."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1
    return levels(tree).filter("kind = 'Page'").select("doc_id", "node_id", place.cast("long").alias("page_no"), "level")


def outline_preorder(outline: DataFrame) -> DataFrame:
    """Every entry in preorder, with its level and the number of entries below it.

    Each entry has a mark where its subtree begins and one where it ends; the entries that begin between them are those below it.
    """
    nodes = levels(outline)
    end = F.concat("path", F.array(F.lit(2**31 - 1)))
    marks = nodes.select("doc_id", "node_id", "level", F.explode(F.array(F.struct(F.col("path").alias("at"), F.lit(1).alias("one")), F.struct(end.alias("at"), F.lit(0).alias("one")))).alias("m"))
    begun = F.sum("m.one").over(Window.partitionBy("doc_id").orderBy("m.at").rowsBetween(Window.unboundedPreceding, 0))
    both = marks.withColumn("_begun", begun).groupBy("doc_id", "node_id", "level").agg(F.min("_begun").alias("_first"), F.max("_begun").alias("_last"))
    return both.select("doc_id", "node_id", "level", (F.col("_first") - 1).alias("place"), (F.col("_last") - F.col("_first")).alias("descendants"))


def outline_tree_json(outline: DataFrame, title: str = "node_id") -> DataFrame:
    """Per document its entries as nested JSON, ``{"title", "children"}``, siblings in order: in preorder, each entry closes those before it that it isn't below."""
    nodes = levels(outline)
    before = F.lag("level").over(Window.partitionBy("doc_id").orderBy("path"))
    closed = F.when(before.isNull(), "").when(F.col("level") > before, "").otherwise(F.concat(F.repeat(F.lit("]}"), before - F.col("level") + 1), F.lit(",")))
    text = F.to_json(F.struct(F.col(title).cast("string").alias("t")), {"ignoreNullFields": "false"})
    entry = F.concat(closed, F.lit('{"title":'), F.substring(text, F.lit(6), F.length(text) - 6), F.lit(',"children":['))
    rows = nodes.select("doc_id", "path", "level", entry.alias("entry"))
    whole = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("path", "entry", "level"))).alias("all"))
    body = F.array_join(F.transform("all", lambda x: x["entry"]), "")
    return whole.select("doc_id", F.concat(F.lit("["), body, F.repeat(F.lit("]}"), F.element_at("all", -1)["level"] + 1), F.lit("]")).alias("json"))


def inherit_attrs(tree: DataFrame, column: str, default: float) -> DataFrame:
    """Pages with ``column`` of their own or of the nearest ancestor that has it, else the default."""
    nodes = levels(tree, {column: F.coalesce(F.col(f"c.{column}"), F.col(f"p.{column}"))})
    return nodes.filter("kind = 'Page'").select("doc_id", "node_id", F.coalesce(column, F.lit(default)).alias(column))


def structure_walk(tree: DataFrame) -> DataFrame:
    """Of what the roots reach, Figures without a text, Tables and table rows, per document."""
    count = lambda c: F.count_if(F.expr(c))
    return levels(tree).groupBy("doc_id").agg(count("kind = 'Figure' AND NOT has_alt").alias("figures_without_alt"), count("kind = 'Table'").alias("tables"), count("kind = 'TR'").alias("rows"))


def thread_closure(annots: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The annotations (doc_id, annot_id) of ``roots`` with all replies below them, and the table without these."""
    edges = annots.filter("in_reply_to IS NOT NULL").select("doc_id", F.col("in_reply_to").alias("src"), F.col("annot_id").alias("dst"))
    gone = closure(edges, roots.select("doc_id", F.col("annot_id").alias("node"))).withColumnRenamed("node", "annot_id")
    return gone, annots.join(gone, ["doc_id", "annot_id"], "left_anti")


def prune_unreachable(objects: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects (doc_id, node) that the roots reach, and the number of others per document."""
    live = closure(edges, roots)
    gone = objects.join(live, ["doc_id", "node"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("removed"))
    return objects.join(live, ["doc_id", "node"], "left_semi"), gone


def remap_ids(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U4: nodes of all documents with numbers of their own, from 1 on: rank within the document after all ids of documents before it; and the edges in these numbers."""
    from .pages import doc_offsets

    nodes = edges.select("doc_id", F.col("src").alias("node")).union(edges.select("doc_id", "dst")).distinct()
    offset = doc_offsets(nodes.groupBy("doc_id").agg(F.count("*").alias("n")))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("node"))
    ids = checkpointed(nodes.withColumn("_r", rank).join(offset, "doc_id").select("doc_id", "node", (F.col("offset") + F.col("_r")).alias("new_id")))
    end = lambda c: ids.select("doc_id", F.col("node").alias(c), F.col("new_id").alias(f"new_{c}"))
    return ids, edges.join(end("src"), ["doc_id", "src"]).join(end("dst"), ["doc_id", "dst"]).select("doc_id", "new_src", "new_dst")
