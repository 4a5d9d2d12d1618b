"""Queries of trees and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafwork.operators import graph as g

from .registry import Tables, query
from .rules import WALK

TREE = """WITH RECURSIVE walk AS (SELECT doc_id, node_id, ordinal, kind, box_w, 0 AS level, [printf('%010d', ordinal)] AS path, [node_id] AS nodes FROM page_tree WHERE parent_id IS NULL
 UNION ALL SELECT c.doc_id, c.node_id, c.ordinal, c.kind, coalesce(c.box_w, w.box_w), level + 1, list_append(path, printf('%010d', c.ordinal)), list_append(nodes, c.node_id) FROM page_tree c JOIN walk w ON c.doc_id = w.doc_id AND c.parent_id = w.node_id)"""


@query(TREE + " SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS page_no, level FROM walk WHERE kind = 'Page'")
def g1_tree_preorder(t: Tables) -> DataFrame:
    return g.tree_preorder(t.page_tree)


@query(TREE + ", d AS (SELECT doc_id, unnest(nodes) AS node_id FROM walk), n AS (SELECT doc_id, node_id, count(*) - 1 AS descendants FROM d GROUP BY ALL) SELECT doc_id, node_id, level, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS place, descendants FROM walk JOIN n USING (doc_id, node_id)")
def g2_outline_preorder(t: Tables) -> DataFrame:
    return g.outline_preorder(t.page_tree)


NODE = "concat('{\"title\":\"', node_id, '\",\"children\":[', coalesce(kids, ''), ']}')"


@query(f"""WITH c AS (SELECT doc_id, parent_id, string_agg(concat('{{"title":"', node_id, '","children":[]}}'), ',' ORDER BY ordinal, node_id) AS kids FROM page_tree WHERE kind = 'Page' GROUP BY ALL),
 m AS (SELECT p.doc_id, p.parent_id, string_agg({NODE.replace("node_id", "p.node_id")}, ',' ORDER BY ordinal, p.node_id) AS kids FROM page_tree p LEFT JOIN c ON c.doc_id = p.doc_id AND c.parent_id = p.node_id WHERE p.kind = 'Pages' AND p.parent_id IS NOT NULL GROUP BY ALL),
 t AS (SELECT r.doc_id, {NODE.replace("node_id", "r.node_id")} AS j FROM page_tree r LEFT JOIN m ON m.doc_id = r.doc_id AND m.parent_id = r.node_id WHERE r.parent_id IS NULL) SELECT doc_id, concat('[', string_agg(j, ','), ']') AS json FROM t GROUP BY doc_id""")
def g2_outline_tree_json(t: Tables) -> DataFrame:
    return g.outline_tree_json(t.page_tree)


@query(TREE + " SELECT doc_id, node_id, coalesce(box_w, 595) AS box_w FROM walk WHERE kind = 'Page'")
def j8_inherit_attrs(t: Tables) -> DataFrame:
    return g.inherit_attrs(t.page_tree, "box_w", 595.0)


@query("""WITH RECURSIVE w AS (SELECT doc_id, annot_id FROM annotation WHERE annot_id LIKE '%-2' UNION ALL SELECT a.doc_id, a.annot_id FROM annotation a JOIN w ON a.doc_id = w.doc_id AND a.in_reply_to = w.annot_id)
 SELECT doc_id, annot_id, annot_id IN (SELECT annot_id FROM w) AS deleted FROM annotation""")
def g3_thread_closure(t: Tables) -> DataFrame:
    gone, kept = g.thread_closure(t.annotation, t.annotation.filter("annot_id LIKE '%-2'"))
    return gone.withColumn("deleted", F.lit(True)).unionByName(kept.select("doc_id", "annot_id", F.lit(False).alias("deleted")))


@query(WALK + ' SELECT doc_id, figures_without_alt, tables, "rows" FROM g')
def g4_structure_walk(t: Tables) -> DataFrame:
    return g.structure_walk(t.struct_tree)


REACH = "WITH RECURSIVE w AS (SELECT doc_id, {start} AS node, [{start}] AS path FROM {of} UNION ALL SELECT e.doc_id, e.dst, list_append(w.path, e.dst) FROM ref_edge e JOIN w ON e.doc_id = w.doc_id AND e.src = w.node WHERE NOT list_contains(w.path, e.dst))"


@query(REACH.format(start="annot_id", of="annotation WHERE annot_id LIKE '%-1'") + " SELECT DISTINCT doc_id, node FROM w")
def g5_field_closure(t: Tables) -> DataFrame:
    return g.closure(t.ref_edge, t.annotation.filter("annot_id LIKE '%-1'").select("doc_id", F.col("annot_id").alias("node")))


@query(REACH.format(start="annot_id", of="annotation WHERE annot_id LIKE '%-3'") + ", k AS (SELECT DISTINCT doc_id, node FROM w) SELECT a.doc_id, count(*) AS removed FROM annotation a LEFT JOIN k ON k.doc_id = a.doc_id AND k.node = a.annot_id WHERE k.node IS NULL GROUP BY a.doc_id")
def g6_prune_unreachable(t: Tables) -> DataFrame:
    objects = t.annotation.select("doc_id", F.col("annot_id").alias("node"))
    return g.prune_unreachable(objects, t.ref_edge, objects.filter("node LIKE '%-3'"))[1]


@query("""WITH n AS (SELECT DISTINCT doc_id, node FROM (SELECT doc_id, src AS node FROM ref_edge UNION ALL SELECT doc_id, dst FROM ref_edge) x), i AS (SELECT doc_id, node, row_number() OVER (ORDER BY doc_id, node) AS new_id FROM n)
 SELECT e.doc_id, s.new_id AS new_src, d.new_id AS new_dst FROM ref_edge e JOIN i s ON s.doc_id = e.doc_id AND s.node = e.src JOIN i d ON d.doc_id = e.doc_id AND d.node = e.dst""")
def u4_remap_ids(t: Tables) -> DataFrame:
    return g.remap_ids(t.ref_edge)[1]
