"""Pointer doubling against plain walks, its number of rounds, and rules derived from object rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leafwork.operators import graph, objects, rules

TREE = "doc_id long, node_id string, parent_id string, ordinal long, box double"
EDGES = "doc_id long, src string, dst string"


@pytest.fixture
def rounds(monkeypatch):
    """How many tables were checkpointed."""
    made = []
    real = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: made.append(1) or real(df))
    return made


def test_a_long_chain_takes_logarithmic_rounds(spark, rounds):
    n = 10_000
    chain = spark.range(1, n).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") - 1).cast("string").alias("src"), F.col("id").cast("string").alias("dst"))
    start = spark.createDataFrame([(1, "0")], "doc_id long, node string")
    assert graph.closure(chain, start).count() == n
    assert len(rounds) < 24


def test_a_deep_tree_takes_logarithmic_rounds(spark, rounds):
    n = 2000
    chain = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.when(F.col("id") % 500 == 0, F.col("id").cast("double")).alias("box"))
    got = graph.levels(chain, {"box": F.coalesce(F.col("c.box"), F.col("p.box"))})
    assert got.filter("level = node_id AND box = 500 * (node_id div 500)").count() == n
    assert len(rounds) < 16


def random_tree(r, n):
    """Parents below themselves, missing parents, several roots and repeated rows; (node, parent, ordinal, box)."""
    rows = []
    for i in range(n):
        parent = r.choice([None, None, f"n{r.randrange(n)}", f"n{r.randrange(max(1, i))}", "missing"] + [f"n{r.randrange(max(1, i))}"] * 8)
        rows.append((f"n{i}", parent, r.randrange(3), r.choice([None, None, float(i)])))
    return rows


def walk(rows):
    """(node, level, box) in preorder of what roots reach; a node named once has one parent."""
    kids = {}
    for node, parent, ordinal, box in rows:
        kids.setdefault(parent, []).append((ordinal, node, box))
    out = []

    def down(parent, level, above):
        for _, node, box in sorted(kids.get(parent, []), key=lambda k: k[:2]):
            out.append((node, level, above if box is None else box))
            down(node, level + 1, out[-1][2])

    down(None, 0, None)
    return out


def test_trees_are_what_a_walk_finds(spark):
    r = random.Random(4)
    trees = {d: random_tree(r, 40) for d in range(12)}
    t = spark.createDataFrame([(d, *row) for d, rows in trees.items() for row in rows], TREE)
    got = graph.levels(t, {"box": F.coalesce(F.col("c.box"), F.col("p.box"))}).orderBy("doc_id", "path").collect()
    for d, rows in trees.items():
        assert [(x.node_id, x.level, x.box) for x in got if x.doc_id == d] == walk(rows)
    pre = {(x.doc_id, x.node_id): (x.place, x.level, x.descendants) for x in graph.outline_preorder(t).collect()}
    for d, rows in trees.items():
        found = walk(rows)
        for i, (node, level, _) in enumerate(found):
            below = next((j for j in range(i + 1, len(found)) if found[j][1] <= level), len(found))
            assert pre[d, node] == (i, level, below - i - 1)
    for d, text in ((x.doc_id, x.json) for x in graph.outline_tree_json(t).collect()):
        flat = []

        def down(nodes, level, flat=flat):
            for n in nodes:
                flat.append((n["title"], level))
                down(n["children"], level + 1)

        down(json.loads(text), 0)
        assert flat == [(node, level) for node, level, _ in walk(trees[d])]


def test_closures_are_what_a_walk_finds(spark):
    r = random.Random(6)
    edges, starts, want = [], [], set()
    for d in range(15):
        n = 30
        own = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(r.choice([15, 25, 40]))] * r.choice([1, 2])
        begin = {f"n{r.randrange(n)}" for _ in range(r.randrange(3))}
        edges += [(d, *e) for e in own]
        starts += [(d, b) for b in begin] * 2
        seen, front = set(begin), list(begin)
        while front:
            at = front.pop()
            new = {b for a, b in own if a == at} - seen
            seen |= new
            front += new
        want |= {(d, x) for x in seen}
    got = graph.closure(spark.createDataFrame(edges, EDGES), spark.createDataFrame(starts, "doc_id long, node string")).collect()
    assert len(got) == len(want) and {(x.doc_id, x.node) for x in got} == want


def table(spark, *rows):
    """Object rows of document 1: (number, type, dict, stream)."""
    return spark.createDataFrame([(1, n, k, d, None if s is None else len(s), s) for n, k, d, s in rows], "doc_id long, obj_num int, type string, dict map<string,string>, stream_len long, stream string")


GOOD = [
    (0, "Trailer", {"Root": "1 0 R", "Info": "2 0 R", "Version": "1.4", "ID": "[<a> <b>]"}, None),
    (1, "Catalog", {"OutputIntents": "[10 0 R 11 0 R]", "Metadata": "13 0 R", "MarkInfo": "<< /Marked true >>"}, None), (2, "Info", {"Trapped": "/False"}, None),
    (3, "Pages", {"MediaBox": "[0 0 9 9]", "TrimBox": "[0 0 9 9]", "Resources": "<< /XObject << /I 33 0 R >> >>"}, None), (4, "Page", {"Parent": "3 0 R"}, None),
    (10, "", {"S": "/GTS_PDFA1", "DestOutputProfile": "12 0 R"}, None), (11, "", {"S": "/GTS_PDFX"}, None), (12, "", {"N": "3"}, "icc"), (13, "Metadata", {}, "<xmpmeta> pdfaid:part"),
    (20, "Font", {"BaseFont": "/F", "FontDescriptor": "21 0 R"}, None), (21, "FontDescriptor", {"FontFile3": "22 0 R"}, None), (33, "XObject", {"Subtype": "/Image", "ColorSpace": "/DeviceCMYK"}, "i"),
]


def replaced(number, **dict_):
    return [(n, k, {**d, **dict_} if n == number else d, s) for n, k, d, s in GOOD]


def violations(rows):
    return rules.rule_report(rows).first().violations


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        (GOOD, []), (replaced(0, Version="1.3"), ["version"]), (replaced(0, Version="2.0"), []), (replaced(0, Version="x"), ["version"]), (replaced(0, Encrypt="5 0 R"), ["no_encryption"]), (replaced(0, ID="none"), ["file_id"]),
        (replaced(12, N="2"), ["output_intent"]), (replaced(10, S="/GTS_PDFX"), ["output_intent"]), (replaced(1, OutputIntents="[<< /S /GTS_PDFA1 /DestOutputProfile 12 0 R >>]"), []), (replaced(1, OutputIntents="[99 0 R]"), ["output_intent"]),
        (replaced(1, MarkInfo="21 0 R"), ["mark_info"]), (replaced(20, FontDescriptor="98 0 R"), ["fonts_embedded"]), (replaced(13, Filter="[/LZWDecode]"), ["no_lzw"]), (replaced(4, Group="5 0 R"), ["no_transparency"]),
        (replaced(4, Group="<< /S /Transparency >>"), ["no_transparency"]), (replaced(4, Group="<< /S /Other >>"), []), (replaced(4, F="(out.txt)"), ["no_external_refs"]), (replaced(4, F="/Name"), []), (replaced(33, Subtype="/PS"), ["no_postscript"]),
        (GOOD + [(50, "ExtGState", {"CA": "0.5"}, None)], ["no_transparency"]), (GOOD + [(50, "Other", {"CA": "0.5", "JS": "(x)", "XFA": "1", "OPI": "1", "EmbeddedFiles": "1"}, None)], ["no_embedded_files", "no_javascript", "no_opi", "no_xfa"]),
    ],
)
def test_archival_rules_read_objects(spark, rows, want):
    assert violations(rules.archival_rules(table(spark, *rows), "A")) == want


def test_level_b_needs_no_marks(spark):
    rows = replaced(1, MarkInfo="<< /Marked false >>")
    assert violations(rules.archival_rules(table(spark, *rows), "B")) == [] and violations(rules.archival_rules(table(spark, *rows), "A")) == ["mark_info"]


@pytest.mark.parametrize(
    ("rows", "ops", "strict", "loose"),
    [
        (GOOD, ["k"], [], []), (replaced(2, Trapped="/Unknown"), [], ["trapped"], ["trapped"]), (GOOD, ["RG"], ["no_rgb"], []), (replaced(33, ColorSpace="/DeviceRGB"), [], ["no_rgb"], []), (replaced(20, FontDescriptor="98 0 R"), [], ["fonts_embedded"], ["fonts_embedded"]),
        (replaced(20, FontDescriptor="98 0 R", BaseFont="/Courier"), [], [], []), (GOOD + [(5, "Page", {"Resources": "30 0 R"}, None), (30, "", {"ExtGState": "<< /G 31 0 R >>"}, None), (31, "", {"BM": "/Multiply"}, None)], [], ["boxes", "no_transparency"], ["boxes"]),
        (GOOD + [(31, "", {"ca": "0.1"}, None)], [], [], []),
    ],
)
def test_print_rules_inherit_boxes_and_resources(spark, rows, ops, strict, loose):
    o = spark.createDataFrame([(1, op) for op in ops], "doc_id long, op string")
    assert violations(rules.print_rules(table(spark, *rows), o, "X-1a")) == strict
    assert violations(rules.print_rules(table(spark, *rows), o, "X-4")) == loose


def test_rules_of_no_objects(spark):
    none = table(spark, (0, "Trailer", {}, None)).filter("false")
    assert rules.archival_rules(none).count() == 0 and objects.bare_fonts(none, objects.links(none)).count() == 0


def test_rules_broadcast_nothing_that_grows_with_the_documents(spark):
    t = table(spark, *GOOD)
    ops = spark.createDataFrame([(1, "rg")], "doc_id long, op string")
    for rows in (rules.archival_rules(t), rules.print_rules(t, ops)):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
