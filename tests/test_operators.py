"""Behaviour of the document operators on small tables made by hand."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from leafwork.functions import colour, geometry as geo, text as tx
from leafwork.operators import annotations, graph, history, layout, ocr, pages, pipeline, regions, revisions, rules, text_ops
from leafwork.sources import files as source_files, readers, writers
from leafwork.streaming.replay import replay_files

BLOCK = "doc_id long, page_no long, block_id long, text string, x double, y double"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def blocks(spark, *rows):
    return spark.createDataFrame([(1, 0, i, t, float(x), float(y)) for i, (t, x, y) in enumerate(rows)], BLOCK)


def test_search_counts_matches_that_do_not_overlap_and_heeds_case(spark):
    p = spark.createDataFrame([(1, 0, "aaaa Aa"), (1, 1, "none"), (2, 0, None)], "doc_id long, page_no long, text string")
    assert [tuple(r) for r in text_ops.search_text(p, "aa").select("page_no", "matches").collect()] == [(0, 2)]
    assert text_ops.search_text(p, "").count() == 0


@pytest.mark.parametrize("text", ["plain", "", "Grüße 漢字 🙂"])
def test_text_bytes_round_trip(spark, text):
    assert one(spark, tx.decode_bytes(tx.encode_text(F.lit(text)))) == text


def test_bytes_that_are_no_utf8_are_read_with_replacements(spark):
    assert "a" in one(spark, tx.decode_bytes(F.unhex(F.lit("61FF"))))


def test_page_spec(spark):
    pages_ = one(spark, tx.parse_page_spec(F.lit("1-5, 8, 13-11, x, 9-, 99, 2"), F.lit(12)))
    assert pages_ == [0, 1, 2, 3, 4, 7, 10, 11]
    assert one(spark, tx.parse_page_spec(F.lit("99-100"), F.lit(12))) == []


@pytest.mark.parametrize("msg, shown", [("open /a/b/c.pdf now", "open c.pdf now"), ("(C:\\x\\y.txt).", "(y.txt)."), ("see https://h/a/b", "see https://h/a/b"), ("no path", "no path"), ("/root", "/root")])
def test_paths_in_messages(spark, msg, shown):
    assert one(spark, tx.strip_paths(F.lit(msg))) == shown


def test_error_kinds(spark):
    kinds = {m: one(spark, tx.classify_error(F.lit(m))) for m in ("x PASSWORD_REQUIRED", "SIGNED_PDF_MUTATION_ERROR", "tool timed out", "else")}
    assert list(kinds.values()) == ["PasswordRequired", "SignedPdfMutationBlocked", "Timeout", "General"]


def test_columns_of_a_line(spark):
    got = {s: one(spark, tx.split_columns(F.lit(s))) for s in ("a\tb,c", "a  b c", "a, b,", "a b")}
    assert list(got.values()) == [["a", "b,c"], ["a", "b", "c"], ["a", "b"], ["a b"]]


def test_black_is_key_alone_and_grey_goes_back(spark):
    k = one(spark, colour.rgb_to_cmyk(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    assert tuple(k) == (0, 0, 0, 100)
    assert tuple(one(spark, colour.cmyk_to_rgb(*map(F.lit, k)))) == (0, 0, 0)
    assert one(spark, colour.parse_color(F.lit("#12345")))["r"] == 0


@pytest.mark.parametrize("rotation", [0, 90, 180, 270, -90])
def test_boxes_go_to_the_visual_page_and_back(spark, rotation):
    box, page = [10.0, 20.0, 30.0, 40.0], [200.0, 300.0, rotation]
    there = one(spark, geo.box_to_visual(*map(F.lit, box + page)))
    assert list(one(spark, geo.box_from_visual(*map(F.lit, [*there, *page])))) == box


def test_paper(spark):
    assert one(spark, geo.paper_label(F.lit(842.0), F.lit(595.0))) == "A4 (297 x 210 mm)"
    assert one(spark, geo.paper_label(F.lit(0.0), F.lit(595.0))) == "—"


def test_only_the_run_in_the_rectangle_goes(spark):
    runs = blocks(spark, ("Hello", 100, 500), ("Secret", 127.5, 500), ("left of it", 80, 500), ("below", 130, 499.9)).withColumn("adv", F.lit(27.5))
    rect = spark.createDataFrame([(1, 0, 127.5, 500.0, 40.0, 10.0)], "doc_id long, page_no long, x double, y double, w double, h double")
    got = regions.redact_region(runs, rect, F.col("adv"))
    assert [r.text for r in got.filter("removed").collect()] == ["Secret"]
    assert got.count() == 4
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_term_must_be_given_and_found(spark):
    with pytest.raises(ValueError):
        regions.drop_matching_runs(blocks(spark), " ")
    word = spark.createDataFrame([(1, 0, 5, 0, 0, 0, 0, 10.0, 10.0, 5.0, 5.0, 90.0, "x")], "doc_id long, page_no long, level int, block_num long, par_num long, line_num long, word_num long, x_left double, y_top double, width double, height double, conf double, text string")
    with pytest.raises(PySparkException):
        ocr.redact_by_ocr(blocks(spark, ("a", 1, 1)).withColumn("advance", F.lit(1.0)), word, "nowhere").collect()


def test_comparing_a_revision_with_itself_finds_nothing(spark):
    b = blocks(spark, ("same", 50, 700), ("same", 50, 684), (" trimmed ", 50, 668))
    b = b.withColumns({"width": F.lit(9.0), "height": F.lit(9.0)})
    assert revisions.diff(b, b).count() == 0


def test_changes_are_told_apart(spark):
    a = blocks(spark, ("HelloWorld", 50, 700), ("stays", 50, 684), ("goes", 50, 500))
    b = blocks(spark, ("HelloNagano", 50, 700), ("stays", 50, 684), ("comes along", 300, 100))
    sized = lambda d, w: d.withColumns({"width": F.lit(w), "height": F.lit(100 - w)})
    got = {r.kind: (r.original_text, r.revised_text, r.width, r.height) for r in revisions.diff(sized(a, 60.0), sized(b, 70.0)).collect()}
    assert got == {"modified": ("HelloWorld", "HelloNagano", 70.0, 40.0), "deleted": ("goes", "", 60.0, 40.0), "added": ("", "comes along", 70.0, 30.0)}


def test_text_operations_are_read_in_order(spark):
    log = [("BT", None, None, None), ("Tf", 12.0, None, None), ("Td", 50.0, 750.0, None), ("Tj", None, None, "one"), ("TL", 14.0, None, None), ("T*", None, None, None), ("'", None, None, "two"), ("ET", None, None, None), ("BT", None, None, None), ("ET", None, None, None), ("BT", None, None, None), ("Tm", 5.0, 6.0, None), ("TJ", None, None, "three"), ("ET", None, None, None)]
    ops = spark.createDataFrame([(1, 0, i, *o) for i, o in enumerate(log)], "doc_id long, page_no long, seq long, op string, a double, b double, text string")
    got = [(r.block_id, r.text, r.x, r.y, r.font_size) for r in layout.interpret_text_ops(ops).orderBy("block_id").collect()]
    assert got == [(0, "onetwo", 50.0, 750.0, 12.0), (1, "three", 5.0, 6.0, 12.0)]


def test_rows_hang_on_their_first_block(spark):
    b = blocks(spark, ("a", 50, 700), ("b", 150, 696), ("c", 250, 694), ("d", 50, 680))
    assert {r.text: (r.row, r.col) for r in layout.cluster_rows(b).collect()} == {"a": (0, 0), "b": (0, 1), "c": (1, 2), "d": (2, 0)}


def test_nested_spans_end_where_they_began(spark):
    log = [("BDC", "Watermark"), ("Tj", None), ("BDC", "Span"), ("EMC", None), ("Tj", None), ("EMC", None), ("Tj", None), ("BDC", "Span"), ("Tj", None), ("EMC", None)]
    ops = spark.createDataFrame([(1, 0, i, *o) for i, o in enumerate(log)], "doc_id long, page_no long, seq long, op string, name string")
    assert [r.seq for r in layout.strip_spans(ops).orderBy("seq").collect()] == [6, 7, 8, 9]


def brute_spans(log, tag, gone):
    """(seq, op, name, stream) of a page without marked spans and streams that are gone: spans by a stack."""
    kept, stack = [], []
    for seq, op, name, stream in sorted(log, key=lambda r: (r[0] is not None, r[0])):
        inside = any(stack)
        if op in ("BDC", "BMC"):
            stack.append(name == tag)
        elif op == "EMC" and stack:
            stack.pop()
        if not inside and not any(stack) and stream not in gone:
            kept.append(seq)
    return sorted(kept, key=str)


def test_spans_and_streams_go_whatever_the_order_of_rows(spark):
    r = random.Random(3)
    log = [(d, p, i, r.choice(["BDC", "BMC", "EMC", "EMC", "Tj", None]), r.choice(["Watermark", "Span", None]), i // 20) for d in (1, 2, None) for p in (0, None) for i in range(150)]
    log += [(1, 0, None, "Tj", None, 0), (2, 0, None, "Tj", None, None)]
    gone = [(d, p, s) for d in (1, None) for p in (0, None) for s in (2, 5)] + [(9, 9, 0)]
    uses = spark.createDataFrame([(*g, "Watermark") for g in gone] + [(2, 0, 1, "Im1")], "doc_id long, page_no long, stream long, resource string")
    a = spark.createDataFrame([(1, "p", None, k, "me", "", 0, "", 1.0, 2.0, 3.0, 4.0) for k in ("Widget", "Watermark")], ANNOT)
    for rows in (log, r.sample(log, len(log))):
        ops = spark.createDataFrame(rows, "doc_id long, page_no long, seq long, op string, name string, stream long").repartition(3)
        got = layout.strip_watermarks(ops, uses, a, columns=["doc_id", "page_no", "seq"])
        for out, left in (([], layout.strip_spans(ops)), (gone, got[0])):
            found = {}
            for x in left.collect():
                found.setdefault((x.doc_id, x.page_no), []).append(x.seq)
            for page in {x[:2] for x in log}:
                # null is no page: its streams stay
                away = [] if None in page else [s for d, p, s in out if (d, p) == page]
                assert sorted(found.get(page, []), key=str) == brute_spans([x[2:] for x in log if x[:2] == page], "Watermark", away), (page, len(out))
        assert [x.subtype for x in got[1].collect()] == ["Widget"]


def test_spans_are_shuffled_and_sorted_once(spark):
    ops = spark.createDataFrame([(1, 0, 0, "Tj", None)], "doc_id long, page_no long, seq long, op string, name string")
    plan = layout.strip_spans(ops)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Sort ") == 1 and "Window" not in plan and plan.index("REPARTITION") < plan.rindex("MapInArrow")


def test_wrapping_keeps_words_and_punctuation_rules(spark):
    p = spark.createDataFrame([(1, 0, "aaaa bbbb cccc"), (1, 1, ""), (1, 2, "漢字漢。")], "doc_id long, pos int, line string")
    got = [(r.pos, r.text) for r in layout.wrap_text(p, 30, 10).orderBy("pos", "line_no").collect()]
    assert got == [(0, "aaaa"), (0, "bbbb"), (0, "cccc"), (1, ""), (2, "漢字"), (2, "漢。")]


def some_pages(spark, n):
    return spark.createDataFrame([(1, i, f"p{i}") for i in range(n)], "doc_id long, page_no long, head string")


def order(df):
    return [r.head for r in df.orderBy("page_no").collect()]


def test_pages_move_copy_and_go(spark):
    move = lambda a, b: spark.createDataFrame([(1, a, b)], "doc_id long, src long, dst long")
    p = some_pages(spark, 4)
    assert order(pages.move_page(p, move(0, 2))) == ["p1", "p2", "p0", "p3"]
    assert order(pages.move_page(p, move(3, 1))) == ["p0", "p3", "p1", "p2"]
    assert order(pages.duplicate_page(p, move(1, 0).drop("dst"))) == ["p0", "p1", "p1", "p2", "p3"]
    assert order(pages.delete_page(p, move(1, 0).drop("dst"))) == ["p0", "p2", "p3"]
    with pytest.raises(PySparkException):
        pages.delete_page(some_pages(spark, 1), move(0, 0).drop("dst")).collect()
    with pytest.raises(PySparkException):
        pages.extract_pages(p, spark.createDataFrame([(1, [9])], "doc_id long, sel array<long>")).collect()


def test_numbers_wider_than_six_digits_stay_whole(spark):
    assert [r.bates for r in pages.bates_number(some_pages(spark, 2), "A-", 999_999, corpus=True).orderBy("page_no").collect()] == ["A-999999", "A-1000000"]


def test_encrypted_input_is_not_merged(spark):
    docs = spark.createDataFrame([(1, "a", True)], "doc_id long, name string, encrypted boolean")
    with pytest.raises(PySparkException):
        pages.merge_documents(some_pages(spark, 2), docs)[0].collect()


def test_ink_over_the_limit_is_told(spark):
    ops = spark.createDataFrame([(1, 0, "k", 0.5, 0.5, 0.5, 0.5), (1, 1, "K", 0.9, 0.9, 0.8, 0.6), (1, 2, "rg", 1.0, 1.0, 1.0, 1.0)], "doc_id long, page_no long, op string, c double, m double, y double, k double")
    got = {r.page_no: (round(r.max_coverage), r.warning) for r in rules.ink_coverage(ops).collect()}
    assert got == {0: (200, False), 1: (320, True), 2: (0, False)}


def test_scores_do_not_go_below_zero(spark):
    page = spark.createDataFrame([(1, i, 100.0, 100.0) for i in range(25)], "doc_id long, page_no long, width double, height double")
    none = spark.createDataFrame([], "doc_id long, name string, embedded boolean")
    ink = spark.createDataFrame([], "doc_id long, page_no long, op string, c double, m double, y double, k double")
    image = spark.createDataFrame([], "doc_id long, colorspace string")
    assert rules.preflight(page.select("doc_id").distinct(), none, ink, image, page).first().score == 0


def tree(spark, *edges):
    return spark.createDataFrame([(1, n, p, o, k, w) for n, p, o, k, w in edges], "doc_id long, node_id string, parent_id string, ordinal long, kind string, box_w double")


def test_trees_with_cycles_end(spark):
    t = tree(spark, ("r", None, 0, "Pages", 612.0), ("b", "r", 2, "Page", None), ("a", "r", 1, "Pages", 500.0), ("c", "a", 0, "Page", None), ("x", "x", 0, "Page", None), ("y", "z", 0, "Page", None), ("z", "y", 0, "Page", None))
    assert [r.node_id for r in graph.tree_preorder(t).orderBy("page_no").collect()] == ["c", "b"]
    assert {r.node_id: r.box_w for r in graph.inherit_attrs(t, "box_w", 595.0).collect()} == {"b": 612.0, "c": 500.0}
    assert graph.outline_tree_json(t).first().json == '[{"title":"r","children":[{"title":"a","children":[{"title":"c","children":[]}]},{"title":"b","children":[]}]}]'


def test_trees_with_cycles_below_the_root_end(spark):
    # A under the root and under its own descendant B; C twice under one parent and once further down
    t = tree(spark, ("r", None, 0, "Pages", None), ("A", "r", 0, "Pages", 7.0), ("B", "A", 0, "Page", None), ("A", "B", 0, "Pages", 9.0), ("C", "r", 1, "Page", 1.0), ("C", "r", 1, "Page", 1.0), ("C", "B", 0, "Page", 2.0))
    assert [(r.node_id, r.level) for r in graph.tree_preorder(t).orderBy("page_no").collect()] == [("B", 2), ("C", 1)]
    assert {r.node_id: r.box_w for r in graph.inherit_attrs(t, "box_w", 595.0).collect()} == {"B": 7.0, "C": 1.0}
    assert {(r.node_id, r.descendants) for r in graph.outline_preorder(t).collect()} == {("r", 3), ("A", 1), ("B", 0), ("C", 0)}
    assert graph.outline_tree_json(t).first().json.count('"A"') == 1


def test_closure_meets_cycles_once(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "d", "e"), (2, "a", "z")], "doc_id long, src string, dst string")
    start = spark.createDataFrame([(1, "a")], "doc_id long, node string")
    assert {(r.doc_id, r.node) for r in graph.closure(e, start).collect()} == {(1, "a"), (1, "b"), (1, "c")}


ANNOT = "doc_id long, annot_id string, in_reply_to string, subtype string, author string, contents string, page_no long, status string, x double, y double, w double, h double"


def test_a_reply_needs_its_parent(spark):
    a = spark.createDataFrame([(1, "p", None, "Text", "me", "hi", 3, "", 1.0, 2.0, 3.0, 4.0)], ANNOT)
    reply = lambda to: spark.createDataFrame([(1, "r", to, "you", "ho")], "doc_id long, annot_id string, in_reply_to string, author string, contents string")
    got = annotations.add_reply(a, reply("p")).filter("annot_id = 'r'").first()
    assert (got.page_no, got.x, got.h) == (3, 1.0, 4.0)
    with pytest.raises(PySparkException):
        annotations.add_reply(a, reply("q")).collect()


def test_annotations_survive_their_file(spark):
    a = spark.createDataFrame([(1, "p", None, "Highlight", 'A "B" <c>', "x & 'y'", 0, "", 1.0, 2.0, 30.0, 4.0), (1, "q", "p", "Text", "me", "", 2, "", 1.0, 2.0, 3.0, 4.0)], ANNOT)
    fields = spark.createDataFrame([(1, "n", "v<")], "doc_id long, name string, value string")
    got = readers.read_xfdf(writers.write_xfdf(a, fields)).orderBy("pos").collect()
    assert [(r.subtype, r.page_no, r.author, r.contents, r.in_reply_to, r.width) for r in got] == [("Highlight", 0, 'A "B" <c>', "x & 'y'", None, 30.0), ("Text", 2, "me", "", "annot_p", 3.0)]
    shapes = [(1, '<xfdf><annotations><SQUARE page="0" color="0.5,1,0"/><ink color="#0000ff" width="bad"></ink></annotations></xfdf>')]
    got = readers.read_xfdf(spark.createDataFrame(shapes, "doc_id long, xfdf string")).orderBy("pos").collect()
    assert [(r.subtype, r.page_no, r.color, r.width) for r in got] == [("Square", 0, [0.5, 1.0, 0.0], 100.0), ("Ink", 0, [0.0, 0.0, 1.0], 100.0)]


def test_files_are_probed_and_salvaged(spark, tmp_path):
    raw = {"a.pdf": b"%PDF-1.7\r\n/Linearized /Type /Sig /Type /Sig", "b.pdf": b"junk", "c.pdf": b"%PDF-2.0\n1 0 obj old endobj\n1 0 obj <</Type /Page>> new endobj"}
    for name, content in raw.items():
        (tmp_path / name).write_bytes(content)
    files = source_files.read_files(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "[^/]+$", 0))
    files = files.union(spark.createDataFrame([("d.pdf", bytearray(), 0)], files.schema))  # Spark's reader leaves out files without a byte
    got = {r.path: (r.rejected, r.version, r.linearized, r.signatures) for r in readers.format_probe(files).collect()}
    assert got == {"a.pdf": (False, "1.7", True, 2), "b.pdf": (True, None, None, None), "c.pdf": (False, "2.0", False, 0), "d.pdf": (True, None, None, None)}
    found = {r.path: (r.body, r.type, r.error) for r in readers.object_scan(files).collect()}
    assert found["c.pdf"] == ("<</Type /Page>> new", "Page", None) and found["b.pdf"][2] and found["d.pdf"][2]


def test_ocr_rows_from_a_file(spark, tmp_path):
    (tmp_path / "o.tsv").write_text("\t".join(readers.OCR_COLUMNS).replace("level", "level") + "\n5\t1\t1\t1\t1\t1\t10\tx\t5\t5\t95.5\t word \nshort\trow\n5\t1\t1\t1\t1\t2\t10\t20\t5\t5\t?\tnext\n")
    got = [(r.word_num, r.y_top, r.conf, r.text) for r in source_files.read_ocr_tsv(spark, str(tmp_path / "o.tsv"))[0].collect()]
    assert got == [(1, 0, 95.5, "word"), (2, 20, -1.0, "next")]


def test_html_becomes_text(spark):
    html = "<style>x<y</style><h1>A</h1><p>b &amp;lt; c</p>\n\n\n<ul><li>d</ul><br/><hr>"
    assert one(spark, readers.html_to_text(F.lit(html))) == "\nA\nb < c\n\n• d\n" + "-" * 40 + "\n"
    assert one(spark, readers.html_to_text(F.lit("<p> </p>"))) == "HTML Document"


EVENTS = "session_id long, seq long, kind string, byte_size long, ts timestamp"
LOG = [(1, 1, "edit"), (1, 2, "edit"), (1, 3, "undo"), (1, 4, "redo"), (1, 5, "undo"), (1, 6, "edit"), (1, 7, "redo"), (2, 1, "undo"), (2, 2, "redo"), (3, 1, "edit"), (3, 2, "undo"), (3, 3, "undo")]


def logged(spark, rows, minutes=1):
    """Events (session, seq, kind and perhaps size), the nth at ``minutes`` times its seq."""
    return spark.createDataFrame([(*e, *([1] if len(e) < 4 else []), datetime(2024, 1, 1) + timedelta(minutes=minutes * e[1])) for e in rows], EVENTS)



def test_undo_and_redo(spark):
    got = {r.session_id: (r.effective, r.undo_depth, r.redo_depth, r.dirty) for r in history.replay_edits(logged(spark, LOG)).collect()}
    assert got == {1: ([1, 6], 2, 0, True), 2: ([], 0, 0, False), 3: ([], 0, 1, True)}


def test_the_stream_ends_where_the_batch_does(spark, tmp_path):
    events = logged(spark, LOG)
    for lo, hi in ((1, 3), (4, 9)):
        events.filter(F.col("seq").between(lo, hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = replay_files(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "checkpoint"), str(tmp_path / "out"))
    row = lambda r: (r.session_id, tuple(r.effective), r.undo_depth, r.redo_depth, r.dirty)
    assert {row(r) for r in got.collect()} == {row(r) for r in history.replay_edits(events).collect()}


def test_history_keeps_the_newest_and_one_at_least(spark):
    e = logged(spark, [(1, 1, "edit", 50), (1, 2, "edit", 60), (1, 3, "edit", 30), (2, 4, "edit", 500)])
    keep = lambda *a: {(r.session_id, r.seq) for r in history.history_retention(e, *a).collect()}
    assert keep(100, 10_000) == {(1, 2), (1, 3), (2, 4)}
    assert keep(100, 510) == {(2, 4)} and keep(100, 10_000, 1) == {(2, 4)}


def test_pipelines_refuse_unknown_actions_and_skip_empty_searches(spark):
    b = blocks(spark, ("a secret", 1, 1))
    step = lambda kind, **p: '{"name": "x", "steps": [{"action_type": "%s", "params": {"search_text": "%s"}}]}' % (kind, p.get("search", ""))  # noqa: E731, UP031
    for kind in ("explode", "optimize"):  # unknown, or without its tables
        with pytest.raises(ValueError):
            pipeline.run_pipeline({"text_block": b}, step(kind))
    assert pipeline.run_pipeline({"text_block": b}, step("redact_text"))["text_block"].first().text == "a secret"
    assert pipeline.run_pipeline({"text_block": b}, step("redact_text", search="secret"))["text_block"].first().text == "a [REDACTED]"


def test_pipelines_run_every_action(spark):
    a = spark.createDataFrame([(1, "p", None, "Widget", "me", "hi", 0, "", 1.0, 2.0, 3.0, 4.0), (1, "q", None, "Text", "me", "", 0, "", 1.0, 2.0, 3.0, 4.0)], ANNOT)
    nodes = spark.createDataFrame([(1, "root", "Catalog"), (1, "kid", "Page"), (1, "lost", "Page"), (1, "info", "Info"), (1, "js", "JavaScript")], "doc_id long, node string, type string")
    edges = spark.createDataFrame([(1, "root", "kid"), (1, "root", "info"), (1, "root", "js")], "doc_id long, src string, dst string")
    field = spark.createDataFrame([(1, "f", "Tx", "value", 0, 10.0, 20.0)], "doc_id long, name string, type string, value string, page_no long, x double, y double")
    page = spark.createDataFrame([(1, 0, 100.0, 100.0, 270)], "doc_id long, page_no long, width double, height double, rotation long")
    text = blocks(spark, ("a secret", 1, 1)).withColumns({"font_size": F.lit(9.0), "color": F.lit("#000000")})
    tables = {"annotation": a, "object": nodes, "ref_edge": edges, "root": nodes.filter("node = 'root'").select("doc_id", "node"), "form_field": field, "page": page, "text_block": text, "font": spark.createDataFrame([(1, "F", "TrueType", True)], "doc_id long, name string, subtype string, embedded boolean")}
    steps = [{"action_type": k, "params": p} for k, p in [("flatten_form", {}), ("optimize", {}), ("remove_metadata", None), ("rotate_pages", {}), ("add_watermark", {"text": "W"}), ("add_page_numbers", {"start_number": 3}), ("convert_to_pdfa", {})]]
    out = pipeline.run_pipeline(tables, json.dumps({"name": "all", "steps": steps}))
    assert {(r.text, r.color) for r in out["text_block"].collect()} == {("a secret", "#000000"), ("value", None), ("3", None)} and out["form_field"].count() == 0
    assert {r.node for r in out["object"].collect()} == {"root", "kid", "js"} and out["page"].first().rotation == 0
    assert {(r.subtype, r.contents) for r in out["annotation"].collect()} == {("Text", ""), ("Watermark", "W")}
    clean = pipeline.run_pipeline(out, '{"name": "x", "steps": [{"action_type": "sanitize_document"}]}')
    assert {r.node for r in clean["object"].collect()} == {"root", "kid"} and clean["annotation"].count() == 0
    assert pipeline.run_pipeline(tables | {"font": tables["font"].withColumn("embedded", F.lit(False))}, json.dumps({"name": "x", "steps": steps[-1:]}))["page"].count() == 0


def test_an_empty_history_gives_an_empty_stream(spark, tmp_path):
    from leafwork.plans import history as plans, registry

    registry.queries()

    class Empty:
        edit_event = spark.createDataFrame([], EVENTS)

    Empty.spark = spark
    assert plans.r2_replay_edits_stream(Empty).collect() == []


def test_grids_take_the_columns_that_there_are(spark):
    cells = spark.createDataFrame([(1, 0, 0, c, f"t{c}") for c in (0, 3, 30)], "doc_id long, page_no long, row long, col long, text string")
    grid = layout.write_grid(cells)
    assert grid.columns[3:] == [writers.letters_of(i) for i in range(31)] and grid.first().AE == "t30" and grid.first().D == "t3"
    with pytest.raises(PySparkException):
        layout.write_grid(cells, 5).collect()


def test_line_breaks_heed_what_may_begin_and_end_a_line(spark):
    p = spark.createDataFrame([(1, 0, "漢字テャ"), (1, 1, "漢字「文"), (1, 2, "漢字文℃")], "doc_id long, pos long, line string")
    got = [(r.pos, r.text) for r in layout.wrap_text(p, 30, 10).orderBy("pos", "line_no").collect()]
    assert got == [(0, "漢字"), (0, "テャ"), (1, "漢字"), (1, "「文"), (2, "漢字"), (2, "文℃")]


def test_offsets_of_scattered_ids(spark):
    ids = [-5, 3, 10**15, 10**15 + 1, 7 * 10**17]
    got = {r.doc_id: r.offset for r in pages.doc_offsets(spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "doc_id long, n long")).collect()}
    assert got == {i: k * (k + 1) // 2 for k, i in enumerate(ids)}


def test_formulas_are_arithmetic_alone(spark):
    f = spark.createDataFrame([(1, "a", "Tx", "4"), (1, "b", "Tx", "x")], "doc_id long, name string, type string, value string")
    got = annotations.calculated_field(f, "c", "(a + 2) * 3 / b", ["a", "b"]).filter("name = 'c'").first()
    assert float(got.value) == 0.0
    with pytest.raises(ValueError):
        annotations.calculated_field(f, "c", "java_method(a)", ["a"])


def test_column_letters(spark):
    assert [one(spark, writers.column_letters(F.lit(i))) for i in (0, 25, 26, 51, 52, 701, 702, 18277)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "ZZZ"]


def test_skew_turns_a_page_without_multiplying_its_words(spark):
    import math

    rows = [(1, p, float(x), 400 + (x - 505) * -math.tan(math.radians(a)) + 40 * k, 10.0) for p, a in ((0, 3.0), (1, 0.0), (2, -2.5)) for k in range(8) for x in range(0, 1000, 50)]
    words = spark.createDataFrame(rows, "doc_id long, page_no long, x_left double, y_top double, width double")
    angles = ocr.skew_estimate(words)
    assert "Generate" not in angles._jdf.queryExecution().executedPlan().toString()
    got = {r.page_no: r.angle for r in angles.collect()}
    assert all(abs(got[p] - a) <= 1 for p, a in ((0, 3.0), (1, 0.0), (2, -2.5)))
