"""Annotation files of other programs are read as an XML parser reads them, and ours survive a round trip."""

import pytest

from leafwork.sources import readers, writers

SCHEMA = "doc_id long, xfdf string"


def read(spark, *docs):
    return readers.read_xfdf(spark.createDataFrame([(i + 1, d) for i, d in enumerate(docs)], SCHEMA)).orderBy("doc_id", "pos").collect()


def test_quotes_references_cdata_and_comments(spark):
    doc = """<?xml version="1.0"?><!-- <text page="9" name="gone"/> --><xfdf xmlns="http://ns.adobe.com/xfdf/"><annots>
      <highlight page='2' name='n1' title="a &amp; &#66;&#x43; 'x'"><contents>1 &lt; <![CDATA[<text page="8"/> &amp;]]></contents></highlight>
      <!-- <ink page="3" name="hidden"/> --><TEXT PAGE = "3" Name="n2" inreplyto='n1'/>
      <underline page="1"><contents-richtext><body><text>not one</text></body></contents-richtext><contents>  kept  </contents></underline></annots></xfdf>"""
    got = read(spark, doc)
    assert [(r.pos, r.subtype, r.page_no, r.name, r.author, r.in_reply_to, r.contents) for r in got] == [
        (0, "Highlight", 1, "n1", "a & BC 'x'", None, '1 < <text page="8"/> &amp;'), (1, "Text", 2, "n2", "", "n1", ""), (2, "Underline", 0, "", "", None, "  kept  "),
    ]


def test_any_wrapper_prefix_and_order(spark):
    got = read(spark, "<x:xfdf xmlns:x='u'><x:annots><x:ink page='4'/><x:Line page='5'/><x:ink page='6'/></x:annots></x:xfdf>", "<xfdf><square page='1'/><annotations><circle page='2'/></annotations></xfdf>", "<xfdf/>", None)
    assert [(r.doc_id, r.pos, r.subtype, r.page_no) for r in got] == [(1, 0, "Ink", 3), (1, 1, "Line", 4), (1, 2, "Ink", 5), (2, 0, "Square", 0), (2, 1, "Circle", 1)]


@pytest.mark.parametrize(
    ("color", "want"),
    [("#0000FF", [0, 0, 1]), ("#00ff00ff", [0, 1, 0]), ("#gg00ff", [1, 0, 1]), ("#fff", [1, 0, 0]), ("0.5, 1 ,0", [0.5, 1, 0]), ("255,127.5,0", [1, 0.5, 0]), ("x,0,1", [1, 0, 1 / 255]), ("1,2", [1, 0, 0]), ("", [1, 0, 0])],
)
def test_colours(spark, color, want):
    (row,) = read(spark, f"<xfdf><annots><text color='{color}'/></annots></xfdf>")
    assert row.color == pytest.approx(want)


def test_numbers_that_are_none(spark):
    (row,) = read(spark, "<xfdf><annots><text page='0' left='x' top='1.5' width='' height='-2'/></annots></xfdf>")
    assert (row.page_no, row.left, row.top, row.width, row.height) == (0, 0.0, 1.5, 100.0, -2.0)
    (row,) = read(spark, "<xfdf><annots><text page='2.5'/></annots></xfdf>")
    assert row.page_no == 0


@pytest.mark.parametrize("bad", ["<xfdf><annots><ink></annots></xfdf>", "no xml", "<xfdf><annots><ink x=1/></annots></xfdf>", "<xfdf><annots>"])
def test_malformed_files_fail(spark, bad):
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read(spark, bad)


def test_a_round_trip_keeps_every_column(spark):
    rows = [
        (1, "p", None, "Highlight", 'A "B" <c>', "x & 'y'\n ]]> z", 0, 1.25, 2.0, 30.0, 4.5, [0.0, 0.5, 1.0]), (1, "q&", "p", "Text", "me", "", 2, 1.0, 2.0, 3.0, 4.0, None), (2, "r", None, "Ink", None, None, 1, -1.0, 0.0, 0.0, 0.0, [0.2, 0.4]),
    ]
    a = spark.createDataFrame(rows, "doc_id long, annot_id string, in_reply_to string, subtype string, author string, contents string, page_no long, x double, y double, w double, h double, color array<double>")
    got = readers.read_xfdf(writers.write_xfdf(a, spark.createDataFrame([], "doc_id long, name string, value string"))).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.name, r.in_reply_to, r.subtype, r.author, r.contents, r.page_no, r.left, r.top, r.width, r.height) for r in got] == [
        (i, f"annot_{n}", None if t is None else f"annot_{t}", k, author or "", text or "", page, *box) for i, n, t, k, author, text, page, *box, _ in rows
    ]
    assert [r.color for r in got] == [[0.0, 127 / 255, 1.0], [1.0, 0.0, 0.0], [1.0, 0.0, 0.0]]


def test_the_parser_runs_once_a_document(spark):
    docs = spark.createDataFrame([(1, "<xfdf/>")], SCHEMA)
    plan = readers.read_xfdf(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1
