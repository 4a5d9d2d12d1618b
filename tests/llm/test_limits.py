"""Lines exactly at a limit, and repeated rows, where a rule counts documents or pages."""

import pytest
from pyspark.sql import functions as F

from leafwork.llm import line_dedup, packing, quality_rules

PAGES = "page_id long, url string, html string, host string, _lines string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _host string, _pos long"


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://{h}/{i}", html, "clash", "clash") for i, h, html in rows], PAGES)


@pytest.mark.parametrize("most", [0, line_dedup.MOST_BROADCAST])  # lists joined by a shuffle, and broadcast
@pytest.mark.parametrize(("has", "dropped"), [(3, False), (4, True)])
def test_a_line_on_exactly_the_ratio_of_a_hosts_pages_stays(spark, monkeypatch, has, dropped, most):
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", most)
    rows = [(i, "h", f"<p>own {i}</p>" + ("<p>menu</p>" if i < has else "")) for i in range(10)]
    got = {r.page_id: r for r in line_dedup.line_dedup(pages(spark, rows)).collect()}
    assert all(r.n_dropped == (1 if dropped and i < has else 0) for i, r in got.items())


def test_repeated_pages_count_each(spark):
    # one page four times in ten: its lines are on more than 30 % of the pages, and every copy loses them
    rows = [(0, "h", "<p>a</p><p>b</p>")] * 4 + [(i, "h", f"<p>own {i}</p>") for i in range(1, 7)]
    got = line_dedup.line_dedup(pages(spark, rows)).collect()
    assert len(got) == 10 and sum(r.page_id == 0 and r.n_dropped == 2 and r.text == "" for r in got) == 4 and sum(r.n_dropped for r in got) == 8


def test_long_pages_and_no_pages(spark):
    long = "<p>" + "word " * 50_000 + "</p>" + "<p>menu</p>" * 1000
    got = line_dedup.line_dedup(pages(spark, [(1, "h", long), (2, "h", None)])).orderBy("page_id").collect()
    assert [(r.n_lines, r.n_dropped) for r in got] == [(1001, 0), (0, 0)]
    assert line_dedup.line_dedup(pages(spark, [])).collect() == []


@pytest.mark.parametrize(("others", "removed"), [(490, 0), (489, 1)])
def test_a_line_in_exactly_the_share_of_a_hosts_texts_stays(spark, others, removed):
    words = " ".join(f"w{k}" for k in range(12))
    rows = [(i, f"shared line\n{words} {i}") for i in range(10)] + [(100 + i, f"{words} other {i}") for i in range(others)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "clash", 1) for i, t in rows], DOCS)
    got = quality_rules.quality_rules(docs).filter("doc_id < 10").agg(F.min("n_removed_words"), F.max("n_removed_words")).first()
    assert tuple(got) == (2 * removed, 2 * removed)


def test_packing_takes_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "a b", "en", "s", 3, "clash", 1), (None, "a b", "en", "s", 3, "clash", 1), (3, None, "en", "s", None, "clash", 1)], DOCS)
    got = packing.best_fit_packing(docs).collect()
    assert sorted((r.doc_id or -1, r.length) for r in got) == [(-1, 2), (-1, 2), (3, 0)]
