"""Files in and out, formulas, repeated keys, ranges, sticky state and wrapping, by hand and against plain loops."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from leafwork.functions.formula import arithmetic
from leafwork.functions.text import text_width
from leafwork.operators import annotations, layout, pages, regions, text_ops
from leafwork.sources import files, readers, writers

GRID = "doc_id long, page_no long, row long, A string, B string"


def test_grids_survive_their_files(spark, tmp_path):
    cells = ["", None, " padded ", 'a "quoted", cell', "two\nlines", "\\N", "tab\there", "back\\slash", '"']
    rows = [(d, 0, i, c, cells[(i + d) % len(cells)]) for d in range(20) for i, c in enumerate(cells)]
    keep = [(d, p, i, None if a == "\\N" else a, None if b == "\\N" else b) for d, p, i, a, b in rows]  # what is written for null
    files.write_bucketed(spark.createDataFrame(rows, GRID), str(tmp_path / "g"), "csv", 4, ("doc_id", "row"))
    got = files.read_bucketed(spark, str(tmp_path / "g"), GRID, "csv").orderBy("doc_id", "row").collect()
    assert [tuple(r) for r in got] == keep
    assert len(list((tmp_path / "g").glob("bucket=*"))) == 4 and all(len(list(b.glob("part-*"))) == 1 for b in (tmp_path / "g").glob("bucket=*"))


def test_a_failed_writer_leaves_nothing_to_read(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 33, F.raise_error(F.lit("no")).cast("string")).otherwise("x").alias("html"))
    with pytest.raises(Exception, match="no"):
        files.write_bucketed(rows, str(tmp_path / "s"), "json", 8)
    assert not list((tmp_path / "s").glob("bucket=*")) and not (tmp_path / "s" / "_SUCCESS").exists()
    files.write_bucketed(rows.filter("doc_id <> 33"), str(tmp_path / "t"), "json", 8)
    with pytest.raises(PySparkException):  # what is there is not overwritten
        files.write_bucketed(rows.filter("doc_id <> 33"), str(tmp_path / "t"), "json", 8)


def test_documents_survive_their_files(spark, tmp_path):
    rows = [(1, "<p>é\n\"x\"</p>"), (2, ""), (3, None)]
    files.write_bucketed(spark.createDataFrame(rows, "doc_id long, html string"), str(tmp_path / "d"))
    got = files.read_bucketed(spark, str(tmp_path / "d"), "doc_id long, html string").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == rows


def test_only_files_of_the_given_names_and_times_are_read(spark, tmp_path):
    for name in ("a.pdf", "b.txt", "deep/c.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF-1.5\n1 0 obj x endobj")
    read = lambda *a: sorted(r.path.split("/")[-1] for r in files.read_files(spark, str(tmp_path), *a).collect())
    assert read("*.pdf") == ["a.pdf", "c.pdf"] and read() == ["a.pdf", "b.txt", "c.pdf"] and read("*", "2999-01-01T00:00:00") == []


def test_ocr_files_give_words_and_rejects(spark, tmp_path):
    head = "\t".join(readers.OCR_COLUMNS)
    (tmp_path / "a.tsv").write_text(head + "\n5\t1\t1\t1\t1\t1\t10\t20\tx\t40\t?\t word \nshort\tline\n5\t1\t1\t1\t1\t2\t10\t20\t30\t40\t96.5\t\"quoted\textra\n")
    (tmp_path / "b.tsv").write_text(head + "\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n")
    words, rejects = files.read_ocr_tsv(spark, str(tmp_path))
    got = [(r.file[-5:], r.level, r.width, r.conf, r.text) for r in words.orderBy("file", "word_num").collect()]
    assert got == [("a.tsv", 5, 0, -1.0, "word"), ("a.tsv", 5, 30, 96.5, '"quoted'), ("b.tsv", 4, 9, -1.0, "")]
    assert [(r.file[-5:], r.line) for r in rejects.collect()] == [("a.tsv", "short\tline")]


def test_packs_hold_many_files_in_few(spark, tmp_path):
    head = "\t".join(readers.OCR_COLUMNS)
    texts = {"a.tsv": head + "\n5\t1\t1\t1\t1\t1\t10\t20\tx\t40\t?\t word \nshort\tline\n5\t1\t1\t1\t1\t2\t10\t20\t30\t40\t96.5\t\"quoted\textra\n", "b.tsv": head + "\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n", "c.pdf": "é\n", "d.pdf": ""}
    rows = spark.createDataFrame(list(texts.items()), "n string, t string").coalesce(1)
    files.write_packed(rows, str(tmp_path / "p"), F.col("n"), F.col("t"))
    assert len(list((tmp_path / "p").glob("part-*"))) == 1
    got = {r.path: (bytes(r.content).decode(), r.length) for r in files.read_packed(spark, str(tmp_path / "p")).collect()}
    assert got == {n: (t, len(t.encode())) for n, t in texts.items() if t}
    read = files.parse_ocr_files(files.read_packed(spark, str(tmp_path / "p"), "%.tsv")).orderBy("file", "word_num").collect()
    assert [(r.file, r.level, r.width, r.conf, r.text) for r in read if r.reject is None] == [("a.tsv", 5, 0, -1.0, "word"), ("a.tsv", 5, 30, 96.5, '"quoted'), ("b.tsv", 4, 9, -1.0, "")]
    assert [(r.file, r.reject) for r in read if r.reject] == [("a.tsv", "short\tline")]


def test_a_bucket_of_many_documents_is_many_tasks(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if there were much
    try:
        files.write_bucketed(spark.range(400).select(F.expr("id % 100").alias("doc_id"), "id"), str(tmp_path / "b"), "json", 1, ("doc_id", "id"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before["spark.sql.adaptive.coalescePartitions.enabled"])
    parts = [[__import__("json").loads(x)["doc_id"] for x in p.read_text().splitlines()] for p in (tmp_path / "b").rglob("part-*")]
    assert len(parts) == 4 and all(p == sorted(p) for p in parts) and sum(len(set(p)) for p in parts) == 100


FORM = "doc_id long, name string, type string, value string"


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("a + b * 2", "10.0"), ("(a + b) * 2", "14.0"), ("a - b - 1", "0.0"), ("8 / a / 2", "1.0"), ("-a * -b", "12.0"), ("2 - -3", "5.0"), ("1 / (a - 4)", "0.0"), ("a / (b - 3) + 7", "0.0"), ("a / 0", "0.0"), (".5 + 1.", "1.5"), ("a*(b+(1))", "16.0"), ("missing + 1", "1.0"), ("text + 1", "1.0"),
    ],
)
def test_formulas(spark, formula, want):
    f = spark.createDataFrame([(1, "a", "Tx", "4"), (1, "b", "Tx", "3"), (1, "text", "Tx", "x")], FORM)
    got = annotations.calculated_field(f, "c", formula, ["a", "b", "missing", "text"]).filter("name = 'c'").first()
    assert got.value == want


@pytest.mark.parametrize("bad", ["a ** b", "a +", "(a", "a)", "a b", "", "a / / b", "1e5", "a; b", "* a", "f(a)", "a % b", "c + 1"])
def test_what_is_no_formula_is_refused_before_planning(spark, bad):
    f = spark.createDataFrame([], FORM)
    with pytest.raises(ValueError):
        annotations.calculated_field(f, "c", bad, ["a", "b"])


def test_formulas_are_what_python_says(spark):
    r = random.Random(3)
    value = {"a": 4.0, "b": -2.5, "c": 7.0}

    def make(depth):
        kind = r.randrange(5) if depth else 0
        if kind == 0:
            return r.choice([*value, "2", "0.5"])
        return f"({make(depth - 1)})" if kind == 1 else f"-{make(depth - 1)}" if kind == 2 else f"{make(depth - 1)} {r.choice('+-*/')} {make(depth - 1)}"

    formulas = [make(4) for _ in range(40)]
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in value.items())).select(*(arithmetic(f, F.col).alias(f"f{i}") for i, f in enumerate(formulas))).first()
    for f, got in zip(formulas, row, strict=True):
        try:
            assert got == pytest.approx(eval(f, {}, value))
        except ZeroDivisionError:
            assert got is None


def test_repeated_keys_multiply_no_rows(spark):
    batch = spark.createDataFrame([(1, 1, "n", None, 0), (1, 2, "n", None, 0), (1, 3, "m", "n", 0), (1, 4, "n", None, 9)], "doc_id long, id long, name string, in_reply_to string, page_no long")
    page = spark.createDataFrame([(1, 0)], "doc_id long, page_no long")
    assert {(r.id, r.reply_to_id) for r in annotations.resolve_reply_names(batch, page).collect()} == {(1, None), (2, None), (3, 2)}
    f = spark.createDataFrame([(1, "a", "Tx", "old")], FORM)
    values = spark.createDataFrame([(1, "a", "z", 1), (1, "a", "b", 2)], "doc_id long, name string, new_value string, seq long")
    assert [r.value for r in regions.fill_forms(f, values).collect()] == ["b"] and [r.value for r in regions.fill_forms(f, values.drop("seq")).collect()] == ["z"]
    b = spark.createDataFrame([(1, 0, 0, "ab", "F", 10.0)], "doc_id long, page_no long, block_id long, text string, font_name string, font_size double")
    fonts = spark.createDataFrame([("F", 97, [500.0, 500.0], False, 1000.0), ("F", 97, [400.0, 400.0], True, 1000.0)], "font_name string, first int, widths array<double>, composite boolean, default double")
    assert [r.width for r in text_ops.width_with_font(b, fonts).collect()] == [10.0]
    assert [r.text for r in text_ops.replace_text(b, fonts, "a", "x").collect()] == ["ab"]


@pytest.mark.parametrize(("src", "dst"), [(0, 2), (2, 0), (-1, 0), (0, -1), (9, 9)])
def test_pages_out_of_range_are_refused(spark, src, dst):
    p = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, page_no long")
    with pytest.raises(PySparkException):
        pages.move_page(p, spark.createDataFrame([(1, src, dst)], "doc_id long, src long, dst long")).collect()


def test_fonts_are_replaced_where_widths_allow(spark):
    rows = [(1, "Arial", "TrueType", True), (1, "Foo", "TrueType", True), (1, "/Foo ", "TrueType", False), (1, "Foo", "Type0", False), (1, "Times", "TrueType", None)]
    fonts = spark.createDataFrame(rows, "doc_id long, name string, subtype string, has_widths boolean")
    status = lambda old, new: [r.status for r in text_ops.replace_font(fonts, old, new).collect()]
    assert status("arial", "Helvetica-Bold") == ["replaced", "unchanged", "unchanged", "unchanged", "unchanged"]
    assert status("ARIAL", "Courier") == ["metrics", "unchanged", "unchanged", "unchanged", "unchanged"]
    assert status(" /foo", "Bar") == ["unchanged", "metrics", "replaced", "composite", "unchanged"]
    assert status("Foo", "foo") == ["unchanged"] * 5
    with pytest.raises(PySparkException):
        status("nowhere", "Bar")


OPS = "doc_id long, page_no long, seq long, op string, a double, b double, c double, name string, text string, kern double"


def test_states_stay_until_they_are_set_again(spark):
    log = [("rg", 1.0, 0.5, 0.0, None, None), ("Tf", 10.0, None, None, "F1", None), ("BT",), ("Tm", 5.0, 6.0), ("Tj", None, None, None, None, "one "), ("Tc", 1.0), ("Tj", None, None, None, None, "two"), ("rg", 0.0, 0.0, 1.0), ("ET",), ("Tj", None, None, None, None, "lost"),
           ("BT",), ("Td", 1.0, 2.0), ("Tf", 20.0, None, None, "F2"), ("TJ", None, None, None, None, "end", 50.0), ("Tj", None, None, None, None, "!"), ("ET",), ("BT",), ("Tj", None, None, None, None, "open")]
    ops = spark.createDataFrame([(1, 0, i, *(list(r) + [None] * 7)[:7]) for i, r in enumerate(log)], OPS)
    got = [(r.text, r.x, r.y, r.font_name, r.font_size, r.color) for r in layout.interpret_text_ops(ops).orderBy("block_id").collect()]
    assert got == [("one two", 5.0, 6.0, "F1", 10.0, "#0000ff"), ("end!", 1.0, 2.0, "F2", 20.0, "#0000ff")]
    runs = {r.text: r for r in layout.run_advance(layout.text_runs(ops)).collect()}
    width = lambda t, size: spark.range(1).select(text_width(F.lit(t), size).alias("w")).first().w
    assert runs["two"].x == pytest.approx(5 + width("one ", 10)) and runs["two"].advance == pytest.approx(width("two", 10) + 3)
    assert runs["end"].advance == pytest.approx(width("end", 20) + 3 - 1) and runs["!"].x == pytest.approx(1 + runs["end"].advance) and runs["one "].color == "#ff7f00"


def brute_wrap(line, width, size, w):
    import re

    done, cur = [], []
    for t in re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9]", line):
        if not cur or sum(map(w, cur)) + w(t) <= width:
            cur.append(t)
        elif len(cur) > 1 and (t in layout.NO_START or cur[-1] in layout.NO_END):
            done.append("".join(cur[:-1]).rstrip(" "))
            cur = [cur[-1], t]
        else:
            done.append("".join(cur).rstrip(" "))
            cur = [] if t == " " else [t]
    return done + ["".join(cur)] if cur or not done else done


def test_wrapping_is_the_fold_by_hand(spark):
    r = random.Random(9)
    lines = ["".join(r.choice(["word ", "a", "、", "「", "」", "漢", " ", "x1 ", "  ", "long" * 8]) for _ in range(r.randrange(40))) for _ in range(40)] + ["", " ", "x" * 100, None]
    tokens = sorted({t for line in lines if line for t in __import__("re").findall(r"[A-Za-z0-9]+|[^A-Za-z0-9]", line)})
    widths = {x.t: x.w for x in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", text_width(F.col("t"), 10).alias("w")).collect()}
    p = spark.createDataFrame([(1, i, line) for i, line in enumerate(lines)], "doc_id long, pos long, line string")
    got = {}
    for x in layout.wrap_text(p, 60, 10).orderBy("pos", "line_no").collect():
        got.setdefault(x.pos, []).append(x.text)
    assert got == {i: brute_wrap(line or "", 60, 10, widths.__getitem__) for i, line in enumerate(lines)}


def test_long_paragraphs_wrap_in_linear_time(spark):
    p = spark.createDataFrame([(1, 0, "word " * 100_000)], "doc_id long, pos long, line string")
    rows = layout.wrap_text(p, 400, 11)
    assert "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()
    texts = [r.text for r in rows.orderBy("line_no").collect()]
    assert sum(t.count("word") for t in texts) == 100_000 and len(set(texts[:-1])) == 1


def test_a_sink_of_reports_writes_files(spark, tmp_path):
    d = spark.createDataFrame([(1, 0, 0, "added", "", "new <b>")], "doc_id long, page_no long, seq long, kind string, original_text string, revised_text string")
    files.write_bucketed(writers.diff_report_html(d), str(tmp_path / "r"), "json", 2)
    assert "new &lt;b&gt;" in files.read_bucketed(spark, str(tmp_path / "r"), "doc_id long, html string").first().html


def test_font_widths_are_looked_up_in_one_pass_over_a_text(spark):
    fonts = spark.createDataFrame([("F", 97, [500.0, 0.0, None, 250.0], False, 1000.0)], "font_name string, first int, widths array<double>, composite boolean, default double")
    b = spark.createDataFrame([(1, 0, i, t, "F", 10.0) for i, t in enumerate(["ad", "abz", "漢a", "xyz", "", None])], "doc_id long, page_no long, block_id long, text string, font_name string, font_size double")
    rows = text_ops.width_with_font(b, fonts)
    assert "ArrowEvalPython" in rows._jdf.queryExecution().executedPlan().toString()
    assert [round(r.width, 6) for r in rows.orderBy("block_id").collect()] == [7.5, 16.0, 15.0, 16.5, 0.0, 0.0]
