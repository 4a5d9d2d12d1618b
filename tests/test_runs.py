"""What is packed before it is shuffled: rows in any order, keys in several runs and batches, nulls, and what the plans do."""

import random

from pyspark.sql import functions as F

from leafwork.operators import layout, ocr
from leafwork.operators.runs import gathered, packed

WORD = "doc_id long, page_no long, level int, block_num long, par_num long, line_num long, word_num long, x_left double, y_top double, width double, height double, conf double, text string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gathered_runs_are_the_groups_in_any_order_and_over_batches(spark):
    r = random.Random(3)
    rows = [(r.choice([None, *range(40)]), r.choice([None, "a", "b"]), i) for i in range(3000)] + [(99, "z", i) for i in range(900)]
    want = {}
    for a, b, v in rows:
        want.setdefault((a, b), set()).add(v)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 7)
    try:
        runs = packed(spark.createDataFrame(rows, "a long, b string, v long").repartition(3), ["a", "b"])
        got = gathered(runs, ["a", "b"]).select("a", "b", F.flatten("v").alias("v")).collect()
    finally:
        spark.conf.set(batch, before)
    assert len(got) == len(want) and all(len(x.v) == len(want[x.a, x.b]) and set(x.v) == want[x.a, x.b] for x in got)


def test_lines_of_scattered_words_are_read_in_order(spark):
    r = random.Random(4)
    words = [(d, 0, 5, 0, 0, n, w, 10.0 * w, 5.0, 8.0, 9.0, r.choice([-1.0, 50.0, 70.0]), r.choice(["a\nb", f"w{w}", " ", "漢"])) for d in range(5) for n in range(4) for w in range(9)]
    words += [(1, 0, 5, 0, 0, 0, 3, 500.0, 5.0, 8.0, 9.0, None, "twice"), (1, 0, 4, 0, 0, 1, 0, 1.0, 2.0, 3.0, 4.0, -1.0, ""), (7, 0, 4, 0, 0, 0, 0, 1.0, 2.0, 3.0, 4.0, -1.0, "")]
    r.shuffle(words)
    df = spark.createDataFrame(words, WORD)
    got = {(x.doc_id, x.line_num): x for x in ocr.ocr_lines(df).collect()}
    kept = {}
    for x in words:
        if x[2] == 5 and x[12].strip():
            kept.setdefault((x[0], x[5]), []).append(x)
    assert got.keys() == kept.keys()
    for k, ws in kept.items():
        sure = [x[11] for x in ws if x[11] is not None and x[11] >= 0]
        box = (1.0, 3.0) if k == (1, 1) else (min(x[7] for x in ws), max(x[7] + 8 for x in ws) - min(x[7] for x in ws))
        assert got[k].text == " ".join(x[12] for x in sorted(ws, key=lambda x: (x[6], x[12]))) and (got[k].x_left, got[k].width) == box
        assert abs(got[k].conf - (sum(sure) / len(sure) if sure else 80)) < 1e-9


def test_words_are_packed_before_their_shuffle_and_lines_shuffled_once(spark):
    words = spark.createDataFrame([(1, 0, 5, 0, 0, 0, w, 10.0 * w, 5.0, 8.0, 9.0, 50.0, "the") for w in range(200)], WORD)
    lines = ocr.ocr_lines(words)
    assert "ObjectHashAggregate" not in plan_of(lines) and "MapInArrow" in plan_of(lines).split("Exchange")[-1]
    blocks = spark.createDataFrame([(1, 0, 0, 50.0, 800.0, 10.0)], "doc_id long, page_no long, block_id long, x double, y double, advance double")
    out = ocr.redact_by_ocr(blocks, words, "The")
    assert out.count() == 1
    out.collect()
    assert "ReusedExchange" in plan_of(out)


def test_grids_shuffle_packed_pages_and_no_more_than_is_asked_for(spark):
    r = random.Random(5)
    rows = [(d, 0, i, f"text{i}", 50.0 + 100 * (i % 5) + i % 3, 790.0 - 16 * (i // 5) + i % 4) for d in range(3) for i in range(40)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, page_no long, block_id long, text string, x double, y double").repartition(3)
    cells = {(x.doc_id, x.block_id): (x.row, x.col) for x in layout.cluster_rows(df).collect()}
    assert cells == {(d, i): (i // 5, i % 5) for d in range(3) for i in range(40)}
    assert {(x.doc_id, x.block_id): x.place for x in layout.reading_order(df).collect()} == {(d, i): i for d in range(3) for i in range(40)}
    assert {(x.doc_id, x.n_columns) for x in layout.column_count(df).collect()} == {(d, 5) for d in range(3)}
    for out in (layout.cluster_rows(df), layout.reading_order(df), layout.column_count(df)):
        assert "ObjectHashAggregate" not in plan_of(out) and "Window" not in plan_of(out) and "MapInArrow" in plan_of(out)
    assert "text" not in plan_of(layout.reading_order(df)).split("Exchange")[1] and layout.column_count(df.withColumn("x", F.lit(None).cast("double"))).first().n_columns is None
