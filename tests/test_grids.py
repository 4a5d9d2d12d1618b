"""Grids in one shuffle give what rows and columns, cells and sheets give apart, on odd inputs too."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from leafwork.functions.text import blank_trim
from leafwork.operators import layout
from leafwork.sources import files
from leafwork.sources.writers import in_order

BLOCK = "doc_id long, page_no long, block_id long, x double, y double, text string"


def apart(blocks):
    """Cells by SQL functions: a shuffle for rows and columns, and one for cells."""
    rows = layout.cluster_rows(blocks.select("doc_id", "page_no", "block_id", "x", "y", "text")).withColumn("col", F.when(F.col("is_table"), F.col("col")).otherwise(0)).withColumn("_t", blank_trim(F.col("text"))).filter("_t <> ''")
    return rows.groupBy("doc_id", "page_no", "row", "col").agg(in_order(F.col("_t"), " ", "x", "block_id").alias("text"))


def odd_blocks():
    r = random.Random(8)
    inf, nan = math.inf, math.nan
    words = [None, "", " ", "\t a\n", "b c", "漢", "é ", "z\u0085", '"q"', "\\N"]
    rows = [(d, p, r.randrange(30), r.choice([50.0, 51.5, 68.0, 68.5, 86.0, 150.0, -0.0, 0.0]), r.choice([700.0, 695.0, 694.9, 690.0, 12.5, 12.5]), r.choice(words)) for d in (None, 0, 1, 2) for p in (None, 0, 1, 5) for _ in range(r.randrange(1, 60))]
    rows += [(7, 0, i, x, y, f"t{i}") for i, (x, y) in enumerate((x, y) for x in (None, nan, inf, -inf, 3.0, 40.0) for y in (None, nan, inf, -inf, 1.0, 9.0))]
    rows += [(8, 0, i, None, None, f"n{i}") for i in range(4)] + [(8, 1, i, nan, nan, f"n{i}") for i in range(4)] + [(8, 2, None, 5.0, 5.0, w) for w in ("b", "a", "ä", "A")] + [(8, 3, 1, 5.0, 5.0, " ")]
    rows += [(9, 0, i, 50.0 + 100 * (i % 5), 10.0 * (i // 5), f"w{i}") for i in range(3000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_cells_in_one_shuffle_are_those_of_rows_and_columns(spark, batch):
    blocks = spark.createDataFrame(odd_blocks(), BLOCK).repartition(3)
    key = lambda x: tuple(map(repr, x))
    want = sorted(map(tuple, apart(blocks).collect()), key=key)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(map(tuple, layout.grid_cells(blocks).collect()), key=key)
        sheet = layout.grid_sheet(blocks, 6)
        rows = sorted(map(tuple, sheet.collect()), key=key)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want and rows == sorted(map(tuple, layout.write_grid(apart(blocks), 6).collect()), key=key)
    assert layout.grid_cells(blocks.filter("doc_id = 100")).collect() == [] and layout.grid_sheet(blocks.filter("doc_id = 100"), 2).collect() == []
    with pytest.raises(PySparkException, match="no column"):
        layout.grid_sheet(blocks, 2).collect()


def test_a_sheet_is_shuffled_once_and_its_files_are_not(spark, tmp_path):
    blocks = spark.createDataFrame(odd_blocks(), BLOCK).filter("doc_id is not null")
    sheet = layout.grid_sheet(blocks, 6)
    plan = sheet._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sheet.schema)
    files.write_bucketed(sheet, str(tmp_path / "g"), "csv", 3, ("doc_id", "page_no", "row"), True, compression="gzip")
    got = files.read_bucketed(spark, str(tmp_path / "g"), schema, "csv")
    key = lambda x: tuple(map(repr, x))
    # a cell that is the mark of nothing is read as nothing, as it was
    want = [tuple(None if v == "\\N" else v for v in x) for x in sheet.collect()]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    of = {}
    for x in got.select("doc_id", F.input_file_name().alias("f")).distinct().collect():
        of.setdefault(x.doc_id, []).append(x.f)
    assert len(of) == 6 and all(len(f) == 1 and f[0].endswith(".csv.gz") for f in of.values())
