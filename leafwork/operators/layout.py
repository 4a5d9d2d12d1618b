"""Layout: from the ordered log of drawing operations to runs, rows, columns, paragraphs and wrapped lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from leafwork.functions.text import blank_trim, text_width, width_of
from leafwork.sources.writers import in_order, letters_of

from .runs import apart, changes, gathered, packed

PAGE = ["doc_id", "page_no"]


def so_far() -> WindowSpec:
    """A page's operations up to the one at hand."""
    return Window.partitionBy(*PAGE).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)


def page_text(ops: DataFrame) -> DataFrame:
    """A1: the text that a page shows, in order of the operations, with nothing between."""
    shown = ops.filter(F.col("op").isin("Tj", "TJ", "'", '"') & F.col("text").isNotNull())
    return shown.groupBy(*PAGE).agg(in_order(F.col("text"), "", "seq").alias("text"))


#: Operations that show text, and those that set or move the position.
SHOWS, PLACES = ("Tj", "TJ", "'", '"'), ("BT", "Tm", "Td", "TD", "T*", "'")


def text_runs(ops: DataFrame) -> DataFrame:
    """The text that a page shows, a row for each operation between BT and ET that shows some, with the state it is shown in.

    ``ops``: doc_id, page_no, seq, op, a, b, text, and, where there are such columns, c, name and kern. Gives seq, block (the number of its BT), grp (of the operation that
    placed it last), text, x, y, font_name, font_size, color, char_space, word_space, scale, kern. BT and Tm set the position, Td and TD move it, T* and '
    move down by the leading, which TL and TD set; ' moves first and then shows. Font and size (Tf: name, a), colour (rg: a, b, c), Tc, Tw, Tz and TL stay until they are set again.
    """
    null = F.lit(None)
    for c, kind in (("c", "double"), ("name", "string"), ("kern", "double")):
        if c not in ops.columns:
            ops = ops.withColumn(c, null.cast(kind))
    op, a, b = F.col("op"), F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    stays = lambda when, value, start: F.coalesce(F.last(F.when(when, value), ignorenulls=True).over(so_far()), F.lit(start))
    part = lambda v: F.lpad(F.lower(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v * 255))))), 2, "0")
    color = F.concat(F.lit("#"), part(a), part(b), part(F.coalesce("c", F.lit(0.0))))
    rows = ops.withColumns({
        "_reset": F.sum(op.isin("BT", "Tm").cast("int")).over(so_far()), "block": F.sum((op == "BT").cast("int")).over(so_far()), "grp": F.sum(op.isin(*PLACES).cast("int")).over(so_far()),
        "_inside": stays(op.isin("BT", "ET"), op == "BT", False), "_lead": stays(op.isin("TL", "TD"), F.when(op == "TL", a).otherwise(-b), 0.0), "font_name": stays((op == "Tf") & F.col("name").isNotNull(), F.col("name"), ""),
        "font_size": stays((op == "Tf") & F.col("a").isNotNull(), a, 12.0), "color": stays(op == "rg", color, "#000000"), "char_space": stays(op == "Tc", a, 0.0), "word_space": stays(op == "Tw", a, 0.0), "scale": stays(op == "Tz", a, 100.0),
    })
    move = Window.partitionBy(*PAGE, "_reset").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    dx = F.when(op.isin("Tm", "Td", "TD"), a).otherwise(0.0)
    dy = F.when(op.isin("Tm", "Td", "TD"), b).when(op.isin("T*", "'"), -F.col("_lead")).otherwise(0.0)
    rows = rows.withColumns({"x": F.sum(dx).over(move), "y": F.sum(dy).over(move)})
    shown = (op.isin(*SHOWS) & F.col("_inside") & (F.coalesce("text", F.lit("")) != "")) | ((op == "ET") & (F.col("block") > 0))
    state = ["font_name", "font_size", "color", "char_space", "word_space", "scale"]
    return rows.filter(shown).select(*PAGE, "seq", "op", "block", "grp", "text", "x", "y", *state, F.coalesce("kern", F.lit(0.0)).alias("kern"))


def interpret_text_ops(ops: DataFrame) -> DataFrame:
    """Text blocks, from BT to the next ET with some text between: (doc_id, page_no, block_id, text, x, y, height, font_name, font_size, color), of operations as ``text_runs`` takes them.

    A block stands where its first run does and has the font, size and colour that hold at its ET; what isn't closed is no block.
    """
    rows = text_runs(ops)
    shown, end = F.col("op") != "ET", F.col("op") == "ET"
    first = lambda c: F.min_by(F.when(shown, F.col(c)), F.when(shown, F.col("seq"))).alias(c)
    at_end = lambda c: F.min_by(F.when(end, F.col(c)), F.when(end, F.col("seq"))).alias(c)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct("seq", "text")))), lambda r: r["text"]), "").alias("text")
    blocks = rows.groupBy(*PAGE, "block").agg(text, first("x"), first("y"), *map(at_end, ("font_name", "font_size", "color")), F.bool_or(end).alias("_closed")).filter("_closed AND text <> ''")
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("block")) - 1
    return blocks.select(*PAGE, number.cast("long").alias("block_id"), "text", "x", "y", (F.col("font_size") * 1.2).alias("height"), "font_name", "font_size", "color")


def run_advance(runs: DataFrame) -> DataFrame:
    """``text_runs`` with ``advance``, how far each goes, and ``x``, where it starts: where the run before it in its group ended, the first where the group is placed.

    A run's width is its text's and a char_space for each character and a word_space for each space, less ``kern`` thousandths of the size, at the scale in percent.
    """
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    width = text_width(F.col("text"), F.col("font_size")) + F.length("text") * F.col("char_space") + spaces * F.col("word_space") - F.col("kern") / 1000 * F.col("font_size")
    before = Window.partitionBy(*PAGE, "grp").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.filter("op <> 'ET'").withColumn("advance", width * F.col("scale") / 100)
    return rows.withColumn("x", F.col("x") + F.coalesce(F.sum("advance").over(before), F.lit(0.0)))


def _starts(values: Column, apart) -> Column:
    """Of sorted values those that are ``apart`` from the last one taken; only these are gathered, a page has few."""
    take = lambda s, v: F.when((F.size(s) == 0) | apart(v, F.try_element_at(s, F.lit(-1))), F.concat(s, F.array(v))).otherwise(s)
    return F.aggregate(values, F.array().cast("array<double>"), take)


def _pages(blocks: DataFrame, tol: float, col_tol: float) -> DataFrame:
    """A page's blocks as one array, ``_blocks``, and where its rows and columns start. Blocks are packed by page before they are shuffled; what follows by page needs no further shuffle."""
    others = [c for c in blocks.columns if c not in PAGE]
    page = gathered(packed(blocks, PAGE), PAGE).select(*PAGE, *(F.flatten(c).alias(c) for c in others))
    starts = lambda c, asc, apart: _starts(F.sort_array(F.array_distinct(F.array_compact(c)), asc=asc), apart)
    rows, cols = starts("y", False, lambda v, s: F.abs(v - s) > tol), starts("x", True, lambda v, s: F.abs(v - s) >= col_tol)
    return page.select(*PAGE, rows.alias("_rows"), cols.alias("_cols"), F.arrays_zip(*others).alias("_blocks"))


def _row_of(y: Column) -> Column:
    return (F.size(F.filter("_rows", lambda s: s >= y)) - 1).cast("long")


def cluster_rows(blocks: DataFrame, tol: float = 5.0, col_tol: float = 18.0) -> DataFrame:
    """Each block with its row and column and whether its page is a table at all, with two columns or more.

    From the top, a block joins a row if it is within ``tol`` of the row's first block; from the left, a column starts
    ``col_tol`` or more from the start of the last. Within a page a block belongs to the nearest column. All columns of ``blocks`` are shuffled: give it those that are wanted.
    """
    rows = _pages(blocks, tol, col_tol).select(*PAGE, "_rows", "_cols", F.inline("_blocks"))
    near = F.array_min(F.transform("_cols", lambda c, i: F.struct(F.abs(F.col("x") - c).alias("d"), i.alias("i"))))["i"]
    return rows.select(*blocks.columns, _row_of(F.col("y")).alias("row"), near.cast("long").alias("col"), (F.size("_cols") >= 2).alias("is_table"))


def column_count(blocks: DataFrame, col_tol: float = 18.0) -> DataFrame:
    """How many columns a page has. Only where blocks start from the left is shuffled, once a run of blocks."""
    runs = packed(blocks.select(*PAGE, "x"), PAGE).select(*PAGE, F.array_distinct(F.array_compact("x")).alias("x"))
    cols = _starts(F.sort_array(F.array_distinct(F.flatten("x"))), lambda v, s: F.abs(v - s) >= col_tol)
    return gathered(runs, PAGE).select(*PAGE, F.nullif(F.size(cols), F.lit(0)).cast("long").alias("n_columns"))


#: Runs of blocks that are looked at together.
GRIDS_AT_ONCE = 256


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists of numbers, one after the other, nulls as 0, and which are null."""
    values = lists.flatten()
    return pc.fill_null(values, 0).to_numpy(zero_copy_only=False), pc.is_null(values).to_numpy(zero_copy_only=False)


def _numbered(page: np.ndarray, value: np.ndarray, falls: bool, new) -> tuple[np.ndarray, list[int], list[float]]:
    """For each value of a page the number of starts up to it, less one; then the page and the value of each start.

    A page's values rise, or fall, NaN the largest; those are starts that are ``new`` after the start before them.
    """
    if not len(value):
        return np.zeros(0, np.int64), [], []
    nan = np.isnan(value)
    order = np.lexsort((-value, ~nan, page) if falls else (value, page))
    p, v, n = page[order], value[order], nan[order]
    fresh = np.append(True, (p[1:] != p[:-1]) | ((v[1:] != v[:-1]) & ~(n[1:] & n[:-1])))
    number, pages, starts, k = [], [], [], -1
    for q, x in zip(p[fresh].tolist(), v[fresh].tolist(), strict=True):
        if not pages or q != pages[-1] or new(x, starts[-1]):
            k = 0 if not pages or q != pages[-1] else k + 1
            pages.append(q)
            starts.append(x)
        number.append(k)
    out = np.empty(len(value), np.int64)
    out[order] = np.array(number, np.int64)[np.cumsum(fresh) - 1]
    return out, pages, starts


class _Grids:
    """Cells of pages whose runs of blocks stand together, or with ``columns`` rows of so many cells; a page at a time is held."""

    def __init__(self, tol: float, col_tol: float, columns: int | None):
        self.tol, self.col_tol, self.columns = tol, col_tol, columns

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for a in range(0, whole.num_rows, GRIDS_AT_ONCE):
                held.append(whole.slice(a, GRIDS_AT_ONCE))
                last = held[-2:]
                if len(last) == 2 and not len(changes(pa.concat_batches([last[0].select(PAGE).slice(last[0].num_rows - 1), last[1].select(PAGE)]), PAGE)):
                    continue  # the page that is held goes on
                runs = pa.concat_batches(held)
                edges = changes(runs, PAGE)
                if len(edges):
                    yield self.out(runs.slice(0, edges[-1]))
                    runs = runs.slice(edges[-1])
                held = [runs]
        if held:
            yield self.out(pa.concat_batches(held))

    def out(self, runs: pa.RecordBatch) -> pa.RecordBatch:
        edges = np.append(0, changes(runs, PAGE))
        many = runs.column("x").value_lengths().to_numpy(zero_copy_only=False)
        page = np.repeat(np.repeat(np.arange(len(edges)), np.diff(np.append(edges, runs.num_rows))), many)
        (x, no_x), (y, no_y), (block, no_block) = (_flat(runs.column(c)) for c in ("x", "y", "block_id"))
        row = np.full(len(page), -1)
        row[~no_y] = _numbered(page[~no_y], y[~no_y], True, lambda v, s: not abs(v - s) <= self.tol)[0]
        col = self.nearest(page, x, ~no_x, len(edges))
        text = apart(runs.column("_t"))
        keep = np.flatnonzero(pc.binary_length(text).to_numpy(zero_copy_only=False) > 0)
        # from left to right, what has no place first; equal places by block and text
        keys = [c[keep] for c in (block, ~no_block, x, ~no_x, col, row, page)]
        order = np.lexsort(keys)
        same = np.ones(max(0, len(keep) - 1), bool)
        for k in keys:
            same &= (k[order][1:] == k[order][:-1]) | ((k[order][1:] != k[order][1:]) & (k[order][:-1] != k[order][:-1]))
        if same.any():
            words = np.empty(len(keep), object)
            words[:] = text.take(pa.array(keep)).to_pylist()
            order = np.lexsort([np.unique(words, return_inverse=True)[1], *keys])
        at = keep[order]
        page, row, col = page[at], row[at], col[at]
        line = np.append(True, (page[1:] != page[:-1]) | (row[1:] != row[:-1]))[: len(at)]
        first = np.flatnonzero(line | np.append(True, col[1:] != col[:-1])[: len(at)])
        cells = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), text.take(pa.array(at))), b" ").cast(pa.string())
        col, line = col[first], line[first]
        if self.columns is None:
            heads, rest = first, {"col": pa.array(col), "text": cells}
        else:
            if len(col) and col.max() >= self.columns:
                raise ValueError(f"no column {col.max()}")
            heads, nth = first[line], np.cumsum(line) - 1
            rest = {}
            for i in range(self.columns):
                own = np.full(len(heads), -1)
                own[nth[col == i]] = np.flatnonzero(col == i)
                rest[letters_of(i)] = cells.take(pa.array(own, mask=own < 0))
        names = {k: runs.column(k).take(pa.array(edges[page[heads]])) for k in PAGE} | {"row": pa.array(row[heads])} | rest
        return pa.RecordBatch.from_arrays(list(names.values()), list(names))

    def nearest(self, page: np.ndarray, x: np.ndarray, known: np.ndarray, pages: int) -> np.ndarray:
        """The nearest column of each block, the left one of two; 0 on pages of less than two columns and where there is no place."""
        col = np.zeros(len(page), np.int64)
        if not known.any():
            return col
        p, v = page[known], x[known]
        k, of, starts = _numbered(p, v, False, lambda a, s: not abs(a - s) < self.col_tol)
        starts = np.array(starts)
        n = np.bincount(of, minlength=pages)
        first = np.cumsum(n) - n
        left = first[p] + k
        right = np.minimum(left + 1, first[p] + n[p] - 1)
        with np.errstate(invalid="ignore"):
            found = k + (np.abs(starts[right] - v) < np.abs(v - starts[left]))
            for i in np.flatnonzero(~np.isfinite(v)):
                d = np.abs(v[i] - starts[first[p[i]] : first[p[i]] + n[p[i]]])
                found[i] = np.lexsort((d, np.isnan(d)))[0]
        col[known] = np.where(n[p] >= 2, found, 0)
        return col


def _grids(blocks: DataFrame, tol: float, col_tol: float, columns: int | None) -> DataFrame:
    """Blocks are packed by page, trimmed texts as one value, and dealt out by document: the one shuffle. A task gets its pages one after the other."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    runs = packed(blocks.select(*PAGE, F.col("block_id").cast("long"), F.col("x").cast("double"), F.col("y").cast("double"), blank_trim(F.col("text")).alias("_t")), PAGE, joined=("_t",))
    rest = "col long, text string" if columns is None else ", ".join(f"{letters_of(i)} string" for i in range(columns))
    return runs.repartition("doc_id").sortWithinPartitions(*PAGE).mapInArrow(_Grids(tol, col_tol, columns), f"doc_id {kinds['doc_id']}, page_no {kinds['page_no']}, row long, {rest}")


def grid_cells(blocks: DataFrame, tol: float = 5.0, col_tol: float = 18.0) -> DataFrame:
    """Cells (doc_id, page_no, row, col, text) of pages that are tables, trimmed texts joined by spaces from left to right; other pages are one column. Rows and columns are those of ``cluster_rows``."""
    return _grids(blocks, tol, col_tol, None)


def grid_sheet(blocks: DataFrame, columns: int, tol: float = 5.0, col_tol: float = 18.0) -> DataFrame:
    """What ``write_grid`` makes of ``grid_cells``, in their one shuffle; a document's rows are in one task."""
    if not 0 < columns <= 18278:
        raise ValueError("a sheet has 1 to 18278 columns")
    return _grids(blocks, tol, col_tol, columns)


def write_grid(cells: DataFrame, columns: int | None = None) -> DataFrame:
    """A spreadsheet's rows, pages one after the other, with ``columns`` columns, A, B, ..., or as many as the widest page has; a cell beyond them fails the query."""
    if columns is None:
        columns = int(cells.agg(F.max("col")).first()[0] or 0) + 1
    if columns > 18278:
        raise ValueError("a sheet has 18278 columns at most")
    beyond = F.col("col") >= columns
    checked = cells.withColumn("col", F.when(beyond, F.raise_error(F.concat(F.lit("no column "), F.col("col").cast("string"))).cast("long")).otherwise(F.col("col")))
    values = [F.max(F.when(F.col("col") == i, F.col("text"))).alias(letters_of(i)) for i in range(columns)]
    return checked.groupBy(*PAGE, "row").agg(*values)


def reading_order(blocks: DataFrame) -> DataFrame:
    """Each block's place on its page, rows from the top, in a row from the left, ties by block_id. A page's blocks are sorted where they are together."""
    page = _pages(blocks.select(*PAGE, "block_id", "x", "y"), 5.0, 18.0)
    placed = F.transform("_blocks", lambda b: F.struct(_row_of(b["y"]).alias("row"), b["x"].alias("x"), b["block_id"].alias("block_id")))
    return page.select(*PAGE, F.posexplode(F.array_sort(placed)).alias("place", "b")).select(*PAGE, "b.block_id", F.col("place").cast("long").alias("place"))


def paragraphs(blocks: DataFrame) -> DataFrame:
    """Blocks in reading order, joined where one goes on: a pitch of up to 1.8 times the font size, 10 at least, after a text that neither ends a sentence nor is a list item."""
    order = Window.partitionBy(*PAGE).orderBy(F.desc("y"), "x", "block_id")
    prev = lambda c: F.lag(c).over(order)
    rows = blocks.withColumn("_t", blank_trim(F.col("text")))
    pitch = prev("y") - F.col("y")
    ends = prev("_t").rlike(r"[。.!?:；;]$|^[・\-*]")
    goes_on = (pitch > 0) & (pitch <= 1.8 * F.greatest(prev("font_size"), F.col("font_size"), F.lit(10.0))) & ~ends
    rows = rows.withColumns({"_new": F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1), "_seq": F.row_number().over(order)})
    rows = rows.withColumn("para", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    joint = F.when((F.col("_new") == 0) & F.col("_t").rlike("^[A-Za-z0-9]"), F.concat(F.lit(" "), "_t")).otherwise(F.col("_t"))
    return rows.groupBy(*PAGE, "para").agg(in_order(joint, "", "_seq").alias("text"))


#: Runs of operations that are looked at together, and what an operation does to spans.
RUNS_AT_ONCE, OPENS, OPENS_TAGGED, CLOSES = 256, 1, 2, 3


class _Spans:
    """Which operations stay, in order of page and seq: those of no span that a tagged mark opens. The spans that are open are remembered from call to call."""

    def __init__(self):
        self.page, self.open, self.within = None, [], 0

    def stays(self, mark: np.ndarray, page: np.ndarray) -> np.ndarray:
        """``page``: a number for each row, which grows from page to page. A closing mark without an open span does nothing."""
        keep, since = np.ones(len(page), dtype=bool), 0  # where the outermost tagged span began
        marks = np.flatnonzero(mark)
        for i, n, what in zip(marks.tolist(), page[marks].tolist(), mark[marks].tolist(), strict=True):
            if n != self.page:
                if self.within:  # spans end with their page
                    keep[since : np.searchsorted(page, self.page, "right")] = False
                self.page, self.open, self.within = n, [], 0
            if what != CLOSES:
                tagged = what == OPENS_TAGGED
                self.open.append(tagged)
                since = i if tagged and not self.within else since
                self.within += tagged
            elif self.open and self.open.pop():
                self.within -= 1
                if not self.within:
                    keep[since : i + 1] = False
        if self.within:
            keep[since : np.searchsorted(page, self.page, "right")] = False
        return keep


def _in_place(page: np.ndarray, seq: pa.ChunkedArray) -> bool:
    ascends = pc.fill_null(pc.greater_equal(seq[1:], seq[:-1]), False).to_numpy(zero_copy_only=False)
    return bool((ascends | (page[1:] != page[:-1])).all()) and not seq.null_count


def _stripped(ops: DataFrame, tag: str, columns: list[str], streams: DataFrame | None = None) -> DataFrame:
    """Runs of a page's operations are packed before their shuffle, sorted by where they begin and read in one pass. Where runs of a page overlap, their rows wait and are sorted as they meet; else no page is held."""
    opens = F.col("op").isin("BDC", "BMC")
    mark = F.when(opens & (F.coalesce("name", F.lit("")) == tag), OPENS_TAGGED).when(opens, OPENS).when(F.col("op") == "EMC", CLOSES).otherwise(0).cast("byte")
    out, gone = ops.select(columns).schema, F.lit(None).cast("array<long>")
    read = [*dict.fromkeys(["seq", *(c for c in columns if c not in PAGE), *(["stream"] if streams is not None else [])])]
    runs = packed(ops.select(*PAGE, *read, mark.alias("_mark")), PAGE)
    runs = runs.withColumn("_from", F.when(~F.exists("seq", F.isnull), F.array_min("seq")))
    if streams is None:
        runs = runs.withColumn("_gone", gone)
    else:
        runs = runs.unionByName(streams.groupBy(*PAGE).agg(F.collect_set("stream").alias("_gone")), allowMissingColumns=True)
    runs = runs.repartition(*PAGE).sortWithinPartitions(*PAGE, F.col("_gone").isNull(), "_from")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, gone, number, last = _Spans(), {}, 0, None
        wait: tuple[pa.Table, np.ndarray] | None = None

        def kept(flat: pa.Table, page: np.ndarray) -> Iterator[pa.RecordBatch]:
            keep = spans.stays(flat.column("_mark").to_numpy(), page)
            for n, streams in gone.items():
                lo, hi = np.searchsorted(page, [n, n + 1])
                if lo < hi:
                    keep[lo:hi] &= ~pc.is_in(flat.column("stream").slice(lo, hi - lo), streams).to_numpy(zero_copy_only=False)
            yield from flat.select(columns).filter(pa.array(keep)).to_batches()

        for b in (whole.slice(at, RUNS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, RUNS_AT_ONCE)):
            heads = b.select(PAGE) if last is None else pa.concat_batches([last, b.select(PAGE)])
            anew = np.zeros(heads.num_rows, dtype=np.int64)
            anew[changes(heads, PAGE)] = 1
            pages = (number + np.cumsum(anew))[0 if last is None else 1 :]
            number, last = int(pages[-1]), b.select(PAGE).slice(b.num_rows - 1)
            gone = {n: v for n, v in gone.items() if n >= pages[0] or wait is not None and n >= wait[1][0]}
            for i in np.flatnonzero(b.column("_gone").is_valid().to_numpy(zero_copy_only=False)).tolist():
                gone[int(pages[i])] = b.column("_gone")[i].values
            rows = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(b.column("seq")), 0).to_numpy(zero_copy_only=False))
            flat = pa.Table.from_arrays([*(b.column(k).take(pa.array(rows)) for k in PAGE), *(b.column(c).flatten() for c in [*read, "_mark"])], [*PAGE, *read, "_mark"])
            page = pages[rows]
            if wait is not None:
                flat, page = pa.concat_tables([wait[0], flat]), np.append(wait[1], page)
            if not _in_place(page, flat.column("seq")):
                by = pc.sort_indices(pa.table({"page": page, "seq": flat.column("seq")}), [("page", "ascending"), ("seq", "ascending")], null_placement="at_start")
                flat, page = flat.take(by), page[by.to_numpy()]
            # of the last page, what lies before its last run is complete
            begun = b.column("_from")[b.num_rows - 1].as_py()
            waits = page == number
            if begun is not None:
                waits &= pc.fill_null(pc.greater_equal(flat.column("seq"), begun), False).to_numpy(zero_copy_only=False)
            cut = len(page) - int(waits.sum())
            yield from kept(flat.slice(0, cut), page[:cut])
            wait = (flat.slice(cut), page[cut:]) if cut < len(page) else None
        if wait is not None:
            yield from kept(*wait)

    return runs.mapInArrow(run, out)


def strip_spans(ops: DataFrame, tag: str = "Watermark") -> DataFrame:
    """Operations without those from a BDC named ``tag`` to its EMC, whatever is marked within it included."""
    return _stripped(ops, tag, ops.columns)


def strip_watermarks(ops: DataFrame, uses: DataFrame, annots: DataFrame, tag: str = "Watermark", columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Operations (with their ``stream``) without marked spans and without whole streams that use a resource named ``tag`` (doc_id, page_no, stream, resource), and annotations without those of that subtype. Of operations only ``columns``, where they are given."""
    streams = uses.filter(F.col("resource") == tag).select(*PAGE, "stream").dropna()
    kept = _stripped(ops, tag, columns or ops.columns, streams)
    return kept, annots.filter(F.coalesce("subtype", F.lit("")) != tag)


def image_placements(ops: DataFrame) -> DataFrame:
    """The size of each image drawn (Do), by the last cm (a, b, c, d) before it, which replaces the one before; 1 at least."""
    last = F.last(F.when(F.col("op") == "cm", F.struct("a", "b", "c", "d")), ignorenulls=True).over(so_far())
    rows = ops.withColumn("_m", F.coalesce(last, F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(1.0).alias("d")))).filter("op = 'Do'")
    return rows.select(*PAGE, "seq", "name", F.greatest(F.lit(1.0), F.hypot("_m.a", "_m.b")).alias("w"), F.greatest(F.lit(1.0), F.hypot("_m.c", "_m.d")).alias("h"))


def collapse_blank_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, pos, line) trimmed, of blank ones in a row the first alone."""
    rows = lines.withColumn("line", blank_trim(F.col("line")))
    prev = F.lag("line").over(Window.partitionBy("doc_id").orderBy("pos"))
    return rows.withColumn("_prev", prev).filter((F.col("line") != "") | F.col("_prev").isNull() | (F.col("_prev") != "")).drop("_prev")


#: Characters that may not begin, or may not end, a line.
NO_START = "、。，．・：；？！）］｝〉》」』】〕〟ヽヾゝゞ々ーァィゥェォッャュョヮヵヶぁぃぅぇぉっゃゅょゎ℃％‰"
NO_END = "（［｛〈《「『【〔'\"￥＄￡＃"
#: What stays whole in wrapping.
TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")


def wrapped(tokens: list[str], widths: Callable[[str], float], width: float) -> list[str]:
    """One paragraph's lines: the fold over its tokens (see ``wrap_text``)."""
    done, begin, n, now, last = [], 0, 0, 0.0, ""
    for i, t in enumerate(tokens):
        w = widths(t)
        if n == 0 or now + w <= width:
            begin, n, now = (i if n == 0 else begin), n + 1, now + w
        else:
            drags = n > 1 and (t in NO_START or last in NO_END)
            done.append("".join(tokens[begin : begin + n - drags]).rstrip(" "))
            if drags:
                begin, n, now = i - 1, 2, widths(last) + w
            elif t == " ":
                begin, n, now = i + 1, 0, 0.0
            else:
                begin, n, now = i, 1, w
        last = t
    return [*done, "".join(tokens[begin : begin + n])] if n or not done else done


def wrap_text(paras: DataFrame, width: float, size: float) -> DataFrame:
    """Paragraphs (doc_id, pos, line) as lines of up to ``width`` points: words of letters and digits stay whole, other characters stand alone.

    A character that may not begin a line brings the one before it down; one that may not end a line goes down itself.
    Spaces at a break go; an empty paragraph is an empty line; a word wider than the line has a line of its own. The fold over the tokens keeps where the current line
    begins and how wide it is. It runs over Arrow batches in linear time; a task remembers the widths of short words, 100,000 at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}

        def of(t: str) -> float:
            w = known.get(t)
            if w is None:
                w = width_of(t, size)
                if len(known) < 100_000 and len(t) <= 32:
                    known[t] = w
            return w

        for b in batches:
            docs, at, numbers, texts = [], [], [], []
            for doc, pos, line in zip(*(b.column(c).to_pylist() for c in ("doc_id", "pos", "line")), strict=True):
                for k, text in enumerate(wrapped(TOKEN.findall(line), of, width)):
                    docs.append(doc), at.append(pos), numbers.append(k), texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field("doc_id").type), pa.array(at, b.schema.field("pos").type), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "pos", "line_no", "text"])

    kind = {f.name: f.dataType.simpleString() for f in paras.schema}
    rows = paras.select("doc_id", "pos", F.coalesce("line", F.lit("")).alias("line"))
    return rows.mapInArrow(run, f"doc_id {kind['doc_id']}, pos {kind['pos']}, line_no int, text string")
