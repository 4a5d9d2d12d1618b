"""Operators on page texts and text blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from leafwork.functions.text import occurrences, text_width, width_of

BLOCK = ["doc_id", "page_no", "block_id"]


def search_text(pages: DataFrame, term: str) -> DataFrame:
    """Pages whose text has ``term``, case-sensitive, with the number of matches that don't overlap."""
    return pages.filter(F.col("text").contains(term)).select("doc_id", "page_no", occurrences(F.col("text"), term).alias("matches"), "text") if term else pages.filter("false").select("doc_id", "page_no", F.lit(0).cast("long").alias("matches"), "text")


def font_key(fonts: DataFrame) -> list[str]:
    """Fonts are told by name, within their document where the table has one; how they are joined is left to their size."""
    return ["doc_id", "font_name"] if "doc_id" in fonts.columns else ["font_name"]


@F.pandas_udf(DoubleType())
def _by_table(text: pd.Series, first: pd.Series, widths: pd.Series, size: pd.Series) -> pd.Series:
    """Widths by the fonts' tables, codes below 256 only; what isn't in the table is measured as one run. Null where nothing is in it."""
    out = []
    for t, start, table, points in zip(text, first, widths, size, strict=True):
        if table is None or pd.isna(start) or pd.isna(points):
            out.append(None)
            continue
        at = {chr(int(start) + i): w for i, w in enumerate(table) if 0 <= int(start) + i < 256 and w is not None and w > 0}
        known = sum(at[c] for c in t if c in at)
        out.append(known / 1000 * points + width_of("".join(c for c in t if c not in at), points) if known > 0 else None)
    return pd.Series(out, dtype="float64")


def width_with_font(blocks: DataFrame, fonts: DataFrame) -> DataFrame:
    """P5: each block's width by its font's table.

    ``fonts``: font_name, first, widths array<double>, composite boolean, default double (thousandths of the size). A
    character whose code the table has with a positive width counts that much, others their class's width; a run none of
    whose characters was in the table has class widths throughout; a composite font has its default for every character.
    """
    # a font that is listed twice counts once, with its larger entry
    one = fonts.groupBy(*font_key(fonts)).agg(F.max(F.struct("first", "widths", "composite", "default")).alias("_f")).select(*font_key(fonts), "_f.*")
    joined = blocks.join(one, font_key(fonts), "left")
    chars = F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda c: c != "")
    size = F.col("font_size")
    by_table = _by_table(F.coalesce("text", F.lit("")), F.col("first").cast("int"), F.col("widths"), size.cast("double"))
    width = F.when(F.coalesce("composite", F.lit(False)), F.size(chars) * F.col("default") / 1000 * size).otherwise(F.coalesce(by_table, text_width(F.col("text"), size)))
    return joined.select(*blocks.columns, width.alias("width"))


def dict_decode(codes: DataFrame, cmap: DataFrame) -> DataFrame:
    """Texts of sequences (doc_id, pos, code) by a table (code, mapped); a code without an entry is that code point."""
    mapped = codes.join(cmap, [*(["doc_id"] if "doc_id" in cmap.columns else []), "code"], "left")
    char = F.coalesce("mapped", F.decode(F.unhex(F.lpad(F.hex("code"), 8, "0")), "UTF-32"))
    return mapped.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", char.alias("c")))), lambda x: x["c"]), "").alias("text"))


def replace_text(blocks: DataFrame, fonts: DataFrame, find: str, by: str, page: int | None = None, color: str | None = None) -> DataFrame:
    """P20: ``find`` becomes ``by`` in the blocks of one page or all; blocks in composite fonts (font_name, composite) stay whole; ``color`` goes to changed blocks alone."""
    # a font that is listed twice is composite if either entry says so
    known = blocks.join(fonts.groupBy(*font_key(fonts)).agg(F.bool_or("composite").alias("composite")), font_key(fonts), "left")
    hit = F.col("text").contains(find) & ~F.coalesce("composite", F.lit(False))
    if page is not None:
        hit &= F.col("page_no") == page
    changed = {"text": F.when(hit, F.replace("text", F.lit(find), F.lit(by))).otherwise(F.col("text"))}
    if color:
        changed["color"] = F.when(hit, color).otherwise(F.col("color"))
    return known.withColumns(changed).select(*blocks.columns)


def replace_in_annotations(annots: DataFrame, find: str, by: str) -> DataFrame:
    """P20 for what annotations say."""
    return annots.withColumn("contents", F.replace("contents", F.lit(find), F.lit(by)))


def restyle_text(blocks: DataFrame, page: int, color: str | None = None, old_color: str | None = None, size: float | None = None) -> DataFrame:
    """Colour, where it was ``old_color`` if that is given, and font size of one page's text."""
    here = F.col("page_no") == page
    if color:
        was = here if old_color is None else here & (F.lower("color") == old_color.lower())
        blocks = blocks.withColumn("color", F.when(was, color).otherwise(F.col("color")))
    if size is not None:
        blocks = blocks.withColumn("font_size", F.when(here, float(size)).otherwise(F.col("font_size")))
    return blocks


#: What the names of fonts with equal widths contain, by family.
METRIC_FAMILIES = {"sans": ("helvetica", "arial"), "serif": ("times", "timesnewroman"), "mono": ("courier", "couriernew")}


def same_metrics(a: Column, b: Column) -> Column:
    """Whether both names are of one family of equal widths; a name of none is like no other."""
    of = lambda name, marks: F.greatest(*(F.lower(name).contains(m) for m in marks))
    families = [of(a, marks) & of(b, marks) for marks in METRIC_FAMILIES.values()]
    return families[0] | families[1] | families[2]


def replace_font(fonts: DataFrame, old: str, new: str) -> DataFrame:
    """Per font (doc_id, name, subtype, has_widths, ...): its new name, or why it is refused. If no font has the old name, the query fails; the same name changes nothing.

    Names match without regard to case, a leading slash or spaces around. Composite fonts are refused, and fonts with widths of their own unless both
    names are of one family of equal widths.
    """
    clean = lambda n: n.strip().lstrip("/")
    old, new = clean(old), clean(new)
    if old.lower() == new.lower():
        return fonts.withColumns({"status": F.lit("unchanged"), "new_name": F.col("name")})
    match = F.lower(F.ltrim(F.trim("name"), F.lit("/"))) == old.lower()
    own = F.coalesce("has_widths", F.lit(False))
    status = F.when(~F.coalesce(match, F.lit(False)), "unchanged").when(F.col("subtype") == "Type0", "composite").when(own & ~same_metrics(F.lit(old), F.lit(new)), "metrics").otherwise("replaced")
    out = fonts.withColumn("status", status).withColumn("new_name", F.when(F.col("status") == "replaced", new).otherwise(F.col("name")))
    # a row that fails the query, if there is nothing to replace
    none = fonts.agg(F.count_if(match).alias("n")).filter("n = 0").select(F.raise_error(F.lit(f"no font is named {old}")).cast("string").alias("status"))
    return out.unionByName(none, allowMissingColumns=True)


def apply_changes(blocks: DataFrame, changes: DataFrame) -> DataFrame:
    """Moves, edits and deletes by (doc_id, page_no, block_id); ``changes``: kind, new_x, new_y, new_text, one row per block at most. Edits keep the font size."""
    joined = blocks.join(changes.select(*BLOCK, "kind", "new_x", "new_y", "new_text"), BLOCK, "left").filter("kind IS NULL OR kind <> 'delete'")
    moved, edited = F.coalesce(F.col("kind") == "move", F.lit(False)), F.coalesce(F.col("kind") == "edit", F.lit(False))
    out = {"x": F.when(moved, F.col("new_x")).otherwise(F.col("x")), "y": F.when(moved, F.col("new_y")).otherwise(F.col("y")), "text": F.when(edited, F.col("new_text")).otherwise(F.col("text"))}
    return joined.withColumns(out).select(*blocks.columns)


def content_fingerprint(objects: DataFrame) -> DataFrame:
    """A 16-byte id of each document: the first half of the SHA-256 of its version and its sorted object ids."""
    ids = F.array_join(F.array_sort(F.collect_list(F.col("object_id").cast("string"))), ",")
    return objects.groupBy("doc_id", "version").agg(F.substring(F.sha2(F.concat("version", F.lit("|"), ids), 256), 1, 32).alias("fingerprint"))


def pages_with_text(ops: DataFrame) -> DataFrame:
    """Pages that show text at all, by a filter on ``op`` that reaches the scan."""
    return ops.filter(F.col("op").isin("Tj", "TJ", "'", '"')).select("doc_id", "page_no").distinct()
