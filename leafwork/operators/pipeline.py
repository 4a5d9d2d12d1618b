"""The action wizard: a JSON list of steps as one lazy plan over a document's tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from . import annotations, graph, pages, rules

State = dict[str, DataFrame]


def pipeline_gate(fonts: DataFrame) -> DataFrame:
    """Per document whether it may be made archival, and the names of the fonts that stand against it."""
    own = rules.font_inventory(fonts)
    return own.select("doc_id", (F.size("not_embedded") == 0).alias("allowed"), F.col("not_embedded").alias("refused_for"))


def _watermark(s: State, p: dict) -> State:
    docs = s["page"].select("doc_id").distinct()
    null = lambda kind: F.lit(None).cast(kind)
    new = docs.select(
        "doc_id", F.concat(F.lit("wm-"), F.col("doc_id").cast("string")).alias("annot_id"), null("long").alias("page_no"), F.lit("Watermark").alias("subtype"), F.lit("").alias("author"), F.lit(p.get("text", "")).alias("contents"),
        *(null("double").alias(c) for c in ("x", "y", "w", "h")), F.lit(p.get("color", "#FF0000")).alias("color"), F.lit(p.get("opacity", 0.3)).cast("double").alias("opacity"), F.lit(p.get("rotation", 45)).cast("int").alias("angle"),
    )
    return s | {"annotation": annotations.add_annotations(s["annotation"], new, s["page"])}


def _number(s: State, p: dict) -> State:
    n = pages.page_numbers(s["page"], p.get("position", "bottom-center"), int(p.get("start_number", 1)), float(p.get("font_size", 12)))
    cols = s["text_block"].columns
    new = n.select("doc_id", "page_no", F.lit(-1).cast("long").alias("block_id"), "text", "x", "y")
    return s | {"text_block": s["text_block"].unionByName(new, allowMissingColumns=True).select(*cols)}


def _redact(s: State, p: dict) -> State:
    find = p.get("search_text", "")
    if not find:
        return s
    by = p.get("replacement", "[REDACTED]")
    return s | {"text_block": s["text_block"].withColumn("text", F.replace("text", F.lit(find), F.lit(by)))}


def _drop(*kinds: str) -> Callable[[State, dict], State]:
    return lambda s, p: s | {"object": s["object"].filter(~F.col("type").isin(*kinds))}


def _flatten(s: State, p: dict) -> State:
    fields = s["form_field"]
    filled, left = annotations.flatten_forms(fields, s["text_block"].select("doc_id", "page_no", "block_id", "text", "x", "y", "font_size"))
    known = s["text_block"].select("doc_id", "page_no", "block_id", *(c for c in s["text_block"].columns if c not in filled.columns))
    blocks = filled.join(known, ["doc_id", "page_no", "block_id"], "left").select(*s["text_block"].columns)
    return s | {"text_block": blocks, "form_field": left, "annotation": s["annotation"].filter("subtype <> 'Widget'")}


def _archive(s: State, p: dict) -> State:
    allowed = pipeline_gate(s["font"]).filter("NOT allowed").select("doc_id")
    return {k: v.join(allowed, "doc_id", "left_anti") for k, v in s.items()}


def _sanitize(s: State, p: dict) -> State:
    return s | {"object": rules.sanitize(s["object"], s["annotation"])[0], "annotation": s["annotation"].filter("false")}


def _rotate(s: State, p: dict) -> State:
    return s | {"page": s["page"].withColumn("rotation", pages.rotate(F.col("rotation"), int(p.get("rotation", 90))))}


def _optimize(s: State, p: dict) -> State:
    return s | {"object": graph.prune_unreachable(s["object"], s["ref_edge"], s["root"])[0]}


ACTIONS: dict[str, Callable[[State, dict], State]] = {
    "add_watermark": _watermark, "add_page_numbers": _number, "optimize": _optimize, "flatten_form": _flatten, "remove_metadata": _drop("Info", "Metadata"),
    "convert_to_pdfa": _archive, "redact_text": _redact, "sanitize": _sanitize, "sanitize_document": _sanitize, "rotate_pages": _rotate,
}
#: The tables that actions read.
NEEDS = {
    "add_watermark": ("page", "annotation"), "add_page_numbers": ("page", "text_block"), "optimize": ("object", "ref_edge", "root"), "flatten_form": ("form_field", "text_block", "annotation"), "remove_metadata": ("object",),
    "convert_to_pdfa": ("font",), "redact_text": ("text_block",), "sanitize": ("object", "annotation"), "sanitize_document": ("object", "annotation"), "rotate_pages": ("page",),
}


def run_pipeline(tables: State, spec: str) -> State:
    """The steps of ``{"name", "steps": [{"action_type", "params"}]}`` in order. An unknown action, or one whose tables aren't there, fails before anything is planned.

    ``tables``: page, text_block, annotation, object (doc_id, node, type), ref_edge (doc_id, src, dst), root (doc_id, node), form_field, font. Flattening makes the
    values of placed fields text of their pages, optimizing leaves the objects that roots reach. An empty search changes nothing; documents that may not be made archival drop out of all tables.
    """
    steps = json.loads(spec)["steps"]
    if unknown := [x["action_type"] for x in steps if x["action_type"] not in ACTIONS]:
        raise ValueError(f"unknown actions: {unknown}")
    if missing := {t for x in steps for t in NEEDS[x["action_type"]]} - tables.keys():
        raise ValueError(f"tables that the steps need: {sorted(missing)}")
    return reduce(lambda s, x: ACTIONS[x["action_type"]](s, x.get("params") or {}), steps, tables)
