"""Scalar functions on text, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Width of a character of each class as a part of the font size. A character belongs to the first
#: class that has it; what none has is as wide as the size.
WIDTHS = (
    (r"[ ilIj!.:;']", 0.28),
    (r"[frt()\[\]]", 0.35),
    (r"[mwMW]", 0.85),
    (r"[A-Za-z0-9]", 0.55),
    (r"""["#$%&*+,\-/<=>?@\\^_`{|}~]""", 0.40),
    (r"[、。，．]", 0.65),
    (r"[「」『』（）]", 0.60),
)
OTHER_WIDTH = 1.0


def blank_trim(c: Column) -> Column:
    """Without white space at both ends, of any kind and not just spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def text_lines(c: Column) -> Column:
    """A text's lines: carriage returns go, and a final newline starts no further line; an empty or null text has one empty line."""
    plain = F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return F.split(F.regexp_replace(plain, r"\n$", ""), "\n")


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` is in the text, case-sensitive, without overlaps; an empty term is nowhere."""
    if not term:
        return F.lit(0).cast("long")
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def escape_markup(c: Column, flavor: str) -> Column:
    """Markup escapes: ``xml4`` (four characters; control characters go), ``xml5`` and ``html5`` (five characters)."""
    pairs = {
        "xml4": (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")),
        "xml5": (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")),
        "html5": (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")),
        "html3": (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")),
    }[flavor]
    if flavor == "xml4":
        c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def decode_bytes(c: Column) -> Column:
    """Bytes as text. FE FF in front: UTF-16BE; else UTF-8, with replacement characters where it is none."""
    rest = F.unhex(F.substring(F.hex(c), 5, 2147483647))
    return F.when(F.hex(c).startswith("FEFF"), F.decode(rest, "UTF-16BE")).otherwise(F.make_valid_utf8(c.cast("string")))


def encode_text(c: Column) -> Column:
    """ASCII as it is; any other text as UTF-16BE behind FE FF."""
    plain = ~c.rlike(r"[^\x00-\x7F]")
    return F.when(plain, F.encode(c, "UTF-8")).otherwise(F.unhex(F.concat(F.lit("FEFF"), F.hex(F.encode(c, "UTF-16BE")))))


def text_width(c: Column, size: Column | float) -> Column:
    """Estimated width of a run: every character has its class's part of the font size; null counts as empty."""
    rest = F.coalesce(c, F.lit(""))
    total = F.lit(0.0)
    for chars, part in WIDTHS:
        less = F.regexp_replace(rest, chars, "")
        total, rest = total + (F.length(rest) - F.length(less)) * part, less
    return (total + F.length(rest) * OTHER_WIDTH) * (F.lit(float(size)) if isinstance(size, int | float) else size)


def width_of(text: str, size: float) -> float:
    """``text_width`` of one string, by the same sums in the same order, for loops inside tasks."""
    total = 0.0
    for chars, part in WIDTHS:
        less = re.sub(chars, "", text)
        total, text = total + (len(text) - len(less)) * part, less
    return (total + len(text) * OTHER_WIDTH) * float(size)


def split_columns(line: Column) -> Column:
    """Columns of a line: at tabs if it has any, else at white space if it has two spaces in a row, else at commas, else the whole; empty ones go."""
    parts = (
        F.when(line.contains("\t"), F.split(line, "\t"))
        .when(line.contains("  "), F.split(line, r"\s+"))
        .when(line.contains(","), F.split(line, ","))
        .otherwise(F.array(line))
    )
    return F.filter(F.transform(parts, blank_trim), lambda x: x != "")


def parse_page_spec(spec: Column, pages: Column) -> Column:
    """``"1-5, 8, 13-11"`` as sorted page numbers from 0, each once and within the document; what is no number or range is ignored, reversed ranges are turned."""
    part = lambda p, i: F.try_to_number(F.split(p, "-")[i], F.lit("999999999")).cast("int")
    clean = F.filter(F.transform(F.split(spec, ","), lambda p: F.regexp_replace(p, r"\s+", "")), lambda p: p.rlike(r"^\d{1,9}(-\d{1,9})?$"))
    ends = F.transform(clean, lambda p: F.struct(part(p, 0).alias("a"), F.when(p.contains("-"), part(p, 1)).otherwise(part(p, 0)).alias("b")))
    # only what lies within the document is counted out
    inside = F.transform(ends, lambda e: F.struct(F.greatest(F.lit(1), F.least(e["a"], e["b"])).alias("lo"), F.least(pages.cast("int"), F.greatest(e["a"], e["b"])).alias("hi")))
    numbers = F.flatten(F.transform(F.filter(inside, lambda e: e["lo"] <= e["hi"]), lambda e: F.sequence(e["lo"] - 1, e["hi"] - 1)))
    return F.array_sort(F.array_distinct(numbers))


def classify_error(msg: Column) -> Column:
    """The kind of an error by the first marker that its message has."""
    has = lambda *marks: F.coalesce(*(F.nullif(F.coalesce(msg, F.lit("")).contains(m), F.lit(False)) for m in marks), F.lit(False))
    return (
        F.when(has("PASSWORD_REQUIRED"), "PasswordRequired")
        .when(has("SIGNED_PDF_MUTATION_ERROR") | (has("署名") & has("保護")), "SignedPdfMutationBlocked")
        .when(has("timed out", "Timeout", "タイムアウト", "制限時間"), "Timeout")
        .otherwise("General")
    )


def strip_paths(msg: Column) -> Column:
    """Paths in a message become their last part, what encloses them stays; web addresses and words without a path stay."""

    def last_part(token: Column) -> Column:
        lead, trail = F.regexp_extract(token, r"""^["'({\[]+""", 0), F.regexp_extract(token, r"""["')}:\].,;:!?]+$""", 0)
        core = F.substr(token, F.length(lead) + 1, F.greatest(F.lit(0), F.length(token) - F.length(lead) - F.length(trail)))
        parts = F.filter(F.split(core, r"[\\/]"), lambda p: ~p.isin("", ".", ".."))
        stays = token.rlike(r"^(?i:https?://)") | ~token.rlike(r"[\\/]") | (F.size(parts) <= 1)
        return F.when(stays, token).otherwise(F.concat(lead, F.element_at(parts, -1), trail))

    return F.array_join(F.transform(F.split(msg, r"(?<=\s)(?=\S)|(?<=\S)(?=\s)"), last_part), "")


#: The bits of each permission.
PERMISSIONS = {"print": (0x0004, 0x0800), "modify": (0x0008, 0x0100, 0x0400), "copy": (0x0010,), "annotate": (0x0020,)}


def permission_flags(allowed: dict[str, Column]) -> Column:
    """The signed flags that clear all bits of what isn't allowed; the two lowest are always clear."""
    flags = F.lit(-4)
    for name, bits in PERMISSIONS.items():
        flags = flags.bitwiseAND(F.when(allowed[name], -1).otherwise(~sum(bits)))
    return flags.cast("int")


def permitted(flags: Column, name: str) -> Column:
    """P16 the other way: whether flags allow something, by its first bit."""
    return flags.bitwiseAND(F.lit(PERMISSIONS[name][0])) != 0


def pdf_date(seconds: Column) -> Column:
    """P25: Unix seconds as ``D:YYYYMMDDHHmmSSZ``; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "'D:'yyyyMMddHHmmss'Z'")
