"""Scalar rules for receipt values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fields import ADJUSTMENTS, EXPANSION


def clean_text(text: Column) -> Column:
    """White space joined and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_amount(text: Column, decimal_style: str = "reference") -> Column:
    """A number as text, or null. ``reference`` drops commas where both separators
    occur; ``last_separator`` takes the last one as the decimal sign."""
    t = F.regexp_replace(text, r"[^\d.,]", "")
    both = t.contains(",") & t.contains(".")
    if decimal_style == "reference":
        out = F.when(both, F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    else:
        comma_last = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
        out = F.when(both & comma_last, F.translate(F.replace(t, F.lit("."), F.lit("")), ",", ".")).when(both, F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    return F.when(out.try_cast("double").isNotNull(), out)


def fullmatch(text: Column, pattern: str | Column) -> Column:
    """Whether the whole text matches, letters as they are."""
    if isinstance(pattern, str):
        return text.rlike(rf"\A(?:{pattern})\z")
    return F.regexp_like(text, F.concat(F.lit(r"\A(?:"), pattern, F.lit(r")\z")))


def value_of(text: Column, name: str, pattern: str) -> Column:
    """The value of one field's text, with white space already cleaned, or null: the field's pattern, then the rules of its kind."""
    ok = text.rlike(rf"(?iu){pattern}")
    if name == "monto":
        return F.when(ok, normalize_amount(text))
    if name == "fecha":
        return F.when(ok & text.rlike(r"\A\d{2}[/-]\d{2}[/-]\d{2,4}"), text)
    if name == "operacion":
        return F.when(ok & (F.length(F.regexp_replace(text, r"\D", "")) >= 10), text)
    return F.when(ok, F.trim(text))


def value_by_field(text: Column, field: Column, definitions=EXPANSION) -> Column:
    """The value of a field's text, with white space already cleaned, or null."""
    out = None
    for name, _, pattern in definitions:
        out = F.when(field == name, value_of(text, name, pattern)) if out is None else out.when(field == name, value_of(text, name, pattern))
    return out


def validate_field(text: Column, field: Column, definitions=EXPANSION) -> Column:
    """The value of a field's text, or null."""
    return value_by_field(clean_text(text), field, definitions)


#: Characters that a field's reading profile admits; fixed values.
CHARSETS = {"monto": r"[^0-9.,\-]", "fecha": r"[^0-9/\-:]"}
OTHER_CHARSET = r"[^0-9A-Za-z.,:\-/() ]"


def charset_filter(text: Column, field: Column) -> Column:
    """Only the characters that a field's reading profile admits; null if none is left."""
    kept = F.regexp_replace(text, OTHER_CHARSET, "")
    for name, others in CHARSETS.items():
        kept = F.when(field == name, F.regexp_replace(text, others, "")).otherwise(kept)
    return F.when(kept != "", kept)


def confidence_adjustment(cause: Column) -> Column:
    pairs = [F.lit(x) for kv in ADJUSTMENTS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), cause), F.lit(0.0))


def parse_orientation(text: Column) -> Column:
    """The angle of the ``Rotate`` line of ``key: value`` lines, or 0."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v")))
    last = F.try_element_at(F.filter(pairs, lambda p: p["k"] == "Rotate"), F.lit(-1))
    return F.coalesce(last["v"].try_cast("double"), F.lit(0.0))


def final_status(successful: Column) -> Column:
    return F.when(successful > 0, "success").otherwise("error")


def exit_code(status: Column) -> Column:
    return F.when(status == "success", 0).when(status.isin("low_confidence", "validation_failed"), 2).otherwise(1)
