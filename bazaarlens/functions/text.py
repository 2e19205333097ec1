"""Text clean-up and number formatting as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# Accented Latin letters and their plain forms.
ACCENTED = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def title_case(value: Column) -> Column:
    """Capitalise after every non-letter, so ``d'oeste`` gives ``D'Oeste``."""
    pieces = F.regexp_extract_all(F.lower(value), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    raised = F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2**31 - 1)))
    return F.array_join(raised, "")


def filled_title(value: Column, blank: str = "unknown") -> Column:
    return title_case(F.coalesce(value, F.lit(blank)))


def filled_upper(value: Column, blank: str = "unknown") -> Column:
    return F.upper(F.coalesce(value, F.lit(blank)))


def filled_lower(value: Column, blank: str = "unknown") -> Column:
    return F.lower(F.coalesce(value, F.lit(blank)))


def slug(value: Column) -> Column:
    """Lower case, accents stripped, every other run of characters one underscore."""
    plain = F.translate(F.lower(F.trim(value)), ACCENTED, PLAIN)
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug_name(name: str) -> str:
    """The same rule for one header name (driver side, schema only)."""
    ascii_name = unicodedata.normalize("NFKD", name.strip().lower()).encode("ascii", "ignore").decode("ascii")
    words = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in ascii_name).split()
    return "_".join(words)


def _swap_separators(text: Column) -> Column:
    return F.translate(text, ",.", ".,")


def _or_missing(value: Column, text: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value.cast("double")), F.lit("n/d")).otherwise(text)


def br_number(value: Column, decimals: int = 2) -> Column:
    """``1234.5`` -> ``1.234,50``; missing -> ``n/d``."""
    return _or_missing(value, _swap_separators(F.format_number(value.cast("double"), decimals)))


def br_integer(value: Column) -> Column:
    return _or_missing(value, _swap_separators(F.format_number(F.bround(value.cast("double"), 0), 0)))


def br_currency(value: Column, decimals: int = 2) -> Column:
    return _or_missing(value, F.concat(F.lit("R$ "), br_number(value, decimals)))


def br_percent(value: Column, decimals: int = 2) -> Column:
    return _or_missing(value, F.concat(br_number(value, decimals), F.lit("%")))


def br_pvalue(value: Column) -> Column:
    return _or_missing(value, F.when(value < 0.001, F.lit("<0,001")).otherwise(br_number(value, 4)))


def short_currency(value: Column) -> Column:
    """``R$ 1.2M``, ``R$ 3k`` or ``R$ 12`` by magnitude."""
    size = F.abs(value)
    millions = F.format_string("R$ %.1fM", (value / 1e6).cast("double"))
    thousands = F.format_string("R$ %.0fk", (value / 1e3).cast("double"))
    units = F.format_string("R$ %.0f", value.cast("double"))
    return F.when(size >= 1e6, millions).when(size >= 1e3, thousands).otherwise(units)


def whole_currency(value: Column) -> Column:
    """Dashboard pattern ``R$ #,##0`` (halves round away from zero)."""
    return F.concat(F.lit("R$ "), F.format_number(F.round(value, 0), 0))


def whole_percent(fraction: Column) -> Column:
    """Dashboard pattern ``0%``."""
    return F.concat(F.round(fraction * 100, 0).cast("long").cast("string"), F.lit("%"))


def one_decimal_percent(fraction: Column) -> Column:
    """Dashboard pattern ``0.0%``."""
    scaled = F.round(fraction * 100, 1).cast("decimal(18,1)")
    return F.concat(scaled.cast("string"), F.lit("%"))


def zero_padded(value: Column, width: int) -> Column:
    """Pattern ``000``: pad to ``width``, longer numbers stay whole."""
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def star_rating(score: Column) -> Column:
    """Five stars, the first ``int(score)`` of them filled; a blank score gives none."""
    filled = F.least(F.lit(5), F.greatest(F.lit(0), F.floor(F.coalesce(score, F.lit(0.0))).cast("int")))
    return F.concat(F.repeat(F.lit("★"), filled), F.repeat(F.lit("☆"), F.lit(5) - filled))
