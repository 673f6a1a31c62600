"""Column -> Column helpers. All are native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """A top-level column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_column(col: Column | str) -> Column:
    return quoted(col) if isinstance(col, str) else col


def month_key(ts: Column | str) -> Column:
    """``yyyy-MM`` text of a timestamp or date."""
    return F.date_format(as_column(ts), "yyyy-MM")


def day_key(ts: Column | str) -> Column:
    return F.to_date(as_column(ts))


def display_name(*parts: Column | str) -> Column:
    """Parts joined by a blank; NULL as soon as one part is NULL."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit(" "), as_column(part)]
    return F.concat(*pieces[1:])


def price_label(price: Column | str, type_: str = "decimal(12,2)") -> Column:
    return F.concat(F.lit("$"), as_column(price).cast(type_).cast("string"))


def non_empty(col: Column | str) -> Column:
    """True where the text is neither NULL nor empty."""
    col = as_column(col)
    return col.isNotNull() & (col != "")


def default_if_empty(col: Column | str, default: str = "Uncategorized") -> Column:
    col = as_column(col)
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def drop_chars(col: Column | str, chars: str) -> Column:
    """Remove every occurrence of the given characters."""
    return F.translate(as_column(col), chars, "")


def coerce_timestamp(col: Column | str, formats: Sequence[str] = ()) -> Column:
    """Timestamp without zone; text that is none becomes NULL.

    ISO spellings are read as they are. Other spellings have to be named as
    Spark datetime patterns in ``formats``, such as ``MM/dd/yyyy`` or ``MMM d, yyyy``;
    the first one that fits counts.
    """
    text = as_column(col)
    read = [F.try_to_timestamp(text, F.lit(f)).try_cast("timestamp_ntz") for f in formats]
    return F.coalesce(text.try_cast("timestamp_ntz"), *read)


def parse_int(col: Column | str) -> Column:
    """Whole number from text; ``12.7`` and other text become NULL."""
    return as_column(col).try_cast("bigint")


AMOUNT = "decimal(38,12)"
"""26 digits before the point and 12 behind it; finer digits are rounded half up."""

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_money(col: Column | str, strip: str = "$,", strict: bool = False) -> Column:
    """Amount from text after removing the ``strip`` characters.

    Text that is no number becomes NULL, or with ``strict`` fails the run. A number
    beyond ``AMOUNT`` always fails the run: it is an amount, so a NULL would
    lose it silently. Neither depends on the session's ANSI setting.
    """
    col = as_column(col)
    text = drop_chars(col, strip)
    large = F.raise_error(F.concat(F.lit("amount out of range: "), col)).cast(AMOUNT)
    bad = F.raise_error(F.concat(F.lit("not an amount: "), col)).cast(AMOUNT)
    failed = F.when(text.rlike(_NUMBER), large)
    if strict:
        failed = failed.when(col.isNotNull(), bad)
    return F.coalesce(text.try_cast(AMOUNT), failed)


def money_text(col: Column | str, strip: str = "$,", strict: bool = False) -> Column:
    """The cleaned text of an amount, NULL for what ``parse_money`` makes NULL.

    A text travels lighter than a decimal of 38 digits; ``as_money`` makes the amount where it is needed.
    """
    amount = parse_money(col, strip, strict)
    return F.when(amount.isNotNull(), drop_chars(col, strip))


def as_money(text: Column | str) -> Column:
    """The amount of a ``money_text``."""
    return as_column(text).try_cast(AMOUNT)


def collated(col: Column | str, collation: str = "UNICODE_CI_AI") -> Column:
    """The text compared without regard to case and accents."""
    return F.collate(as_column(col), collation)
