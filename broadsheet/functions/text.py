"""Text column functions with Unicode-aware white space, which plain trim and \\s lack."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_newlines(text) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def lines_of(text) -> Column:
    """array<string> of lines; a trailing newline gives a last empty line."""
    return F.split(normalize_newlines(text), "\n", -1)


def first_line(text) -> Column:
    """The first of :func:`lines_of`, without cutting the others."""
    return F.substring_index(F.substring_index(text, "\n", 1), "\r", 1)


def strip_anchor(text) -> Column:
    """Without a trailing ``{#anchor}``."""
    return F.regexp_replace(text, r"(?U)\s*\{#[^}]*\}\s*$", "")


def strip_marks(text, marks: str = "# ") -> Column:
    """Without any of the leading characters ``marks``."""
    return F.regexp_replace(text, f"^[{marks}]+", "")


#: Inline marks and what they become, in order (fixed values of the format).
_INLINE = {
    r"(?d)\*\*(.+?)\*\*": {"html": "<strong>$1</strong>", "strip": "$1"},
    r"(?d)\*(.+?)\*": {"html": "<em>$1</em>", "strip": "$1"},
    r"(?d)`(.+?)`": {"html": "<code>$1</code>", "strip": "$1"},
}


def rewrite_inline(text, mode: str = "html") -> Column:
    """``**bold**``, ``*italic*`` and `` `code` ``, in that order, to HTML or to plain text."""
    for pattern, into in _INLINE.items():
        text = F.regexp_replace(text, pattern, into[mode])
    return text


def cells_of(line) -> Column:
    """The trimmed cells of a pipe-table row: what stands between the first and the last ``|``."""
    parts = F.split(line, r"\|", -1)
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.transform(inner, strip)


def is_separator(cells) -> Column:
    """Whether all cells begin with a dash (also true of no cells)."""
    return F.forall(cells, lambda c: c.startswith("-"))


def occurrences(text, marker: str) -> Column:
    """How often ``marker`` stands in ``text``, without overlap."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(marker)))
    return (gone / F.length(F.lit(marker))).cast("int")


def percent_encode(text) -> Column:
    """Percent-encoding with %20 for a space."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def ascii_digits(text) -> Column:
    """With full-width digits as plain ones."""
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def iso_date(year, month, day) -> Column:
    """A date from three numeric strings; null if they are empty or name no day."""
    parts = ascii_digits(F.concat_ws("-", year, month, day))
    return F.when(year != "", F.try_to_date(parts, "y-M-d"))
