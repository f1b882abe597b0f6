"""Column builders for ticket text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEFAULT_TITLE, TAG_COLUMNS, TITLE_CHARS

# The characters that count as white space in ticket text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Text that means "no value" in exports.
EMPTY_WORDS = ("", "nan")
EMPTY_TAGS = ("", "nan", "none", "null")


def strip_all(col: Column) -> Column:
    """Strip every kind of white space (SQL ``trim`` alone strips blanks only)."""
    return F.trim(col, F.lit(WHITESPACE))


def stripped(col: Column) -> Column:
    """NULL becomes '', everything else is stripped."""
    return strip_all(F.coalesce(col.cast("string"), F.lit("")))


def is_filled(col: Column) -> Column:
    """True where a stripped text carries a value."""
    return ~F.lower(col).isin(*EMPTY_WORDS)


def queue_slug(col: Column) -> Column:
    """Queue name to file stem: stripped, lower case, blanks to underscores."""
    return F.replace(F.lower(strip_all(col)), F.lit(" "), F.lit("_"))


def tag_array(columns: list[str]) -> Column:
    """The usable tags among ``columns``, in column order."""
    present = [c for c in TAG_COLUMNS if c in columns]
    if not present:
        return F.array().cast("array<string>")
    tags = F.array(*[stripped(F.col(c)) for c in present])
    return F.filter(tags, lambda t: ~F.lower(t).isin(*EMPTY_TAGS))


def joined_tags(columns: list[str]) -> Column:
    return F.array_join(tag_array(columns), "|")


def shortened(col: Column, max_chars: int | None) -> Column:
    """The first ``max_chars`` characters, or the whole text for None."""
    return col if max_chars is None else F.substring(col, 1, max_chars)


def embed_text(title: Column, description: Column, max_chars: int | None = None) -> Column:
    """Text given to the encoder: title, a full stop, the description (cut only on request)."""
    body = shortened(F.coalesce(description, F.lit("")), max_chars)
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), body)


def classifier_text(title: Column, description: Column, max_chars: int | None = None) -> Column:
    """Text given to the classifier (cut only on request); an empty part leaves no separator."""
    parts = [F.nullif(stripped(c), F.lit("")) for c in (title, description)]
    return shortened(F.concat_ws(". ", *parts), max_chars)


def approx_tokens(col: Column) -> Column:
    """Four characters per token, half-even, at least one for non-empty text."""
    size = F.length(F.coalesce(col, F.lit("")))
    estimate = F.greatest(F.lit(1).cast("bigint"), F.bround(size / F.lit(4.0)).cast("bigint"))
    return F.when(size == 0, F.lit(0).cast("bigint")).otherwise(estimate)


def collapse_whitespace(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, WHITESPACE_CLASS + "+", " "))


def thread_title(col: Column, max_chars: int = TITLE_CHARS) -> Column:
    """Short title of a thread, cut at a word boundary."""
    clean = collapse_whitespace(F.coalesce(col, F.lit("")))
    cut = F.regexp_replace(F.substring(clean, 1, max_chars), " [^ ]*$", "")
    return (F.when(clean == "", F.lit(DEFAULT_TITLE))
            .when(F.length(clean) <= max_chars, clean)
            .otherwise(F.concat(cut, F.lit("…"))))
