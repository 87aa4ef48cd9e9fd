"""Text column expressions: cleaning, word rules, labels and JSON replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylens.functions.numbers import to_double
from tallylens.operators.columnwise import col

# Phrases that mark wording as vague.
VAGUE_PHRASES = (
    "may indicate", "could be", "might suggest", "possibly",
    "it appears", "seems like", "unclear", "unknown",
)

# Fixed value: everything that ends a line, the Unicode separators included. A pair of \\r\\n leaves an empty line between.
LINE_END = "[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"

# Fixed value: all characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)

_FENCE = "(?s)^```(?:json)?|```$"


def strip(col: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.trim(col, F.lit(WHITE_SPACE))


def iso_date(col: Column) -> Column:
    """Rewrite recognised date texts as ``yyyy-MM-dd``; keep other text trimmed.

    Day-first wins over month-first. Each parse is guarded by a pattern, so the
    parser is not made to fail on rows of another format.
    """
    text = strip(col)
    clock = "T([01]?[0-9]|2[0-3]):[0-5]?[0-9]:([0-5]?[0-9]|6[01])$"
    ymd = F.when(
        text.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(" + clock + "|$)"),
        F.try_to_date(F.substring_index(text, "T", 1), "yyyy-M-d"),
    )
    slashed = text.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$")
    dmy_slash = F.when(slashed, F.try_to_date(text, "d/M/yyyy"))
    mdy_slash = F.when(slashed, F.try_to_date(text, "M/d/yyyy"))
    dmy_dash = F.when(text.rlike("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"), F.try_to_date(text, "d-M-yyyy"))
    return F.coalesce(F.coalesce(ymd, dmy_slash, mdy_slash, dmy_dash).cast("string"), text)


def currency(col: Column) -> Column:
    """``$1,234.50`` and the like as a double; null where it is no number."""
    return to_double(F.regexp_replace(col, "(?U)[$,£€\\s]", ""))


def lowered(col: Column) -> Column:
    return strip(F.lower(col))


def leading_date(col: Column) -> Column:
    """The first ten characters as a date; null where they are none."""
    head = F.substring(col, 1, 10)
    return F.when(head.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(head, "yyyy-M-d"))


def words(col: Column) -> Column:
    """White-space separated words of a text; an empty array for blank text."""
    return F.filter(F.split(col, "(?U)\\s+"), lambda w: w != "")


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit("(?U)\\S+"))


def ascii_words(col: Column) -> Column:
    """All runs of ``[A-Za-z_]``, and an empty text at the end, so that a text without any still has an entry.

    A split at all other characters takes about twenty times as long.
    """
    return F.concat(F.regexp_extract_all(col, F.lit("[A-Za-z_]+"), F.lit(0)), F.array(F.lit("")))


def leading_word(col: Column) -> Column:
    """The run of ``[A-Za-z_]`` that a text begins with, or an empty text; what follows is not looked at."""
    return F.regexp_extract(col, "^[A-Za-z_]*", 0)


def vague_phrase_count(low: Column) -> Column:
    """How many of the vague phrases occur in a lower-case text."""
    return sum((low.contains(p).cast("int") for p in VAGUE_PHRASES), F.lit(0))


def without_stars(col: Column) -> Column:
    return strip(F.regexp_replace(col, "\\*+", ""))


def filled_lines(col: Column) -> Column:
    """Stripped, non-empty lines of a text."""
    return F.filter(F.transform(F.split(col, LINE_END), strip), lambda s: s != "")


def title_and_rest_of(text: Column) -> Column:
    """``struct<title, rest>`` of a text: its first line and all others, without markdown stars.

    The only line serves as both; blank text gives nulls. The lines are bound by a transform of one element, so they
    are split once per use of the struct.
    """
    def parts(lines: Column) -> Column:
        first = F.try_element_at(lines, F.lit(1))
        others = F.when(F.size(lines) > 1, F.array_join(F.slice(lines, F.lit(2), F.size(lines)), " ")).otherwise(first)
        return F.struct(without_stars(first).alias("title"), without_stars(others).alias("rest"))

    return F.transform(F.array(filled_lines(text)), parts)[0]


def title_and_rest(df: DataFrame, column: str, title: str, rest: str) -> DataFrame:
    """Add :func:`title_and_rest_of` a column as two columns; columns that are not used later are not read."""
    parts = title_and_rest_of(col(column))
    return df.withColumn("__parts", parts).withColumns({title: F.col("__parts.title"), rest: F.col("__parts.rest")}).drop("__parts")


def short_title(col: Column, limit: int = 7) -> Column:
    """At most ``limit`` words, with an ellipsis where words were cut."""
    parts = words(col)
    return F.concat(F.array_join(F.slice(parts, 1, limit), " "), F.when(F.size(parts) > limit, "…").otherwise(""))


def column_label(col: Column) -> Column:
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def record_from_json(col: Column, schema: str) -> Column:
    """A record from JSON text that may be fenced or embedded in prose."""
    bare = strip(F.regexp_replace(strip(col), _FENCE, ""))
    whole = F.from_json(F.when(bare.rlike("(?s)^\\{.*\\}$"), bare), schema)
    inner = F.from_json(F.nullif(F.regexp_extract(bare, "(?s)\\{.*\\}", 0), F.lit("")), schema)
    return F.coalesce(whole, inner)
