"""String functions (F-1 .. F-6, F-15, B-5) as Spark Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points Python's ``str.strip()`` treats as whitespace
# (tab .. carriage return, 0x1c .. 0x1f separators, space, 0x85, no-break
# space, ogham space, 0x2000 .. 0x200a, line / paragraph separators, 0x202f,
# 0x205f, ideographic space).
PY_WHITESPACE = [(0x09, 0x0D), (0x1C, 0x1F), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0),
                 (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F),
                 (0x205F, 0x205F), (0x3000, 0x3000)]
# \x{h..h} escapes are read the same way by Java regex and RE2 (DuckDB).
PY_WHITESPACE_CLASS = "[" + "".join(
    f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b != a else "") for a, b in PY_WHITESPACE) + "]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(c) -> Column:
    """Python-style ``strip()``: Spark ``trim`` only removes spaces."""
    ws = PY_WHITESPACE_CLASS
    return F.regexp_replace(_c(c), f"^{ws}+|{ws}+$", "")


def is_blank(c) -> Column:
    return py_strip(F.coalesce(_c(c), F.lit(""))) == ""


def ensure_string(c) -> Column:
    """B-5: NULL / non-string -> '', underscores -> spaces, then strip.  The
    type is known when the query is analysed, so the test costs nothing."""
    x = _c(c)
    text = F.when(F.typeof(x) == "string", x.cast("string"))
    return py_strip(F.replace(F.coalesce(text, F.lit("")), F.lit("_"), F.lit(" ")))


def underscores_to_spaces(c) -> Column:
    """F-2."""
    return F.replace(_c(c), F.lit("_"), F.lit(" "))


def split_camel(c) -> Column:
    """F-3: insert '_' between a lower-case letter and an upper-case letter."""
    return F.regexp_replace(_c(c), "([a-z])([A-Z])", "$1_$2")


def camel_to_snake(c) -> Column:
    """C-18: CamelCase class name -> lower snake case."""
    return F.lower(split_camel(c))


def clean_name_and(c) -> Column:
    """F-4 variant 1 (C-17): '&' -> 'and', space -> '_', lower case."""
    x = F.replace(_c(c), F.lit("&"), F.lit("and"))
    return F.lower(F.replace(x, F.lit(" "), F.lit("_")))


def clean_label_multi(c) -> Column:
    """F-4 variant 3 (C-19): lower, space -> '_', '-' -> 'and', '&' -> 'and'."""
    x = F.lower(_c(c))
    x = F.replace(x, F.lit(" "), F.lit("_"))
    x = F.replace(x, F.lit("-"), F.lit("and"))
    return F.replace(x, F.lit("&"), F.lit("and"))


def join_fields(*cols, sep: str = "\n") -> Column:
    """F-5: multi-field text assembly; NULL fields become '' (not skipped)."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.coalesce(_c(c).cast("string"), F.lit("")))
    return F.concat(*parts)


def letter_index(c) -> Column:
    """F-6: ord(letter) - ord('A')."""
    return F.ascii(_c(c)) - F.lit(65)


# The annotation prompt wording is the user's to choose; this
# is a neutral default template with a single {text} slot.
DEFAULT_PROMPT_TEMPLATE = (
    "Read the text below and return JSON with keys sentence, labels and "
    "not_labels.\n\nText:\n{text}"
)


def prompt(c, template: str = DEFAULT_PROMPT_TEMPLATE) -> Column:
    """F-15: fill a template with the text column (one {text} slot)."""
    head, _, tail = template.partition("{text}")
    return F.concat(F.lit(head), F.coalesce(_c(c), F.lit("")), F.lit(tail))
