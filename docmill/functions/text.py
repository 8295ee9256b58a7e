"""Text functions with Unicode white space and line rules kept the same on every engine node."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text tools understand it: Unicode's, and the four separators U+001C to U+001F.
WS = r"[\s\x1c-\x1f]"
#: The characters that ``(?U)`` and ``WS`` match.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def word_count(c: Column) -> Column:
    bare = strip(c)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, rf"(?U){WS}+")))


def char_count(c: Column) -> Column:
    return F.length(c)


def unix_lines(c: Column) -> Column:
    """Line ends CR LF and CR as LF."""
    return F.regexp_replace(c, "\r\n?", "\n")


def split_lines(c: Column) -> Column:
    """Lines at every Unicode line boundary, without an empty last one."""
    parts = F.split(c, "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def clean_text(c: Column) -> Column:
    """Runs of blanks and tabs to one blank, three or more line ends to two, stripped."""
    # few texts have such runs, and looking for one is much faster than a pattern
    c = F.when(F.contains(c, F.lit("  ")) | F.contains(c, F.lit("\t")), F.regexp_replace(c, "[ \t]+", " ")).otherwise(c)
    return strip(F.when(F.contains(c, F.lit("\n\n\n")), F.regexp_replace(c, "\n{3,}", "\n\n")).otherwise(c))


def clean_heading(c: Column) -> Column:
    """A heading without ``Chapter 1.`` or ``1.2.`` before it; no-break spaces are blanks."""
    bare = F.regexp_replace(c, rf"(?U)\A(?:Chapter{WS}+)?\d+(?:\.\d+)*\.{WS}*", "")
    return strip(F.translate(bare, "\u00a0", " "))


def section_path(parts: Column) -> Column:
    """Non-empty parts joined by `` > ``."""
    return F.array_join(F.filter(parts, lambda x: x != ""), " > ")


def html_prefix(page: Column, crumbs: Column, heading: Column) -> Column:
    """``Page:`` and ``Section:`` lines; crumbs equal to the page title are left out, the heading never is."""
    trail = F.concat(F.filter(crumbs, lambda x: x != page), F.array(heading))
    return F.concat(F.lit("Page: "), page, F.lit("\nSection: "), F.array_join(trail, " > "))


def adoc_prefix(page: Column, crumbs: Column, heading: Column) -> Column:
    """As :func:`html_prefix`, but empty parts and all that equal the page name are left out, and so is an empty section line."""
    trail = F.array_join(F.filter(F.concat(crumbs, F.array(heading)), lambda x: (x != "") & (x != page)), " > ")
    return F.concat(F.lit("Page: "), page, F.when(trail != "", F.concat(F.lit("\nSection: "), trail)).otherwise(""))


def preview(c: Column, most: int = 400) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


# The markup that is taken out of AsciiDoc, in order, with what stands for it.
# [\p{L}\p{N}_] is the word character of the look-arounds; (?d) makes LF the only line end.
ADOC_MARKUP = [
    (r"(?md)^(ifdef|ifndef|endif|ifeval)::[^\n]*", ""),
    (r"(?md)^include::([^\[]+)\[.*?\]$", ""),
    (r"(?md)^:[a-zA-Z0-9_\-]+:.*", ""),
    (r"(?md)^[-=.+_*]{4,}$", ""),
    (r"(image|icon)::[^\[]*\[[^\]]*\]", ""),
    (r"xref:[^\[]+\[([^\]]*)\]", "$1"),
    (r"link:[^\[]+\[([^\]]*)\]", "$1"),
    (r"(?md)^\[.*?\]$", ""),
    (rf"(?mdU)^(\*+|-+){WS}+", "- "),
    (r"(?s)\*\*(.+?)\*\*", "$1"),
    (r"(?dU)(?<![\p{L}\p{N}_*])\*([^\s\x1c-\x1f].*?[^\s\x1c-\x1f]|[^\s\x1c-\x1f])\*(?![\p{L}\p{N}_*])", "$1"),
    (r"(?s)__(.+?)__", "$1"),
    (r"(?dU)(?<![\p{L}\p{N}_])_([^\s\x1c-\x1f].*?[^\s\x1c-\x1f]|[^\s\x1c-\x1f])_(?![\p{L}\p{N}_])", "$1"),
    (r"`([^`\n]+)`", "$1"),
    (r"\{[a-zA-Z0-9_\-]+\}", ""),
    ("\n{3,}", "\n\n"),
]
ADOC_ATTRIBUTE = r"\{[a-zA-Z0-9_\-]+\}"


def strip_adoc(c: Column) -> Column:
    """AsciiDoc as plain text: markup taken out in the order of ``ADOC_MARKUP``, stripped."""
    for pattern, new in ADOC_MARKUP:
        c = F.regexp_replace(c, pattern, new)
    return strip(c)
