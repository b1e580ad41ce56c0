"""Character classes and small regex builders for Java regular expressions.

Word boundaries are spelled out (Java's own treat Persian letters as word characters), the end of a text is ``\\z``,
and trimming covers every Unicode space.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

ZWNJ = "‌"
#: A character of the Arabic block.
PERSIAN = r"[\x{0600}-\x{06FF}]"
PERSIAN_OR_ZWNJ = r"[\x{0600}-\x{06FF}\x{200C}]"
#: Characters whose script extensions hold Arabic.
ARABIC_EXTENDED = r"\p{IsArabic}\x{060C}\x{061B}\x{061F}\x{0640}\x{064B}-\x{0655}\x{0670}\x{204F}\x{2E41}\x{FD3E}\x{FD3F}"
#: Unicode white space as well as the byte order mark.
SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The characters of SPACE.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
ASCII_DIGITS = "0123456789"


def replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def bind(value: Column, body) -> Column:
    """body of a value that is computed once: a column that a lambda mentions is computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replace_with(text: Column, marks: tuple[str, ...], pattern: str, by: str) -> Column:
    """replace() for a pattern that only matches texts which hold one of the marks; other texts aren't searched by it."""
    held = lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(m)) for m in marks))
    return bind(text, lambda t: F.when(held(t), replace(t, pattern, by)).otherwise(t))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse_spaces(text: Column) -> Column:
    return replace(text, rf"{SPACE}+", " ")


def letters_outside(native: str = ARABIC_EXTENDED) -> str:
    """A letter that the native script's class doesn't hold."""
    return rf"[\p{{L}}&&[^{native}]]"


def ascii_bounded(pattern: str) -> str:
    return rf"(?<![A-Za-z0-9_]){pattern}(?![A-Za-z0-9_])"
