"""Whitespace words, lines, markers and answer normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.split() treats as white space, as a regex class body that Java
# and RE2 both read (their own \s is ASCII only).
SPACES = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD = f"[^{SPACES}]+"
STRIP = f"^[{SPACES}]+|[{SPACES}]+$"
# The same classes by Unicode property, which Java tests four times faster than a list of ranges.
_JAVA_SPACE = r"[\s\x1c-\x1f]"
JAVA_WORD = r"(?U)[\S&&[^\x1c-\x1f]]+"
JAVA_STRIP = rf"(?U)^{_JAVA_SPACE}+|{_JAVA_SPACE}+$"

# ASCII punctuation dropped by the SQuAD answer normalisation.
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Array of the whitespace-separated words; empty for blank text."""
    return F.regexp_extract_all(_col(text), F.lit(JAVA_WORD), F.lit(0))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(_col(text), F.lit(JAVA_WORD)).cast("long")


def strip(text: Column | str) -> Column:
    """Both ends trimmed of every Unicode space, not of blanks only."""
    return F.regexp_replace(_col(text), JAVA_STRIP, "")


def is_blank(text: Column | str) -> Column:
    return ~F.regexp_like(_col(text), F.lit(JAVA_WORD))


def lines(text: Column | str) -> Column:
    return F.split(_col(text), "\n", -1)


def before_marker(text: Column | str, marker: str) -> Column:
    """The text in front of the first marker; the whole text when there is none."""
    return F.substring_index(_col(text), marker, 1)


def squad_normalize(text: Column | str) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    t = F.lower(_col(text))
    t = F.regexp_replace(t, PUNCTUATION, "")
    t = F.regexp_replace(t, r"(?U)\b(a|an|the)\b", " ")
    return F.array_join(words(t), " ")


def abbreviate(name: Column | str) -> Column:
    """Names longer than 13 characters become their first 11 and two dots."""
    c = _col(name)
    return F.when(F.length(c) > 13, F.concat(F.substring(c, 1, 11), F.lit(".."))).otherwise(c)


def parent_name(path: Column | str) -> Column:
    """Directory that holds the file: the class of an image listing."""
    parts = F.split(_col(path), "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def last_two(path: Column | str) -> Column:
    parts = F.split(_col(path), "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")


def base_name(path: Column | str, extension: str | None = None) -> Column:
    """File name; with `extension`, the last suffix is replaced by it."""
    name = F.element_at(F.split(_col(path), "/"), -1)
    if extension is None:
        return name
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(extension))


def contains_ids(ids: Column | str, template: Column | str) -> Column:
    """True when the id list holds the template as a run.

    Ids are compared whole: a comma on each side keeps `1,2` from matching inside `11,23`.
    """
    def joined(c: Column | str) -> Column:
        return F.concat(F.lit(","), F.array_join(_col(c).cast("array<string>"), ","), F.lit(","))

    return F.contains(joined(ids), joined(template))
