"""Name matching for resource, machine, department and user names.

How names compare is a parameter of every job that compares them, a
:class:`Names` rule:

* :data:`NOCASE` (the default): case and trailing blanks do not count, as in a
  case-insensitive database collation. The key ``lower(rtrim(name))`` serves
  equality, grouping and membership; pattern and delimiter searches ignore case.
* :data:`BINARY`: names compare byte by byte, searches heed case.
* :data:`COLLATED`: the same equality as ``NOCASE`` through Spark's collated
  strings (``UTF8_LCASE_RTRIM``). Spark groups collated strings by sorting, so
  it is the slower of the two (figures in the README).

The original text is what a report shows (the smallest spelling per group).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the original jobs' literals.
# Resource names of the three browsers whose activity is re-attributed.
BROWSER_RESOURCE_NAMES = (
    "google chrome - chrome.exe",
    "opera internet browser - opera.exe",
    "firefox - firefox.exe",
)
# Resource-name fragment of the lock screen, excluded from time reports.
LOCK_SCREEN_FRAGMENT = "lockapp"
# Delimiters cut from a window title to get a site name, applied in this
# order (the first one is applied to the raw title, the next to its result).
TITLE_DELIMITERS = ("aspx", ".htm", ".pdf", "./Search", ".com/")
# Longest site name kept.
SITE_NAME_MAX_CHARS = 500


@dataclasses.dataclass(frozen=True)
class Names:
    """A rule by which names compare: ``nocase``, ``binary`` or a collation of Spark."""

    collation: str

    @property
    def heeds_case(self) -> bool:
        return self.collation == "binary"

    def key(self, name: Column) -> Column:
        """What names are equal by."""
        if self.heeds_case:
            return name
        return F.lower(F.rtrim(name)) if self.collation == "nocase" else F.collate(name, self.collation)

    def searched(self, text: Column, fragment: str) -> tuple[Column, str]:
        """The text to look in and the fragment to look for."""
        return (text, fragment) if self.heeds_case else (F.lower(text), fragment.lower())

    @property
    def flags(self) -> str:
        """Flags of a regular expression that searches by this rule."""
        return "s" if self.heeds_case else "is"


NOCASE, BINARY, COLLATED = RULES = Names("nocase"), Names("binary"), Names("UTF8_LCASE_RTRIM")


def name_key(name: Column, names: Names = NOCASE) -> Column:
    """Comparison key of a name."""
    return names.key(name)


def is_blank(text: Column) -> Column:
    """TRUE for '' or all blanks, NULL for NULL."""
    return F.trim(text) == F.lit("")


def contains_name(text: Column, fragment: str, names: Names = NOCASE) -> Column:
    """``text LIKE '%fragment%'`` (NULL for NULL text)."""
    where, what = names.searched(text, fragment)
    return where.contains(what)


def not_lock_screen(resource_name: Column, fragment: str = LOCK_SCREEN_FRAGMENT, names: Names = NOCASE) -> Column:
    """Keep-predicate for time reports: NULL names are dropped too, as NOT LIKE does."""
    return ~contains_name(resource_name, fragment, names)


def key_in(name: Column, values: Iterable[str], names: Names = NOCASE) -> Column:
    if names.collation == "nocase":
        return names.key(name).isin([v.rstrip().lower() for v in values])
    return names.key(name).isin(list(values))


def _quoted(literal: str) -> str:
    """A Java regex matching ``literal`` verbatim."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def left_of(text: Column, delimiter: str, names: Names = NOCASE) -> Column:
    """Text left of the first occurrence of ``delimiter``; unchanged if absent.

    One regex replace (delimiter to end of text) references ``text`` once, so
    nesting several cuts grows the expression linearly and keeps it in
    whole-stage codegen.
    """
    return F.regexp_replace(text, F.lit(f"(?{names.flags})" + _quoted(delimiter) + ".*"), F.lit(""))


def without_prefix(name: Column, prefix: str, names: Names = NOCASE) -> Column:
    """``name`` without any occurrence of ``prefix``, searched as all names are."""
    return F.regexp_replace(name, F.lit(f"(?{names.flags})" + _quoted(prefix)), F.lit("")) if prefix else name


def site_name(title: Column, delimiters: Sequence[str] = TITLE_DELIMITERS,
              max_chars: int = SITE_NAME_MAX_CHARS, names: Names = NOCASE) -> Column:
    """Site name from a browser window title: cut at each delimiter in turn, then cap the length."""
    out = title
    for delimiter in delimiters:
        out = left_of(out, delimiter, names)
    return F.left(out, F.lit(max_chars))
