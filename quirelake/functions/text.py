"""Text functions as column expressions, with the meaning Python's own string methods have.

Spark's ``trim``, ``\\s``, ``\\w`` and ``\\b`` know ASCII only or other sets, so the classes
are spelled out. All functions give null for null.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as ``str.isspace`` sees it, for use inside and as a class.
WS_SET = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_SET}]"
#: The same as a text of all its characters.
WHITE = "".join(c for c in map(chr, range(0x3001)) if re.fullmatch(WS, c))
#: A whole run of white space. What a pattern looks back at comes after its first character, so that most places fail on that alone.
SPACE_RUN = f"{WS}(?<!{WS}{WS}){WS}*+"
#: Word characters.
W = r"[\p{L}\p{N}_]"
#: Line ends as ``str.splitlines`` sees them.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settle(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: later filters and projections use the value, not its expression.

    A generator of one row is what the optimizer doesn't merge into its neighbours.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def has(text: Column, *parts: str) -> Column:
    """Whether a text holds one of some literals, which is found without a pattern."""
    return reduce(or_, (F.contains(text, F.lit(p)) for p in parts))


def where(text: Column, guard: Callable[[Column], Column], rule: Callable[[Column], Column]) -> Column:
    """``rule`` of the texts for which the cheaper ``guard`` holds; the others, which it would leave alone, as they are."""
    return let(text, lambda t: F.when(guard(t), rule(t)).otherwise(t))


def is_blank(text: Column) -> Column:
    return text.rlike(rf"\A{WS}*+\z")


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...], str]:
    """Lower-case letters whose fold is one other letter, these letters, those whose fold is several with their spelling, and a class of ranges that holds every letter which folding changes beyond its lower case."""
    one, several, special = {}, {}, [ord("Σ")]  # whose lower case depends on its place
    for c in map(chr, range(sys.maxunicode + 1)):
        if (folded := c.casefold()) != c.lower():
            special.append(ord(c))
        if c == c.lower() and folded != c:
            (one if len(folded) == 1 else several)[c] = folded
    ranges: list[list[int]] = []
    for code in sorted(special):  # gaps up to 64 are filled: a letter too many costs time alone
        if ranges and code - ranges[-1][1] <= 64 and code > 0x400:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(one), "".join(one.values()), tuple(several.items()), "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


def casefold(text: Column) -> Column:
    """Lower case, and what folding does beyond it: letters that stand for others (long s, final sigma) or for several (sharp s, ligatures).

    Texts without any such letter, as are those of ASCII characters alone, are only made
    lower case.
    """
    letters, folded, several, special = _folds()
    table = F.array(*[F.array(F.lit(letter), F.lit(spelling)) for letter, spelling in several])
    whole = F.aggregate(table, F.translate(F.lower(text), letters, folded), lambda got, x: F.replace(got, x[0], x[1]))
    return F.when((F.octet_length(text) != F.char_length(text)) & text.rlike(f"[{special}]"), whole).otherwise(F.lower(text))


def splitlines(text: Column) -> Column:
    """Array of lines without their ends; a line end at the end of the text adds no empty line."""
    return let(F.split(text, LINE_END), lambda lines: F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines))


def words(text: Column) -> Column:
    """Array of the runs between white space."""
    return F.filter(F.split(text, f"{WS}++"), lambda w: w != "")


def is_upper(text: Column) -> Column:
    """At least one capital and no lower-case or title-case letter."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def count_of(text: Column, part: str) -> Column:
    """Occurrences of ``part`` that don't overlap."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("long")


def mime_type(name: Column) -> Column:
    """Media type of an image by its file name; PNG where it is not known."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^./\\]+)\z", 1))
    types = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff"}
    found = F.lit(None).cast("string")
    for k, v in types.items():
        found = F.when(suffix == k, F.lit(v)).otherwise(found)
    return F.coalesce(found, F.lit("image/png"))
