"""String functions with PostgreSQL's edge cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import fail

#: Output longer than this is an error, not a result.
LONGEST = 1 << 30
_BLANK = r"[\p{IsWhite_Space}]+"


def trim(s: Column, chars: Column | None, left: bool, right: bool) -> Column:
    """Strips all Unicode white space, or the characters of ``chars``."""
    if chars is None:
        ends = [p for p, wanted in ((f"^{_BLANK}", left), (f"{_BLANK}$", right)) if wanted]
        return F.regexp_replace(s, "|".join(ends), "")
    return F.btrim(s, chars) if left and right else F.ltrim(s, chars) if left else F.rtrim(s, chars)


def substring(s: Column, start: Column, count: Column | None = None) -> Column:
    """The window [start, start + count) over positions from 1; what lies before position 1 counts as used up."""
    first = F.greatest(start, F.lit(1))
    if count is None:
        return F.when(start.isNotNull(), F.substr(s, first))
    room = F.greatest((start.cast("long") + count - first), F.lit(0)).cast("int")
    return F.when(count < 0, fail("22011", "negative substring length not allowed")).when(start.isNotNull() & count.isNotNull(), F.substr(s, first, room))


def left(s: Column, n: Column) -> Column:
    return F.substr(s, F.lit(1), F.when(n >= 0, n).otherwise(F.greatest(F.length(s) + n, F.lit(0))))


def right(s: Column, n: Column) -> Column:
    return F.substr(s, F.when(n >= 0, F.greatest(F.length(s) - n, F.lit(0))).otherwise(-n) + 1)


def pad(s: Column, width: Column, fill: Column, on_left: bool) -> Column:
    made = F.lpad(s, width, fill) if on_left else F.rpad(s, width, fill)
    bounded = F.when(width > LONGEST, fail("54000", "requested length too large")).otherwise(made)
    whole = F.when(width <= 0, F.lit("")).when(fill == "", F.substr(s, F.lit(1), F.greatest(width, F.lit(0)))).otherwise(bounded)
    return F.when(s.isNotNull() & width.isNotNull() & fill.isNotNull(), whole)


def repeat(s: Column, n: Column) -> Column:
    size = F.octet_length(s).cast("long") * n
    made = F.when(size > LONGEST, fail("54000", "requested length too large")).otherwise(F.repeat(s, F.greatest(n, F.lit(0))))
    return F.when(s.isNotNull() & n.isNotNull(), made)


def replace(s: Column, old: Column, new: Column) -> Column:
    return F.when((old == "") & new.isNotNull(), s).otherwise(F.replace(s, old, new))


def initcap(s: Column) -> Column:
    """Every run of letters and digits gets a capital; anything else parts words."""
    runs = F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.when(s.isNotNull(), F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), ""))


def chr_(n: Column) -> Column:
    """The character of a code point."""
    bad = (n <= 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    made = F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
    return F.when(n.isNull(), F.lit(None).cast("string")).when(bad, fail("54000", "requested character not valid")).otherwise(made)


def like(s: Column, pattern: Column, fold: bool) -> Column:
    """LIKE with backslash escapes; ILIKE folds ASCII letters only."""
    if fold:
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        s, pattern = F.translate(s, upper, lower), F.translate(pattern, upper, lower)
    # an odd number of backslashes at the end escapes nothing; before an ordinary character a backslash is dropped
    trailing = F.length(F.regexp_extract(pattern, r"(\\*)$", 1)) % 2 == 1
    clean = F.regexp_replace(pattern, r"\\([^%_\\])", "$1")
    return F.when(s.isNotNull() & pattern.isNotNull(), F.when(trailing, fail("22025", "LIKE pattern must not end with escape character").cast("boolean")).otherwise(F.like(s, F.when(trailing, F.lit("")).otherwise(clean))))
