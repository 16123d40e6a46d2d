"""Column expressions shared by the features. Missing values are NULL throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def square(c: Column) -> Column:
    return c * c


def indicator(condition: Column) -> Column:
    """1.0 or 0.0; an unknown condition is 0.0."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def over(a: Column, b: Column, eps: float = EPS) -> Column:
    return F.try_divide(a, b + F.lit(eps))


def norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def cosine(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return over(x1 * x2 + y1 * y2, norm(x1, y1) * norm(x2, y2))


def wrapped(angle: Column) -> Column:
    """An angle brought to (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def clipped(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that keep NULL: least and greatest alone would skip it."""
    out = c if low is None else F.greatest(c, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def normalised(c: Column) -> Column:
    """Without surrounding white space, in lower case."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def trailing_number(c: Column) -> Column:
    """The digits at the end of a name as INT; NULL without any."""
    return F.regexp_extract(c.cast("string"), r"(\d+)$", 1).try_cast("int")


def slug(c: Column, most: int = 80) -> Column:
    """Runs of other characters than ASCII letters and digits become one '-'; a long name is cut and marked by its MD5."""
    plain = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.concat(F.substring(plain, 1, most - 9), F.lit("-"), F.substring(F.md5(c.cast("binary")), 1, 8))
    return F.when(F.length(plain) > most, cut).otherwise(F.when(plain == "", "default").otherwise(plain))


def quoted_list(c: Column) -> Column:
    """A JSON array of strings as an array; NULL if it isn't one."""
    return F.from_json(c, "array<string>")
