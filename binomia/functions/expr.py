"""Small Column helpers shared by all functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = r"(?U)[\s\x{1C}-\x{1F}]+"


def let(value, body):
    """Bind ``value`` once and use it many times inside ``body``.

    A Column that is mentioned n times is evaluated up to n times; a lambda
    variable is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def squish(s) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return F.trim(F.regexp_replace(s, WHITESPACE, " "))


def strip(s) -> Column:
    """Drop leading and trailing whitespace only."""
    return F.btrim(s, F.lit(" \t\n\r\x0b\x0c\u00a0"))


def words(s) -> Column:
    """Non-empty whitespace-separated words."""
    return F.filter(F.split(s, WHITESPACE), lambda w: w != "")


def leading_words(s, n: int) -> Column:
    """The first ``n`` of :func:`words`; the text behind them is not split."""
    return F.slice(F.filter(F.split(s, WHITESPACE, n + 2), lambda w: w != ""), 1, n)


def blank_to_null(s) -> Column:
    return F.nullif(s, F.lit(""))


def first_filled(*cols) -> Column:
    """First argument that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def among(col, values) -> Column:
    return col.isin(list(values))


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def starts_upper(w) -> Column:
    return w.rlike(r"(?U)^\p{Upper}")


def all_upper(w) -> Column:
    """At least one cased letter and no lower-case one."""
    return w.rlike(r"(?U)\p{Upper}") & ~w.rlike(r"(?U)[\p{Lower}\p{Lt}]")


def has_digit(w) -> Column:
    return w.rlike(r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}-\x{2089}\x{2460}-\x{2468}]")


def contains_all(haystack, needles) -> Column:
    return F.size(F.array_except(needles, haystack)) == 0


def rest_after(s, pattern) -> Column:
    """Text behind the first match of ``pattern``; ``s`` itself without a match.

    ``pattern`` carries no flags; it is matched without regard to case.
    """
    if isinstance(pattern, str):
        return F.regexp_replace(s, r"(?isU)^.*?(?:" + pattern + ")", "")
    whole = F.concat(F.lit(r"(?isU)^.*?(?:"), pattern, F.lit(")"))
    return F.regexp_replace(s, whole, F.lit(""))


def quoted(s) -> Column:
    """Literal text as a regular expression."""
    return F.concat(
        F.lit(r"\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")
    )


def round_exact(x, digits: int) -> Column:
    """Round half to even on the exact binary value, as ``round`` does in Python.

    ``round`` and ``bround`` work on the shortest decimal form, so they differ on
    values such as 0.155.
    """
    text = F.regexp_replace(F.format_number(x, digits), ",", "")
    return text.try_cast("double")
