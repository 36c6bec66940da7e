"""Drop less specific duplicates among names that share an anchor.

Nothing here groups the rows of an anchor in one task: rows are first reduced to one
per (anchor, sub-species anchor), and "some other name of this anchor starts with my
words" becomes an anti-join with the distinct proper prefixes of all names.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import words


def most_specific(rows: DataFrame) -> DataFrame:
    """One row per (anchor, subspp_anchor), without rows that another one extends."""
    return drop_extended(best_per_subspecies(rows))


def best_per_subspecies(rows: DataFrame) -> DataFrame:
    """Best row per sub-species anchor: code first, then score, fewer ties, first row."""
    order = F.struct(
        F.col("has_code_or_cc").alias("code"),
        F.col("j_score"),
        (-F.col("n_candidates")).alias("n"),
        _first(rows),
    )
    group = rows.groupBy("anchor", "subspp_anchor")
    return group.agg(F.max_by(F.struct(*_rest(rows)), order).alias("row")).select(
        "anchor", "subspp_anchor", "row.*"
    ).select(*rows.columns)


def _first(rows):
    return (-F.col("pos")).alias("first")


def _rest(rows):
    return [c for c in rows.columns if c not in ("anchor", "subspp_anchor")]


def drop_extended(rows: DataFrame) -> DataFrame:
    """Drop rows whose words are a proper prefix of another row of the same anchor."""
    own = words(F.col("subspp_anchor"))
    lengths = F.sequence(F.lit(1), F.size("w") - 1)
    prefixes = (
        rows.select(F.col("anchor").alias("a"), own.alias("w"))
        .where(F.size("w") > 1)
        .select("a", F.explode(F.transform(lengths, lambda n: F.array_join(F.slice("w", F.lit(1), n), " "))).alias("p"))
        .distinct()
    )
    text = F.array_join(own, " ")
    return rows.join(
        prefixes, F.col("anchor").eqNullSafe(F.col("a")) & (text == F.col("p")), "left_anti"
    )


def with_group_position(kept: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``group_pos``, the first position of the anchor in the full input.

    :func:`output_order` sorts by it first.
    """
    first = rows.groupBy(F.col("anchor").alias("_anchor")).agg(F.min("pos").alias("group_pos"))
    return kept.join(first, kept["anchor"].eqNullSafe(first["_anchor"]), "left").drop("_anchor")


def output_order():
    """Ascending sort keys of matched rows."""
    return [
        F.col("group_pos"),
        -F.col("has_code_or_cc"),
        -F.col("j_score"),
        F.col("n_candidates"),
        F.col("pos"),
    ]
