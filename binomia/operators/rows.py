"""Row-level steps around matching: abundance, filter, statistics, merge."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import round_exact


def last_abundance(rows: DataFrame) -> DataFrame:
    """Abundance per raw name; the last row of a repeated name counts."""
    return rows.groupBy("taxa_name").agg(F.max_by("abundance", "pos").alias("abundance"))


def with_last_abundance(rows: DataFrame) -> DataFrame:
    return rows.drop("abundance").join(last_abundance(rows), "taxa_name", "left")


def needs_rescue(matched: DataFrame) -> DataFrame:
    """Rows that were not accepted outright; all rows when there are no bands."""
    if "bands" not in matched.columns:
        return matched
    return matched.where(F.col("bands") != "auto-accept")


def percent(part, whole, digits=1) -> Column:
    """``part`` of ``whole`` in percent; 0 for an empty whole."""
    share = part.cast("double") / F.nullif(whole, F.lit(0).cast("long")).cast("double")
    return F.coalesce(round_exact(share * 100, digits), F.lit(0.0))


def filtering_totals(matched: DataFrame) -> DataFrame:
    """One row: how many names were accepted and how many need rescue."""
    total, accepted = F.count(F.lit(1)), F.count_if(F.col("bands") == "auto-accept")
    return matched.agg(total.alias("total_taxa"), accepted.alias("auto_accepted")).select(
        "total_taxa",
        "auto_accepted",
        (F.col("total_taxa") - F.col("auto_accepted")).alias("need_rescue"),
        percent(F.col("total_taxa") - F.col("auto_accepted"), F.col("total_taxa")).alias(
            "need_rescue_pct"
        ),
    )


def band_breakdown(matched: DataFrame) -> DataFrame:
    """Names per band among those that need rescue."""
    return needs_rescue(matched).groupBy("bands").agg(F.count(F.lit(1)).alias("n"))


def merge_rescued(matched: DataFrame, rescued: DataFrame) -> DataFrame:
    """Replace matched rows by the rescued row of the same ``taxon``.

    A rescued row replaces the whole matched row, nulls included; of several rescued
    rows with one ``taxon`` the last counts. Rows without a rescued row keep their
    values, and the columns only rescue has stay null.
    """
    columns = list(dict.fromkeys(matched.columns + rescued.columns))
    last = rescued.groupBy(F.col("taxon").alias("_key")).agg(
        F.max_by(F.struct(*rescued.columns), "pos").alias("_rescued")
    )
    hit = F.col("_key").isNotNull()
    joined = matched.join(last, matched["taxon"] == last["_key"], "left")

    def pick(name):
        own = F.col(name) if name in matched.columns else F.lit(None)
        if name not in rescued.columns or name in ("pos", "group_pos"):
            return own.alias(name)
        return F.when(hit, F.col("_rescued")[name]).otherwise(own).alias(name)

    return joined.select(*[pick(c) for c in columns])
