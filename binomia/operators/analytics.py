"""Aggregates behind the quality plots."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.names import truncated

# Bin edges (right-closed) and labels of the published plots.
TIE_EDGES = [(1, "1"), (3, "2–3"), (7, "4–7"), (15, "8–15"), (31, "16–31"), (63, "32–63")]
TIE_REST = "≥64"
CANDIDATE_EDGES = [
    (1, "1"), (2, "2"), (5, "3-5"), (10, "6-10"), (50, "11-50"), (100, "51-100"),
    (500, "101-500"), (1000, "501-1000"),
]
CANDIDATE_REST = ">1000"
SCORE_LEVELS = [100, 75, 70, 60, 20, 0]

DOUBLES = ["j_score", "top_score", "n_100s"]
INTEGERS = ["n_candidates", "has_code_or_cc", "anchor_tokens", "n_top_ties"]
FLAGS = ["has_gs", "is_not_found"]


def typed(mapping: DataFrame) -> DataFrame:
    """Cast the columns of a mapping read back from text."""
    casts = {c: F.col(c).try_cast("double") for c in DOUBLES if c in mapping.columns}
    casts |= {c: F.col(c).try_cast("double").cast("int") for c in INTEGERS if c in mapping.columns}
    casts |= {c: F.lower(F.col(c).cast("string")) == "true" for c in FLAGS if c in mapping.columns}
    return mapping.withColumns(casts) if casts else mapping


def input_type(taxa_name, has_code, j_score) -> Column:
    return (
        F.when(has_code == 1, "CAG / unculture")
        .when(taxa_name.rlike(r"(?iU)\bbacterium\b") & (has_code == 0), "Higher-rank label")
        .when(j_score == 0, "Absent from reference")
        .otherwise("Canonical binomial")
    )


def binned(value, edges, rest) -> Column:
    """Label of the right-closed bin; null for values of 0 and below."""
    out = F.when(value.isNull() | (value <= 0), F.lit(None).cast("string"))
    for edge, label in edges:
        out = out.when(value <= edge, label)
    return out.otherwise(rest)


def tie_bin(n) -> Column:
    return binned(n, TIE_EDGES, TIE_REST)


def candidate_bin(n) -> Column:
    return binned(n, CANDIDATE_EDGES, CANDIDATE_REST)


def tie_bin_with_zero(n) -> Column:
    return F.when(n == 0, "0").otherwise(candidate_bin(n))


def score_bin(top_score) -> Column:
    return F.bround(top_score / F.lit(25.0)) * 25


def score_histogram(matched: DataFrame, width: float = 0.05) -> DataFrame:
    """Names per score bin and band."""
    return (
        matched.where(F.col("j_score").isNotNull())
        .groupBy(F.floor(F.col("j_score") / width).alias("bin"), "bands")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def multiplicity(matched: DataFrame) -> DataFrame:
    """Names per candidate bin and band."""
    return (
        matched.withColumn("candidates_bin", candidate_bin(F.col("n_candidates")))
        .where(F.col("j_score").isNotNull() & F.col("candidates_bin").isNotNull())
        .groupBy("candidates_bin", "bands")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def heat_tiles(rescued: DataFrame) -> DataFrame:
    """Found names per final band, score bin and tie bin, with the band total."""
    rows = rescued.where(~F.col("is_not_found")).select(
        "final_band",
        score_bin(F.col("top_score")).alias("score_bin"),
        tie_bin(F.col("n_top_ties")).alias("tie_bin"),
    )
    tiles = rows.groupBy("final_band", "score_bin", "tie_bin").agg(F.count(F.lit(1)).alias("n"))
    totals = tiles.groupBy("final_band").agg(F.sum("n").alias("tier_n"))
    return tiles.where("score_bin is not null and tie_bin is not null").join(totals, "final_band")


def heat_grid(rescued: DataFrame) -> DataFrame:
    """Complete grid of final colour, score and tie bin with the share of the maximum.

    Scores and bins always span all their levels, colours only those that occur. That
    is at most five colours, seven scores and eleven bins, whatever the input.
    """
    level = F.col("top_score").cast("int")
    counts = (
        rescued.select(
            "final_color",
            F.when(level.isin(SCORE_LEVELS), level).alias("top_score"),
            tie_bin_with_zero(F.col("n_top_ties")).alias("ties_bin"),
        )
        .groupBy("final_color", "top_score", "ties_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bins = ["0"] + [label for _, label in CANDIDATE_EDGES] + [CANDIDATE_REST]
    sets = counts.agg(
        F.collect_set("final_color").alias("colors"),
        _levels("top_score", SCORE_LEVELS).alias("scores"),
        _levels("ties_bin", bins).alias("bins"),
    )
    grid = (
        sets.select(F.explode("colors").alias("final_color"), "scores", "bins")
        .select("final_color", F.inline("scores"), "bins")
        .select("final_color", "top_score", F.inline("bins"))
    )
    full = grid.alias("g").join(
        counts.alias("c"),
        (F.col("g.final_color") == F.col("c.final_color"))
        & F.col("g.top_score").eqNullSafe(F.col("c.top_score"))
        & F.col("g.ties_bin").eqNullSafe(F.col("c.ties_bin")),
        "left",
    ).select("g.*", F.coalesce("c.n", F.lit(0).cast("long")).alias("n"))
    top = F.max("n").over(Window.partitionBy("final_color"))
    total = F.sum("n").over(Window.partitionBy("final_color"))
    return full.withColumns({"n_max": top, "tier_n": total}).withColumn(
        "intensity", F.when(F.col("n_max") > 0, F.col("n") / F.col("n_max")).otherwise(0.0)
    )


def _levels(name, levels) -> Column:
    """All fixed levels as structs, and a null one where nulls occur."""
    fixed = F.array(*[F.struct(F.lit(v).alias(name)) for v in levels])
    return F.array_distinct(F.concat(fixed, F.collect_set(F.struct(name))))


def rescue_flow(matched: DataFrame, rescued: DataFrame) -> DataFrame:
    """Links from an inner join of matched and rescued rows; duplicates multiply.

    Both sides are counted per name first, so a name that occurs often on both sides
    costs one row instead of the product.
    """
    left = matched.where(F.col("bands") != "auto-accept").groupBy("taxon", "bands").agg(
        F.count(F.lit(1)).alias("l")
    )
    right = rescued.groupBy("taxon", "final_color").agg(F.count(F.lit(1)).alias("r"))
    middle = (
        left.join(right, "taxon")
        .groupBy(F.col("bands").alias("source"), F.col("final_color").alias("target"))
        .agg(F.sum(F.col("l") * F.col("r")).alias("value"))
    )
    first = matched.groupBy(F.col("bands").alias("target")).agg(F.count(F.lit(1)).alias("value"))
    accepted = matched.agg(F.count_if(F.col("bands") == "auto-accept").alias("value"))
    return (
        first.select(F.lit("All Taxa").alias("source"), "target", "value")
        .unionByName(
            accepted.select(
                F.lit("auto-accept").alias("source"), F.lit("green").alias("target"), "value"
            )
        )
        .unionByName(middle)
        .where("source is not null and target is not null and value > 0")
    )


def _ordinal(band) -> Column:
    place = F.array_position(F.array(*[F.lit(b) for b in V.FINAL_BANDS]), band)
    return F.nullif(place, F.lit(0).cast("long"))


def compare_panels(comparison: DataFrame, other_system: str = "MetaPhlAn") -> DataFrame:
    """Direction of change between the final bands of two names of one taxon.

    Needs ``taxon, other_name, own_band, other_band, name_changed``.
    """
    own, other = _ordinal(F.col("own_band")), _ordinal(F.col("other_band"))
    label = F.when(
        F.col("name_changed"),
        F.concat(truncated(F.col("taxon"), 26), F.lit("\n→ "), truncated(F.col("other_name"), 26)),
    ).otherwise(truncated(F.col("taxon"), 32))
    direction = (
        F.when(other.isNull(), f"no {other_system} equivalent")
        .when(own > other, "improved")
        .when(own < other, "degraded")
        .otherwise("unchanged")
    )
    return comparison.where(F.col("other_name").isNotNull()).withColumns(
        {"direction": direction, "label": label}
    )


def panel_points(
    compared: DataFrame, own_system: str = "DIABLO", other_system: str = "MetaPhlAn"
) -> DataFrame:
    """Long form: one row per label and name system that has a band."""
    return (
        compared.select(
            "label",
            "direction",
            F.col("own_band").alias(f"{own_system} name"),
            F.col("other_band").alias(f"{other_system} name"),
        )
        .unpivot(
            ["label", "direction"],
            [f"{own_system} name", f"{other_system} name"],
            "source",
            "band",
        )
        .where(F.col("band").isin(V.FINAL_BANDS))
    )


def changed_segments(compared: DataFrame) -> DataFrame:
    """Rows marked as changed, with both bands."""
    return compared.where("band_changed").select("label", "own_band", "other_band", "direction")


def comparable_groups(df: DataFrame, value: str, group: str, pairs) -> DataFrame:
    """Of the given pairs of groups, those where at least one has any spread."""
    spread = df.groupBy(F.col(group).alias("g")).agg(F.stddev_samp(value).alias("sd"))
    listed = F.inline(
        F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in pairs])
    )
    wanted = df.sparkSession.range(1).select(listed)
    left = spread.select(F.col("g").alias("left"), F.col("sd").alias("sd_left"))
    right = spread.select(F.col("g").alias("right"), F.col("sd").alias("sd_right"))
    return (
        wanted.join(left, "left", "left")
        .join(right, "right", "left")
        .where("coalesce(sd_left, 0) > 0 or coalesce(sd_right, 0) > 0")
        .select("left", "right")
    )
