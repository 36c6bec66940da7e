"""Status, report items and the aggregates shown in reports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.anchors import species_anchor
from ..functions.expr import blank_to_null, first_filled, round_exact, strip
from .dedup import output_order
from .rescue import candidates_or_match
from .rows import percent

STATE = dict(V.STATES)


def _column(df, name, kind="string"):
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def status_and_confidence(final_band, bands, j_score) -> Column:
    """Report status with its confidence."""
    band = F.translate(F.lower(first_filled(final_band, bands, F.lit("red"))), "-", "_")
    score = F.coalesce(j_score, F.lit(0.0))

    def result(state, confidence):
        value = F.lit(confidence) if isinstance(confidence, float) else confidence
        return F.struct(F.lit(STATE[state]).alias("status"), value.alias("confidence"))

    return (
        F.when(band.contains("green") & ~band.contains("yellow"), result("GREEN", 1.0))
        .when(band.contains("auto_accept"), result("GREEN", 1.0))
        .when(band.contains("yellow_green"), result("YELLOW_GREEN", 0.95))
        .when(
            band.contains("yellow") | band.contains("grey_zone"),
            result("YELLOW", F.greatest(score, F.lit(0.60))),
        )
        .when(band.contains("black") | band.contains("not_found"), result("BLACK", 0.0))
        .otherwise(result("RED", score))
    )


def report_candidates(text, mat, suggested, j_score) -> Column:
    """All ties with the score of the winner and 0.5 for the others."""
    winner = first_filled(suggested, mat)
    own = F.when(j_score.isNull() | (j_score == 0), F.lit(0.5)).otherwise(j_score)
    return F.transform(
        candidates_or_match(text, mat),
        lambda m: F.struct(
            m.alias("model_id"),
            round_exact(F.when(m.eqNullSafe(winner), own).otherwise(F.lit(0.5)), 2).alias("score"),
            F.lit("Jaccard Similarity").alias("reason"),
        ),
    )


def _winners(final: DataFrame) -> DataFrame:
    """``pos, tie_id, winner, own``: the model a row stands for and its score."""
    winner = first_filled(_column(final, "suggested_gem"), _column(final, "mat"))
    own = F.when(F.coalesce("j_score", F.lit(0.0)) == 0, F.lit(0.5)).otherwise(F.col("j_score"))
    return final.select("pos", "tie_id", winner.alias("winner"), round_exact(own, 2).alias("own"))


def candidate_rows(final: DataFrame, ties: DataFrame) -> DataFrame:
    """Report candidates as rows: ``pos, place, model_id, score, reason``.

    Tie sets are joined, not copied into the rows; only the winner's score differs from 0.5.
    """
    return _winners(final).join(ties, "tie_id").select(
        "pos",
        "place",
        F.col("model").alias("model_id"),
        F.when(F.col("model").eqNullSafe(F.col("winner")), F.col("own")).otherwise(F.lit(0.5)).alias("score"),
        F.lit("Jaccard Similarity").alias("reason"),
    )


def candidate_totals(final: DataFrame, ties: DataFrame) -> DataFrame:
    """:func:`candidate_rows` summed up: ``pos, score, n, first_model, places``.

    Rows are as many as rows times members of their tie sets; none of them is formed. All but the
    winner score 0.5, so a row takes the totals of its set less the share of the winner. A set's two
    first models are kept: the second is the first of the others where the winner is the first.
    """
    members = ties.groupBy("tie_id", "model").agg(F.count(F.lit(1)).alias("n"), F.sum("place").alias("places"))
    named = members.where("model is not null").select("tie_id", "model")
    order = Window.partitionBy("tie_id").orderBy("model")
    firsts = named.withColumn("nth", F.row_number().over(order)).where("nth <= 2").groupBy("tie_id").agg(
        F.min("model").alias("first"), F.max(F.when(F.col("nth") == 2, F.col("model"))).alias("second")
    )
    sets = members.groupBy("tie_id").agg(F.sum("n").alias("n"), F.sum("places").alias("places")).join(firsts, "tie_id", "left")
    own = members.select(
        F.col("tie_id").alias("_set"), F.col("model").alias("_model"), F.col("n").alias("n_own"), F.col("places").alias("places_own")
    )
    rows = _winners(final).join(sets, "tie_id")
    rows = rows.join(own, (F.col("tie_id") == F.col("_set")) & F.col("winner").eqNullSafe(F.col("_model")), "left")
    there = F.col("n_own").isNotNull()
    nothing = F.lit(0).cast("long")
    others = F.struct(
        F.lit(0.5).alias("score"),
        (F.col("n") - F.coalesce("n_own", nothing)).alias("n"),
        F.when(there & F.col("winner").eqNullSafe(F.col("first")), F.col("second")).otherwise(F.col("first")).alias("first_model"),
        # places without a value are in no sum
        F.when(there, F.coalesce("places", nothing) - F.coalesce("places_own", nothing)).otherwise(F.col("places")).alias("places"),
    )
    winner = F.struct(
        F.col("own").alias("score"), F.coalesce("n_own", nothing).alias("n"),
        F.when(there, F.col("winner")).alias("first_model"), F.col("places_own").alias("places"),
    )
    return rows.select("pos", F.inline(F.array(winner, others))).where("n > 0").groupBy("pos", "score").agg(
        F.sum("n").alias("n"), F.min("first_model").alias("first_model"), F.sum("places").alias("places")
    )


def report_items(final: DataFrame) -> DataFrame:
    """One report item per row of the final mapping; ordering columns are kept.

    Candidates are listed where the rows carry them as text; else see :func:`candidate_rows` and
    :func:`candidate_totals`.
    """
    j = F.coalesce(_column(final, "j_score", "double"), F.lit(0.0))
    mat, gem = _column(final, "mat"), _column(final, "suggested_gem")
    state = status_and_confidence(_column(final, "final_band"), _column(final, "bands"), j)
    abundance = _column(final, "abundance", "double")
    listed = []
    if "mat_candidates_str" in final.columns:
        listed = [report_candidates(F.col("mat_candidates_str"), mat, gem, j).alias("candidates")]
    order = [c for c in ("group_pos", "has_code_or_cc", "j_score", "n_candidates", "pos") if c in final.columns]
    return final.withColumn("_state", state).select(
        *order,
        first_filled(_column(final, "taxa_name"), F.col("taxon"), F.lit("Unknown")).alias("query_name"),
        F.when(~F.isnan(abundance), abundance).alias("abundance"),
        F.coalesce(first_filled(gem, mat), F.lit("")).alias("mapped_id"),
        F.col("_state.status").alias("status"),
        round_exact(F.col("_state.confidence"), 4).alias("confidence_score"),
        *listed,
    )


def status_summary(items: DataFrame) -> DataFrame:
    """Every state with its count, share and bar length; states without rows count 0."""
    counted = items.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    states = F.inline(
        F.array(
            *[
                F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"), F.lit(v).alias("status"))
                for i, (n, v) in enumerate(V.STATES)
            ]
        )
    )
    total = items.select(F.count(F.lit(1))).scalar()
    return (
        items.sparkSession.range(1)
        .select(states)
        .join(counted, "status", "left")
        .withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        .withColumn("total", total)
        .select(
            "place",
            "name",
            "status",
            "n",
            percent(F.col("n"), F.col("total")).alias("pct"),
            F.coalesce(
                F.floor(F.col("n") / F.nullif("total", F.lit(0).cast("long")) * 100 / 5),
                F.lit(0).cast("long"),
            ).alias("bar"),
        )
    )


def outcome_counts(rescued: DataFrame) -> DataFrame:
    return rescued.groupBy("final_band").agg(F.count(F.lit(1)).alias("n"))


def resolved_band(bands, final_band) -> Column:
    """Final band of a row, black where rescue gave none."""
    given = blank_to_null(strip(final_band))
    given = F.when(given != "nan", given)
    return F.when(bands == "auto-accept", "green").otherwise(F.coalesce(given, F.lit("black")))


def flow_links(final: DataFrame) -> DataFrame:
    """Weighted links from all names to match bands and on to final bands."""
    rows = final.select(
        F.col("bands"),
        resolved_band(F.col("bands"), _column(final, "final_band")).alias("final"),
    ).where(F.col("bands").isin(V.BANDS))
    pairs = rows.groupBy("bands", "final").agg(F.count(F.lit(1)).alias("value"))
    into = pairs.groupBy(F.col("bands").alias("target")).agg(F.sum("value").alias("value"))
    out = pairs.where(F.col("final").isin(V.FINAL_BANDS))
    return into.select(F.lit("All Taxa").alias("source"), "target", "value").unionByName(
        out.select(F.col("bands").alias("source"), F.col("final").alias("target"), "value")
    )


def dedup_audit(inputs: DataFrame, kept: DataFrame) -> DataFrame:
    """Input rows with a flag for dropped names and the last survivor of their anchor."""
    names = kept.select(F.col("taxa_name").alias("_kept")).distinct()
    heirs = kept.groupBy(F.coalesce("anchor", F.lit("")).alias("_anchor")).agg(
        F.max_by("taxa_name", F.struct(*output_order())).alias("_heir")
    )
    audited = (
        inputs.withColumn("_anchor", species_anchor(F.col("taxon")))
        .join(names, inputs["taxa_name"] == names["_kept"], "left")
        .join(heirs, "_anchor", "left")
    )
    dropped = F.col("_kept").isNull()
    return audited.select(
        "pos",
        "taxa_name",
        "taxon",
        dropped.alias("dropped"),
        F.when(dropped, F.col("_heir")).alias("merged_into"),
    )


def parse_ranked(text) -> Column:
    """Items of a ranked list; an item without score gets ``?``."""
    items = F.filter(F.transform(F.split(text, ";"), strip), lambda i: i != "")

    def item(i):
        parts = F.split(i, "@@")
        n = F.size(parts)
        whole = (n != 2) & (n != 3)
        return F.struct(
            F.when(whole, i).otherwise(parts[0]).alias("model"),
            F.when(whole, "?").otherwise(F.get(parts, F.lit(1))).alias("score"),
            F.coalesce(F.when(n == 3, F.get(parts, F.lit(2))), F.lit("")).alias("reason"),
        )

    empty = F.array().cast("array<struct<model:string,score:string,reason:string>>")
    none = text.isNull() | (text == "") | (text == "no candidates")
    return F.when(none, empty).otherwise(F.transform(items, item))


def detail_records(matched: DataFrame, rescued: DataFrame | None, items: DataFrame) -> DataFrame:
    """Matched rows with their rescue and report rows, as the detail pages show them."""
    found = items.select(
        F.col("query_name").alias("_q"), "status", "confidence_score", "mapped_id", "pos"
    )
    found = found.groupBy("_q").agg(
        F.max_by(F.struct("status", "confidence_score", "mapped_id"), "pos").alias("_f")
    )
    listed = candidates_or_match(F.col("mat_candidates_str"), F.lit(None).cast("string"))
    out = matched.withColumn("candidates", listed)
    out = out.join(found, out["taxa_name"] == found["_q"], "left")
    hidden = F.col("_f.mapped_id").isin("no_suggestion", "")
    out = out.withColumns(
        {
            "status": F.coalesce("_f.status", F.lit("")),
            "confidence_score": F.coalesce("_f.confidence_score", F.lit(0.0)),
            "mapped_id": F.when(~hidden, F.col("_f.mapped_id")).otherwise(""),
        }
    ).drop("_q", "_f")
    if rescued is None:
        return out
    fields = [
        "canonical", "rank", "top_score", "n_top_ties", "confidence", "match_level",
        "final_band", "rationale_scoring", "rationale_final",
    ]
    ranked = parse_ranked(F.col("ranked_candidates"))
    gem = F.when(~F.col("suggested_gem").isin("no_suggestion", ""), F.col("suggested_gem"))
    last = rescued.withColumn("_gem", F.coalesce(gem, F.lit(""))).withColumn("_ranked", ranked)
    detail = F.struct(
        *fields,
        F.size("_ranked").alias("n_candidates"),
        F.col("_ranked").alias("candidates"),
        F.col("_gem").alias("preferred"),
    )
    last = last.groupBy(F.col("taxon").alias("_t")).agg(F.max_by(detail, "pos").alias("rescue"))
    return out.join(last, out["taxon"] == last["_t"], "left").drop("_t")


def status_table(items: DataFrame) -> DataFrame:
    """States that occur, with count and share."""
    total = items.select(F.count(F.lit(1))).scalar()
    return (
        items.groupBy("status")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("pct", percent(F.col("n"), total))
    )
