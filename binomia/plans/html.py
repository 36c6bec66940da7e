"""HTML pages of a run, written as ordered text parts by Spark."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE_COLORS = {
    "unambiguous": "#1b6ca8",
    "high_similarity": "#3f9ac0",
    "near_tier": "#b98b12",
    "low_similarity": "#a8461b",
    "no_correspondence": "#5c5c66",
}


def escaped(text):
    out = F.coalesce(text.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def row_of(*cells):
    parts = [F.concat(F.lit("<td>"), escaped(c), F.lit("</td>")) for c in cells]
    return F.concat(F.lit("<tr>"), *parts, F.lit("</tr>"))


def badge(status):
    color = F.lit("#888")
    for name, value in STATE_COLORS.items():
        color = F.when(status == name, value).otherwise(color)
    return F.concat(
        F.lit("<span style='color:"), color, F.lit("'>"), escaped(status), F.lit("</span>")
    )


def detail_cards(details: DataFrame):
    """One card of text per matched row."""
    rescue_text = F.lit("")
    if "rescue" in details.columns:
        r = F.col("rescue")
        ranked = F.array_join(
            F.transform(
                r["candidates"],
                lambda c: F.concat(escaped(c["model"]), F.lit(" ("), escaped(c["score"]), F.lit(")")),
            ),
            ", ",
        )
        rescue_text = F.when(
            r.isNotNull(),
            F.concat(
                F.lit("<table>"),
                row_of(F.lit("canonical"), r["canonical"]),
                row_of(F.lit("rank"), r["rank"]),
                row_of(F.lit("top score"), r["top_score"]),
                row_of(F.lit("ties"), r["n_top_ties"]),
                row_of(F.lit("final band"), r["final_band"]),
                row_of(F.lit("rationale"), r["rationale_final"]),
                F.lit("</table><p>"), ranked, F.lit("</p>"),
            ),
        ).otherwise("")
    return F.concat(
        F.lit("<div class='card'><h3>"), escaped(F.col("taxa_name")), F.lit(" "), badge(F.col("status")),
        F.lit(" &rarr; "), escaped(F.col("mapped_id")), F.lit("</h3><table>"),
        row_of(F.lit("confidence"), F.format_string("%.2f", F.col("confidence_score"))),
        row_of(F.lit("anchor"), F.col("anchor")),
        row_of(F.lit("score"), F.col("j_score")),
        row_of(F.lit("band"), F.col("bands")),
        row_of(F.lit("candidates"), F.col("n_candidates")),
        F.lit("</table><p>"), escaped(F.array_join("candidates", " | ")), F.lit("</p>"),
        rescue_text, F.lit("</div>"),
    )


def html_lines(job_id: str, totals, breakdown, states, audit, details, order) -> DataFrame:
    """All lines of the page with the keys ``part`` and ``place`` to sort by."""
    spark = details.sparkSession

    def fixed(part, text):
        return spark.range(1).select(
            F.lit(part).alias("part"), F.struct(F.lit(0.0).alias("k0")).alias("place"), F.lit(text).alias("text")
        )

    def lines(part, df, text, keys):
        place = F.struct(*[k.cast("double").alias(f"k{i}") for i, k in enumerate(keys)])
        return df.select(F.lit(part).alias("part"), place.alias("place"), text.alias("text"))

    t = F.col
    pieces = [
        fixed(0, f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{job_id}</title></head><body><h1>{job_id}</h1>"),
        fixed(10, "<h2>Filtering</h2><table>"),
        lines(11, totals, F.concat(
            row_of(F.lit("total"), t("total_taxa")), row_of(F.lit("accepted"), t("auto_accepted")),
            row_of(F.lit("rescue"), t("need_rescue")), row_of(F.lit("rescue %"), t("need_rescue_pct"))), [F.lit(0)]),
        lines(12, breakdown, row_of(t("bands"), t("n")), [-t("n")]),
        fixed(13, "</table><h2>States</h2><table>"),
        lines(14, states, F.concat(F.lit("<tr><td>"), badge(t("status")), F.lit("</td>"),
              F.lit("<td>"), t("n").cast("string"), F.lit("</td><td>"), t("pct").cast("string"), F.lit("%</td></tr>")), [-t("n")]),
        fixed(15, "</table><h2>Removed names</h2><table>"),
        lines(16, audit.where("dropped"), row_of(t("taxa_name"), t("taxon"), t("merged_into")), [t("pos")]),
        fixed(17, "</table><h2>Names</h2>"),
    ]
    cards = lines(18, details, detail_cards(details), order)
    end = fixed(19, "</body></html>")
    out = pieces[0].withColumn("place", F.lit(0.0))
    for piece in [*pieces[1:], end]:
        out = out.unionByName(piece.withColumn("place", F.col("place.k0")))
    keys = [f"k{i}" for i in range(len(order))]
    wide = out.select("part", F.col("place").alias("k0"), "text")
    return wide.unionByName(cards.select("part", "place.*", "text"), allowMissingColumns=True).select(
        "part", *keys, "text"
    )


def write_html(lines: DataFrame, path) -> None:
    keys = [c for c in lines.columns if c != "text"]
    lines.orderBy(*keys).select("text").write.mode("overwrite").text(str(path))
