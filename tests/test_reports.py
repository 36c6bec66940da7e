import pytest
from pyspark.sql import functions as F

from binomia.functions import vocab as V
from binomia.operators import analytics, report


@pytest.mark.parametrize(
    "final, bands, status, confidence",
    [
        (None, "auto-accept", "unambiguous", 1.0),
        ("green", "flag", "unambiguous", 1.0),
        ("yellow_green", "flag", "high_similarity", 0.95),
        ("yellow", "flag", "near_tier", 0.6),
        (None, "grey-zone", "near_tier", 0.6),
        ("", "flag", "low_similarity", 0.4),
        ("red", "flag", "low_similarity", 0.4),
        ("black", "flag", "no_correspondence", 0.0),
        (None, None, "low_similarity", 0.4),
    ],
)
def test_status(spark, final, bands, status, confidence):
    df = spark.createDataFrame([(final, bands, 0.4)], "f string, b string, j double")
    r = df.select(report.status_and_confidence(F.col("f"), F.col("b"), F.col("j")).alias("s")).first()["s"]
    assert (r["status"], r["confidence"]) == (status, confidence)


FINAL = "pos long, taxa_name string, taxon string, mat string, suggested_gem string, mat_candidates_str string, bands string, final_band string, j_score double, abundance double"


@pytest.fixture
def final(spark):
    return spark.createDataFrame(
        [
            (0, "A", "a", "m1", None, "m1;m2", "auto-accept", None, 0.955, float("nan")),
            (1, "B", "b", "m1", "m2", "m1;m2", "flag", "yellow", 0.4, 2.0),
            (2, "", "c", "", "", "", "not-accept", "black", 0.0, None),
            (3, "D", "d", "m3", "no_suggestion", "m3", "flag", None, 0.0, 1.0),
        ],
        FINAL,
    )


def test_items(final):
    got = {r["pos"]: r for r in report.report_items(final).collect()}
    assert got[0]["abundance"] is None and got[0]["mapped_id"] == "m1"
    assert [(c["model_id"], c["score"]) for c in got[0]["candidates"]] == [("m1", round(0.955, 2)), ("m2", 0.5)]
    assert [(c["model_id"], c["score"]) for c in got[1]["candidates"]] == [("m1", 0.5), ("m2", 0.4)]
    assert (got[2]["query_name"], got[2]["mapped_id"], got[2]["candidates"]) == ("c", "", [])
    assert [c["score"] for c in got[3]["candidates"]] == [0.5]


def test_summary_has_every_state(final):
    rows = report.status_summary(report.report_items(final)).orderBy("place").collect()
    assert [(r["name"], r["n"], r["pct"], r["bar"]) for r in rows] == [
        ("GREEN", 1, 25.0, 5), ("YELLOW_GREEN", 0, 0.0, 0), ("YELLOW", 1, 25.0, 5),
        ("RED", 1, 25.0, 5), ("BLACK", 1, 25.0, 5),
    ]


def test_flow(final):
    got = {(r["source"], r["target"]): r["value"] for r in report.flow_links(final).collect()}
    assert got == {
        ("All Taxa", "auto-accept"): 1, ("All Taxa", "flag"): 2, ("All Taxa", "not-accept"): 1,
        ("auto-accept", "green"): 1, ("flag", "yellow"): 1, ("flag", "black"): 1, ("not-accept", "black"): 1,
    }


def test_ranked(evaluate):
    got = evaluate(["a@@100@@why;b@@20;c", "no candidates", None], report.parse_ranked)
    assert [tuple(x) for x in got[0][0]] == [("a", "100", "why"), ("b", "20", ""), ("c", "?", "")]
    assert got[1][0] == got[2][0] == []


def test_details_keep_all_candidates(final):
    many = final.withColumn("mat_candidates_str", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(150)), lambda x: x.cast("string")), ";"))
    many = many.withColumn("n_candidates", F.lit(150))
    shown = report.detail_records(many, None, report.report_items(final)).select(F.size("candidates").alias("n")).collect()
    assert {r["n"] for r in shown} == {150}


def test_bins(evaluate):
    values = [None, 0, 1, 3, 4, 63, 64, 1001]
    got = evaluate(values, analytics.tie_bin, analytics.candidate_bin, analytics.tie_bin_with_zero, kind="int")
    assert got == [
        (None, None, None), (None, None, "0"), ("1", "1", "1"), ("2–3", "3-5", "3-5"), ("4–7", "3-5", "3-5"),
        ("32–63", "51-100", "51-100"), ("≥64", "51-100", "51-100"), ("≥64", ">1000", ">1000"),
    ]


def test_grid_is_complete(spark):
    df = spark.createDataFrame(
        [("red", 100, 1), ("red", 100, 1), ("red", 60, 0), ("black", 0, 0)], "final_color string, top_score int, n_top_ties int"
    )
    grid = analytics.heat_grid(df)
    assert grid.count() == 2 * 6 * 10
    top = grid.where("n = 2").first()
    assert (top["top_score"], top["ties_bin"], top["intensity"], top["tier_n"]) == (100, "1", 1.0, 3)
    assert grid.where("top_score = 60 and n = 1").first()["intensity"] == 0.5


def test_join_counts_multiply(spark):
    left = spark.createDataFrame([("x", "flag")] * 3 + [("y", "auto-accept")], "taxon string, bands string")
    right = spark.createDataFrame([("x", "red")] * 2, "taxon string, final_color string")
    got = {(r["source"], r["target"]): r["value"] for r in analytics.rescue_flow(left, right).collect()}
    assert got == {("All Taxa", "flag"): 3, ("All Taxa", "auto-accept"): 1, ("auto-accept", "green"): 1, ("flag", "red"): 6}


def test_panels(spark):
    df = spark.createDataFrame(
        [("t" * 40, "other", "red", "green", True, True), ("u", "other", "green", None, False, False),
         ("v", "o", "green", "red", False, True), ("w", None, "red", "red", False, False)],
        "taxon string, other_name string, own_band string, other_band string, name_changed boolean, band_changed boolean",
    )
    compared = analytics.compare_panels(df)
    got = {r["taxon"][0]: (r["direction"], r["label"]) for r in compared.collect()}
    assert got == {
        "t": ("improved", "t" * 23 + "...\n→ other"),
        "u": ("no MetaPhlAn equivalent", "u"),
        "v": ("degraded", "v"),
    }
    assert analytics.panel_points(compared).count() == 5
    assert analytics.changed_segments(compared).count() == 2


def test_input_types(spark):
    df = spark.createDataFrame(
        [("CAG 12", 1, 0.0), ("Foo Bacterium", 0, 0.2), ("Foo bar", 0, 0.0), ("Foo bar", 0, 0.5)], "n string, c int, j double"
    ).coalesce(1)
    got = [r[0] for r in df.select(analytics.input_type(F.col("n"), F.col("c"), F.col("j"))).collect()]
    assert got == ["CAG / unculture", "Higher-rank label", "Absent from reference", "Canonical binomial"]


def test_states_are_fixed():
    assert [s for _, s in V.STATES][0] == "unambiguous" and len(V.STATES) == 5


def test_candidate_totals_equal_the_rows_without_forming_them(spark):
    final = spark.createDataFrame(
        [(1, "s", "a", 0.9), (2, "s", "b", 0.5), (3, "s", "zz", 0.8), (4, "t", "a", 0.7), (5, "s", None, None), (6, "u", "a", 0.4), (7, "none", "a", 0.4)],
        "pos long, tie_id string, mat string, j_score double",
    )
    ties = spark.createDataFrame(
        [("s", 0, "b"), ("s", 1, "a"), ("s", 2, "a"), ("s", 3, "c"), ("t", 1, "a"), ("u", 7, "b")],
        "tie_id string, place long, model string",
    )
    totals = report.candidate_totals(final, ties)
    rows = report.candidate_rows(final, ties).groupBy("pos", "score").agg(
        F.count(F.lit(1)).alias("n"), F.min("model_id").alias("first_model"), F.sum("place").alias("places")
    )
    assert totals.columns == rows.columns
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, rows.collect()))
    # 20 000 rows with 20 000 members each would be 400 million pairs
    many = spark.range(20_000).selectExpr("id as pos", "'s' as tie_id", "concat('m', id) as mat", "0.9d as j_score")
    members = spark.range(20_000).selectExpr("'s' as tie_id", "id as place", "concat('m', id) as model")
    summed = report.candidate_totals(many, members).where("score = 0.5")
    assert summed.agg(F.count(F.lit(1)), F.min("n"), F.max("n")).first() == (20_000, 19_999, 19_999)
