import pytest
from pyspark.sql import functions as F

from binomia.functions import vocab as V
from binomia.operators import lookup, rescue, taxonomy
from binomia.sources import dump


@pytest.fixture
def found(spark, dump_folder):
    parts = [dump.read_dump(spark, str(dump_folder / f"{n}.dmp")) for n in ("nodes", "names", "merged")]
    records, keys, _ = taxonomy.compile_taxonomy(*parts)
    return lookup.from_taxonomy(records, keys)


def saved(spark, found, *rows):
    df = spark.createDataFrame(list(rows), "taxon string, mat_candidates_str string")
    return {r["taxon"]: r for r in rescue.rescue(df, found).collect()}


def test_renamed_names_are_found(spark, found):
    got = saved(
        spark, found,
        ("Phocaeicola vulgatus", "Phocaeicola_dorei_X;Phocaeicola_vulgatus_ERR1;Prevotella_copri;phocaeicola_x"),
        ("NAME::Bacteroides vulgatus", "Phocaeicola_vulgatus_ERR1"),
        ("Nobody here", "A_b;A_b"),
    )
    first = got["Phocaeicola vulgatus"]
    assert [c.split("@@")[1] for c in first["ranked_candidates"].split(";")] == ["100", "60", "20", "0"]
    assert (first["final_band"], first["n_candidates"], first["median_score"]) == ("yellow_green", 4, 40.0)
    assert first["rationale_final"] == V.WHY_SOFT + V.NOTE_YELLOW_GREEN
    assert got["Bacteroides vulgatus"]["final_band"] == "yellow_green"
    lost = got["Nobody here"]
    assert (lost["final_band"], lost["suggested_gem"], lost["ranked_candidates"]) == (
        "black", "no_suggestion", "no candidates")
    assert (lost["n_candidates"], lost["rationale_scoring"], lost["median_score"]) == (2, V.NO_RECORD, None)


def test_full_name_is_green(spark, found):
    got = saved(spark, found, ("Phocaeicola vulgatus ERR1 X", "a"), ("Phocaeicola vulgatus", "Phocaeicola_vulgatus"))
    assert got["Phocaeicola vulgatus"]["final_band"] == "green"
    assert got["Phocaeicola vulgatus"]["match_level"] == "full_exact"


def test_scores_by_pool(spark):
    df = spark.createDataFrame(
        [("Foo_bar",), ("Foo_sp_1",), ("Foo_other",), ("Else_bar",), ("foo_bar",), ("Foo",)], "m string"
    ).coalesce(1)

    def scores(pool, genera, is_sp):
        a = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
        record = {
            "names_canon": a(pool), "genera_one": a([]), "epithets_one": a([]), "genera_canon": a(genera),
            "sp_heads": a([p.split()[0] for p in pool if " sp" in p]), "canonical_is_sp": F.lit(is_sp),
        }
        pair = rescue.model_pair(F.col("m"))
        rows = df.withColumns(record).withColumn("p", pair)
        score = F.when(F.col("p").isNull(), 0).otherwise(rescue.pair_score(F.col("p.g"), F.col("p.s")))
        return [r[0] for r in rows.select(score).collect()]

    assert scores(["foo bar", "foo sp"], ["foo"], False) == [100, 75, 60, 20, 0, 0]
    assert scores(["foo sp"], ["foo"], True) == [70, 75, 70, 20, 0, 0]
    assert scores([], [], False) == [20, 20, 20, 20, 0, 0]


@pytest.mark.parametrize(
    "scores, tier, n_top, top, other, median, hundreds",
    [
        ([], "red", 0, 0, None, None, 0),
        ([60, 20], "red", 1, 60, 20.0, 40.0, 0),
        ([100, 20, 60, 75, 70], "green", 1, 100, 65.0, 70.0, 1),
        ([100, 100], "yellow", 2, 100, None, 100.0, 2),
        ([100, 100, 75], "red", 2, 100, 75.0, 100.0, 2),
        ([100] * 6, "red", 6, 100, None, 100.0, 6),
    ],
)
def test_summary(spark, scores, tier, n_top, top, other, median, hundreds):
    df = spark.createDataFrame([(scores,)], "s array<int>")
    r = df.select(rescue.score_summary(F.col("s")).alias("x")).first()["x"]
    assert (r["tier"], r["n_top"], r["top_score"], r["median_other"], r["median_score"], r["n_100s"]) == (
        tier, n_top, top, other, median, hundreds)


LADDER = [
    # taxon, gem, ties, top, n_100s, median -> colour, level
    ("Foo bar", "Foo_bar", 3, 100, 3, 100.0, "green", "full_exact"),
    ("Foo bar X1", "Foo_bar_X1", 30, 100, 30, 100.0, "green", "full_exact"),
    ("Foo bar subsp. baz", "Foo_baz", 2, 60, 0, 60.0, "green", "full_exact"),
    ("Foo bar", "Foo_bar_Z", 11, 100, 11, 100.0, "red", "gs_exact"),
    ("Foo bar", "Foo_bar_Z", 1, 100, 1, 100.0, "yellow_green", "none"),
    ("Foo bar", "Foo_bar_Z", 5, 100, 5, 100.0, "yellow", "none"),
    ("Foo bar", "Foo_bar_Z", 6, 100, 6, 100.0, "yellow", "gs_exact"),
    ("Foo bar", "Else_bar", 11, 60, 0, 60.0, "red", "gs_exact"),
    ("Foo bar", "Else_bar", 2, 60, 0, 60.0, "yellow", "gs_exact"),
    ("Foo bar", "Else_bar", 2, 20, 0, 20.0, "black", "none"),
    ("Foo bar", "", 0, 0, 0, None, "black", "none"),
]


def test_ladder(spark):
    rows = [(i, t, g, n, s, h, m) for i, (t, g, n, s, h, m, _, _) in enumerate(LADDER)]
    df = spark.createDataFrame(
        rows, "i int, taxon string, suggested_gem string, n_top_ties int, top_score int, n_100s int, median_score double"
    ).withColumns(
        {
            "canonical_gs": F.lit("Foo bar"),
            "gs_aliases": F.array().cast("array<struct<g:string,s:string>>"),
            "confidence": F.lit("red"),
            "ranked_candidates": F.lit("x"),
        }
    )
    got = [(r["final_color"], r["match_level"]) for r in rescue.reclassify(df).orderBy("i").collect()]
    assert got == [(c, level) for *_, c, level in LADDER]


def test_candidate_texts(evaluate):
    got = evaluate(["a; b;;c ", "['x', 'y']", "", None, "[a;b]"], rescue.candidate_list)
    assert [r[0] for r in got] == [["a", "b", "c"], ["x", "y"], [], [], ["[a", "b]"]]
