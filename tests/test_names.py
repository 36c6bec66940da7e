import time

import pytest
from pyspark.sql import functions as F

from binomia.functions import anchors, names, tokens
from binomia.functions.expr import round_exact


def one(results):
    return [r[0] for r in results]


def test_clean_name(evaluate):
    table = {
        "[Collinsella] massiliensis": "Collinsella massiliensis",
        "Akkermansia muciniphila ATCC BAA-835": "Akkermansia muciniphila ATCC BAA 835",
        "Bifidobacterium catenulatum PV20-2": "Bifidobacterium catenulatum PV20-2",
        "Mediterraneibacter_massiliensis ": "Mediterraneibacter_massiliensis",
        "A,  b;c  d": "A bc d",
        None: "",
    }
    assert one(evaluate(list(table), names.clean_name)) == list(table.values())


def test_token_set(evaluate):
    table = {
        "Akkermansia muciniphila ATCC BAA 835": ["ATCC_BAA_835", "Akkermansia", "muciniphila"],
        "Anaerostipes hadrus ATCC 29173 = JCM 17467": ["ATCC_29173", "Anaerostipes", "JCM_17467", "hadrus"],
        "Escherichia coli O157:H7": ["Escherichia", "H7", "O157", "coli"],
        "Alistipes onderdonkii subsp. vulgaris": ["Alistipes", "onderdonkii", "vulgaris"],
        "Agathobacter rectalis M104/1": ["1", "Agathobacter", "M104", "rectalis"],
        "austr x": ["aux"],
        "": [],
    }
    assert one(evaluate(list(table), tokens.token_set)) == list(table.values())


ANCHORS = {
    "Bacteroides fragilis": ("Bacteroides fragilis", "Bacteroides fragilis", 2),
    "Bacteroides fragilis YCH46": ("Bacteroides fragilis", "Bacteroides fragilis YCH46", 3),
    "Blautia sp. CAG 257": ("Blautia sp", "Blautia sp", 2),
    "Escherichia coli O157:H7 str. EDL933": ("Escherichia coli", "Escherichia coli O157:H7", 3),
    "Alistipes onderdonkii subsp. vulgaris": ("Alistipes onderdonkii", "Alistipes onderdonkii vulgaris", 3),
    "Bifidobacterium longum subsp. longum KACC 91563": (
        "Bifidobacterium longum", "Bifidobacterium longum longum KACC 91563", 4),
    "Candidatus Cibionibacter quicibialis": (
        "Cibionibacter quicibialis", "Candidatus Cibionibacter quicibialis", 2),
    "uncultured Blautia sp. X": ("uncultured Blautia sp", "uncultured Blautia sp", 2),
    "uncultured bacterium 12": ("uncultured bacterium", "uncultured bacterium", 2),
    "Mediterraneibacter_massiliensis": ("Mediterraneibacter_massiliensis",) * 2 + (1,),
    "primary endosymbiont of Foo": ("primary endosymbiont", "primary endosymbiont", 2),
    "bacterium bacterial symbiont": ("bacterium bacterial symbiont",) * 2 + (2,),
    "Foo obligate symbiont": ("Foo obligate", "Foo obligate symbiont", 3),
    "Foo bar １２３": ("Foo bar", "Foo bar 123", 3),
    "Foo bar 11 22 X1": ("Foo bar", "Foo bar 11 22 X1", 5),
    "": (None, None, 0),
}


def test_anchors(spark):
    df = spark.createDataFrame([(n,) for n in ANCHORS], "n string")
    df = df.withColumn("a", anchors.species_anchor(F.col("n")))
    df = anchors.with_compatibility_form(df, "n", "k")
    df = df.withColumn("s", anchors.subspecies_anchor(F.col("k"), F.col("a")))
    df = df.withColumn("c", anchors.anchor_word_count(F.col("s")))
    got = {r["n"]: (r["a"], r["s"], r["c"]) for r in df.collect()}
    assert got == ANCHORS


def test_species_key(evaluate):
    table = {
        "Ruminococcus bicirculans (ex Wegman et al. 2014)": "Ruminococcus bicirculans",
        "Ruminococcus bicirculans ex Wegman et al 2014": "Ruminococcus bicirculans",
        "Candidatus Cibionibacter quicibialis": "Cibionibacter quicibialis",
        "Escherichia coli subsp. foo": "Escherichia coli",
        "Escherichia coli strain K-12": "Escherichia coli",
        "Escherichia coli": "Escherichia coli",
        "Ruminococcus": "Ruminococcus",
        "Genus exiguum": "Genus exiguum",
        "": "",
        None: "",
    }
    assert one(evaluate(list(table), names.species_key)) == list(table.values())


def test_lookup_variants(evaluate):
    got = one(evaluate(["Bacteroides fragilis YCH46", "Foo bar sp. TX1", ""], names.lookup_variants))
    assert got[0] == ["Bacteroides fragilis YCH46", "YCH46", "Bacteroides YCH46", "Bacteroides"]
    assert got[1][:2] == ["Foo bar sp. TX1", "Foo bar sp."]
    assert got[2] == []


@pytest.mark.parametrize(
    "function, value, expected",
    [
        (names.has_code, "Blautia CAG 257", 1),
        (names.has_code, "Escherichia coli", 0),
        (names.has_code, None, 0),
        (names.binomial, "[Foo] bar baz", "Foo bar"),
        (names.binomial, None, ""),
        (names.canonical_form, "Foo_bar-Sp. x/1", "foo bar sp x 1"),
        (names.is_placeholder, "Foo sp. X", True),
        (names.is_placeholder, "Foo spx", False),
        (names.plain_name, "NAME::Foo  bar", "Foo bar"),
        (names.model_genus_species, "Foo_bar_X", "Foo bar"),
        (names.model_genus_species, "foo_bar", None),
        (names.strict_id, " Foo--bar_ (x)", "foo_bar_x"),
        (names.infraspecific_epithet, "Foo bar pv. baz", "baz"),
        (names.has_subspecies_marker, "Foo bar ssp. baz", True),
        (names.strain_token, "Foo bar strain K-12", "K-12"),
        (names.edge_stripped_words, "(Foo) -bar_ !", ["Foo", "bar"]),
        (names.display_name, "[Foo]_bar", "Foo bar"),
        (names.leading_letters, "Foo1", "Foo"),
        (lambda c: names.truncated(c, 5), "abcdefg", "ab..."),
    ],
)
def test_scalars(evaluate, function, value, expected):
    assert one(evaluate([value], function)) == [expected]


def test_code_choice(evaluate):
    codes = [["JCM_1", "ATCC_9", "Nissle_1"], ["dsm_1", "NRRL_2"], []]
    got = one(evaluate(codes, tokens.choose_code, kind="array<string>"))
    assert got == ["ATCC_9", "NRRL_2", None]


def test_distance(spark):
    cases = [
        (["Escherichia", "coli", "O157", "H7"], ["Escherichia", "coli", "K12"], 2 / 5),
        (["A", "b", "ATCC_1", "DSM_2"], ["A", "b", "DSM_2"], 1.0),
        (["A", "b", "ATCC_1", "DSM_2"], ["A", "b", "JCM_3"], 2 / 4),
        (["A", "b"], ["A", "b", "JCM_3"], 2 / 3),
        ([], ["A", "b"], 0.0),
        ([], [], 0.0),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<string>, b array<string>")
    both = df.select("i", tokens.token_distance(F.col("a"), F.col("b")).alias("d"),
                     tokens.token_distance(F.col("b"), F.col("a")).alias("e")).orderBy("i").collect()
    for row, (_, _, similarity) in zip(both, cases):
        assert row["d"] == row["e"] == 1.0 - similarity


def test_rounding_matches_python(evaluate):
    values = [0.155, 0.125, 2.675, 0.5, 1 / 3, 0.045, 12345.675, 0.0, 1.005]
    got = evaluate(values, lambda c: round_exact(c, 2), kind="double")
    assert one(got) == [round(v, 2) for v in values]


def test_long_texts_are_read_for_their_first_words_only(spark):
    """A bracket may close anywhere; without one the anchor must not cost a walk over the text."""
    text = "Blautia hansenii strain number " + "some more words " * 20_000
    table = spark.createDataFrame([(text, "[" + text)] * 8, "plain string, bracket string").coalesce(1).localCheckpoint()

    def seconds(column):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            found = {r[0] for r in table.select(anchors.species_anchor(F.col(column))).collect()}
            took.append(time.perf_counter() - began)
        return min(took), found

    short, found = seconds("plain")
    assert found == {"Blautia hansenii"}
    assert short < seconds("bracket")[0] / 2


@pytest.mark.parametrize("text", ["", "  ", " a", "a b c d", "\ta  b\tc d e f ", "a b c d ", "\x1ca b"])
def test_leading_words(evaluate, text):
    from binomia.functions.expr import leading_words, words

    assert evaluate([text], lambda s: leading_words(s, 4), lambda s: F.slice(words(s), 1, 4)) == [(text.split()[:4],) * 2]
